"""Every registered query against its SQL counterpart, and the shape of the plans."""

import pytest

from loopweave.catalog import ORACLES, QUERIES
from tests.conftest import SMALL
from tests.oracle import compare

# Iterative fits over the whole table; covered by their own invariants elsewhere.
ROWS_ONLY = sorted(set(QUERIES) - set(ORACLES))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(name, spark, duck):
    assert compare(QUERIES[name](spark, SMALL), duck, ORACLES[name]) is None


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_runs_with_stable_schema(name, spark):
    df = QUERIES[name](spark, SMALL)
    assert len(set(df.columns)) == len(df.columns)
    assert df.count() > 0


@pytest.fixture(scope="module")
def without_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_joins_have_equality_keys(name, without_broadcast):
    plan = QUERIES[name](without_broadcast, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "NestedLoopJoin" not in plan
