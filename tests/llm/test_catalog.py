"""Every registered query of the subpackage: against SQL where there is one, and its shape."""

import pytest

import __spark_entry__ as entry
from loopweave.llm.catalog import ORACLES, QUERIES
from tests.conftest import SMALL
from tests.oracle import compare

COLUMNS = {
    "op1": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op2": "doc_id held_out score predicted", "op3": "doc_id size source_size target taken",
    "op4": "doc_id held_out lang_pred score", "op5": "doc_id start n_tokens ids_crc32",
    "op6": "doc_id n_shingles component_id kept", "op7": "doc_id n_lines n_kept n_exact n_near",
    "op8": "query_id rank vec_id score",
    "op9": "page_id payload_bytes payload_digest record_type refers_to",
    "op10": "page_id host path rule verdict",
    "op11": "doc_id n_features weight score rank",
    "op12": "doc_id n_words n_removed kept_sha256",
    "op13": "vec_id cluster distance cluster_inertia inertia centroid_sha256"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(name, spark, duck):
    assert compare(QUERIES[name](spark, SMALL), duck, ORACLES[name]) is None


def test_one_query_for_each_operator_and_the_pipeline():
    names = [n for n in entry.queries() if n.startswith("op") or n == "pipeline"]
    assert sorted(n.split("_")[0] for n in names) == sorted([*COLUMNS, "pipeline"])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_columns_and_rows(name, spark):
    df = QUERIES[name](spark, SMALL)
    assert set(COLUMNS[name.split("_")[0]].split()) <= set(df.columns)
    assert df.count() == spark.read.parquet(f"{SMALL}/documents.parquet").count()
