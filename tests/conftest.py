import os

import pytest

from loopweave.catalog.views import Tables
from loopweave.session import local_session
from tests.oracle import connect

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session(os.environ.get("TEST_CPUS", "8"), "loopweave-tests")


@pytest.fixture(scope="session")
def duck():
    return connect(SMALL)


@pytest.fixture(scope="session")
def tables(spark):
    return Tables(spark, SMALL)


@pytest.fixture
def rows(spark):
    """rows(schema, [tuples]) -> DataFrame"""
    return lambda schema, data: spark.createDataFrame(data, schema)
