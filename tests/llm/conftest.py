import random

import pytest


@pytest.fixture
def rnd():
    return random.Random(17)


@pytest.fixture
def table(spark):
    """table(schema, rows, parts) -> DataFrame dealt over a few partitions."""
    return lambda schema, rows, parts=3: spark.createDataFrame(rows, schema).repartition(parts)
