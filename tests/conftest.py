import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from noteflow.session import local_session

    session = local_session(4, "6g")
    yield session
    session.stop()


@pytest.fixture
def apply(spark):
    """Apply a column function to literal values; one row per value."""
    from pyspark.sql import functions as F

    def run(fn, values, dtype="string"):
        rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {dtype}")
        return [r[0] for r in rows.orderBy("i").select(fn(F.col("x")).alias("y")).collect()]

    return run
