import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from corpusloom.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session("8", partitions=4)


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture(scope="session")
def texts(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").select("text").collect()
    return [r.text for r in rows]


@pytest.fixture
def column(spark):
    """Apply a column function to a list of values and return the results in order."""
    from pyspark.sql import functions as F

    def run(values, kind, fn):
        df = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}")
        return [r.y for r in df.select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()]

    return run
