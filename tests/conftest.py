import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from parchment.session import local_session

    return local_session("8")


@pytest.fixture(scope="session")
def one(spark):
    """Value of a column expression over one text."""

    def run(build, text, **more):
        from pyspark.sql import functions as F

        row = {"text": text, **more}
        df = spark.createDataFrame([tuple(row.values())], list(row))
        return df.select(build(F.col("text")).alias("x")).collect()[0][0]

    return run
