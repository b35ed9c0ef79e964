import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from skilltrail.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, partitions=4, memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Value of an expression over one literal text."""

    def value(build, text):
        from pyspark.sql import functions as F

        frame = spark.createDataFrame([(text,)], "t string")
        return frame.select(build(F.col("t")).alias("v")).first()["v"]

    return value
