import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidemark.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = get_session("tests", "local[4]", 2)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def frame(spark):
    """Rows of strings or numbers plus a DDL schema; dates and times are cast from text."""

    def make(rows, ddl):
        from pyspark.sql import functions as F

        want = spark.createDataFrame([], ddl).schema
        plain = ", ".join(f"{f.name} {'string' if f.dataType.simpleString() in ('date', 'timestamp') else f.dataType.simpleString()}" for f in want)
        df = spark.createDataFrame(rows, plain)
        return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in want])

    return make
