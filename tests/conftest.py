import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import types as T  # noqa: E402

RATING_SCHEMA = T.StructType([
    T.StructField("userId", T.LongType()),
    T.StructField("movieId", T.LongType()),
    T.StructField("rating", T.DoubleType()),
])
ITEM_SCHEMA = T.StructType([
    T.StructField("movieId", T.LongType()),
    T.StructField("title", T.StringType()),
])


@pytest.fixture(scope="session")
def spark():
    from recsim.session import local_session
    s = local_session("4", shuffle_partitions=8, app="recsim-tests")
    yield s
    s.stop()


@pytest.fixture
def mk(spark):
    def make(rows, schema=RATING_SCHEMA):
        return spark.createDataFrame([tuple(r) for r in rows], schema)
    return make
