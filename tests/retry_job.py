"""Run in a subprocess by test_retry.py: a task of the input stage fails on its
first attempt; the retried job must give exactly the fault-free result."""

import json
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark import TaskContext  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

from recsim.params import Params  # noqa: E402
from recsim.plans import train_eval as P  # noqa: E402
from recsim.session import ensure_checkpoint_dir  # noqa: E402
from tests.helpers import random_ratings  # noqa: E402


def flaky(it):
    ctx = TaskContext.get()
    if ctx.partitionId() == 0 and ctx.attemptNumber() == 0:
        raise RuntimeError("injected task failure")
    yield from it


def main():
    spark = (SparkSession.builder.master("local[4,3]").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.shuffle.partitions", "4").getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    ensure_checkpoint_dir(spark)
    rows = random_ratings(40, 30, 0.3, seed=21)
    schema = "userId long, movieId long, rating double"
    clean = spark.createDataFrame(rows, schema).repartition(4)
    faulty = clean.mapInPandas(flaky, schema)
    p = Params(threshold=1.3, top_k=5, min_ratings=2)
    out = {}
    for name, df in (("clean", clean), ("faulty", faulty)):
        run = P.train_and_evaluate(df, p, "exact")
        nb = sorted((r.movie_i, r.movie_j, r.cosine_similarity) for r in run.neighbors.collect())
        out[name] = {"neighbors": nb, "rmse": run.metrics.first().rmse}
    print(json.dumps({"same": out["clean"] == out["faulty"], "n": len(out["clean"]["neighbors"])}))
    spark.stop()


if __name__ == "__main__":
    main()
