"""Benchmark: headline runs at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is forced to completion on the executors (``noop`` sink or a
one-row collect of a metric); nothing large is collected.  A short warm-up
query runs first so JVM start-up and JIT are not charged to the first query.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from recsim.operators import interactions as D  # noqa: E402
from recsim.operators import lsh as L  # noqa: E402
from recsim.operators import similarity as E  # noqa: E402
from recsim.params import Params  # noqa: E402
from recsim.plans import train_eval as P  # noqa: E402
from recsim.plans.workloads import DRIVER_PARAMS, Workload  # noqa: E402
from recsim.session import local_session  # noqa: E402
from recsim.sources import testdata as src  # noqa: E402


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, app="recsim-bench")
    p = DRIVER_PARAMS
    ratings = src.event_ratings(spark, sf_dir)
    wl = Workload(spark, sf_dir, p)

    # warm-up (not timed): JVM/JIT and the Python workers of the pandas stages
    drain(D.item_support(ratings))
    n = int(cpus) if cpus.isdigit() else 8
    drain(spark.range(0, 4 * n, numPartitions=n).mapInPandas(lambda it: it, "id long"))

    def run_eval(method: str, params: Params):
        run = P.train_and_evaluate(ratings, params, method)
        return run.metrics.collect()

    def sweep():
        return P.parameter_sweep(ratings, base=p).collect()

    def cv():
        return P.cross_validate(ratings, 5, p)[1].collect()

    def lp_pairs():
        lp = src.lineitem_ratings(spark, sf_dir, "part")
        drain(E.exact_cosine_pairs(lp, item_block=p.item_block, side_rows=p.side_rows))

    def lp_topk():
        lp = src.lineitem_ratings(spark, sf_dir, "part")
        drain(E.exact_topk_neighbors(lp, p.top_k, item_block=p.item_block, side_rows=p.side_rows))

    def lp_multiprobe():
        lp = src.lineitem_ratings(spark, sf_dir, "part")
        drain(L.multiprobe_topk_neighbors(lp, p.top_k, bands=3, bucket_items=p.bucket_items, probes=p.probes, seed=p.seed))

    def lp_train_eval():
        lp = src.lineitem_ratings(spark, sf_dir, "part")
        return P.train_and_evaluate(lp, p.with_(threshold=1.4), "exact").metrics.collect()

    queries = {
        "train_eval_exact": lambda: run_eval("exact", p),
        "train_eval_lsh": lambda: run_eval("lsh", p),
        "train_eval_mllib": lambda: run_eval("mllib", p),
        "parameter_sweep_36": sweep,
        "cross_validate_5fold": cv,
        "exact_pairs_part_ratings": lp_pairs,
        "exact_topk_part_ratings": lp_topk,
        "multiprobe_topk_part_ratings": lp_multiprobe,
        "train_eval_part_ratings": lp_train_eval,
        "similar_items": lambda: wl.similar_items().collect(),
        "user_recommendations": lambda: drain(wl.user_recommendations()),
        "seed_recommendations_bulk": lambda: drain(wl.seed_recommendations_bulk()),
        "lsh_recall": lambda: wl.lsh_recall().collect(),
    }
    only = [q for q in os.environ.get("BENCH_ONLY", "").split(",") if q]
    times = {}
    for name, fn in queries.items():
        if only and name not in only:
            continue
        t0 = time.time()
        fn()
        times[name] = round(time.time() - t0, 3)
    spark.stop()
    sf = sf_dir.rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
                      "cpus": cpus}))


if __name__ == "__main__":
    main()
