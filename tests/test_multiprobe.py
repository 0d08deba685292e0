"""Multi-probe signatures, real buckets of Gaussian projections, and recall from a sample."""

import math
import os
from hashlib import md5

import numpy as np
import pytest
from pyspark.sql import functions as F

from recsim.operators import lsh as L
from recsim.operators import similarity as E
from recsim.params import Params
from recsim.plans import train_eval as P
from recsim.plans.workloads import EVENT_BUCKET, PREFIX_COSINE, PROBES, RECALL_BANDS, Workload
from tests.helpers import brute_cosines, random_ratings

SF = "/root/testdata/sf0.01"


def _signatures(rows, bands, bits, probes, seed):
    items = sorted({i for _, i, _ in rows})
    out = set()
    for i in items:
        for b in range(bands):
            p = [0.0] * bits
            for u, j, r in rows:
                if j == i:
                    digits = md5(f"{seed}:{u}:{b}".encode()).hexdigest()
                    for k in range(bits):
                        p[k] += r if digits[k] < "8" else -r
            own = sum(1 << k for k in range(bits) if p[k] > 0)
            out.add((i, b, own, 0))
            for n, k in enumerate(sorted(range(bits), key=lambda k: (abs(p[k]), k))[:probes]):
                out.add((i, b, own ^ (1 << k), n + 1))
    return out


@pytest.mark.parametrize("bands,bits,probes", [(2, 3, 0), (3, 4, 2), (1, 2, 5)])
def test_probed_signatures(mk, bands, bits, probes):
    rows = random_ratings(20, 12, 0.4, 3)
    got = {tuple(r) for r in L.probed_signatures(mk(rows), bands, bits, probes, 7).select("movieId", "band", "bucket", "probe").collect()}
    assert got == _signatures(rows, bands, bits, probes, 7)


def test_bits_keep_the_bucket_size():
    assert L.bits_for(0, 64) == L.bits_for(100, 64) == 1
    for items in (1000, 10 ** 6, 10 ** 9):
        assert items / 64 <= 1 << L.bits_for(items, 64) < items / 16
    assert L.bits_for(10 ** 15, 64) == L.MAX_BITS


def test_topk_is_exact_inside_the_shared_buckets(mk):
    rows = random_ratings(40, 60, 0.3, 5)
    df = mk(rows)
    sig = _signatures(rows, 2, L.bits_for(60, 8), 1, 126784)
    held = {}
    for i, b, bucket, _ in sig:
        held.setdefault(i, set()).add((b, bucket))
    cos = {k: c for k, c in brute_cosines(rows).items() if held[k[0]] & held[k[1]]}
    both = cos | {(j, i): c for (i, j), c in cos.items()}
    want = set()
    for i in held:
        near = sorted((-round(c, 9), j) for (a, j), c in both.items() if a == i)[:5]
        want |= {(i, j) for _, j in near}
    got = {(r.movie_i, r.movie_j) for r in L.multiprobe_topk_neighbors(df, 5, bands=2, bucket_items=8, probes=1).collect()}
    assert got == want


def test_probing_raises_recall_at_equal_bands(mk):
    rows = random_ratings(60, 80, 0.25, 9)
    df = mk(rows)
    exact = {(r.movie_i, r.movie_j) for r in E.exact_topk_neighbors(df, 5).collect()}
    found = []
    for probes in (0, 1, 2):
        got = {(r.movie_i, r.movie_j) for r in L.multiprobe_topk_neighbors(df, 5, bands=3, bucket_items=10, probes=probes).collect()}
        found.append(len(got & exact) / len(exact))
    assert found[0] < found[1] < found[2]


def test_train_and_evaluate_by_multiprobe(mk):
    df = mk(random_ratings(40, 30, 0.4, 1))
    p = Params(threshold=1.3, num_hash_tables=8, bucket_items=64, probes=1)     # one bit and its flip: every item in both buckets
    a, b = (P.train_and_evaluate(df, p, m).metrics.first() for m in ("exact", "multiprobe"))
    assert a.rmse == pytest.approx(b.rmse, abs=1e-12) and a.coverage == b.coverage
    with pytest.raises(ValueError):
        P.cross_validate(df, 3, p, "multiprobe")


def _gauss(u, t, seed):
    h = md5(f"{seed}:g:{u}:{t}".encode()).hexdigest()
    a, b = ((int(h[k:k + 8], 16) + 0.5) / 2 ** 32 for k in (0, 8))
    return math.sqrt(-2 * math.log(a)) * math.cos(2 * math.pi * b)


def test_gaussian_buckets(mk):
    rows = random_ratings(30, 10, 0.5, 2)
    users = sorted({u for u, _, _ in rows})
    want = set()
    for t in range(3):
        g = {u: _gauss(u, t, 5) for u in users}
        size = math.sqrt(sum(x * x for x in g.values()))
        for i in {i for _, i, _ in rows}:
            mine = [(u, r) for u, j, r in rows if j == i]
            p = sum(r * g[u] for u, r in mine) / math.sqrt(sum(r * r for _, r in mine)) / size
            want |= {(b, i, t, math.floor(p / b)) for b in (0.05, 0.5, 1.0)}
    got = {tuple(r) for r in L.gaussian_buckets(mk(rows), 3, (0.05, 0.5, 1.0), 5).collect()}
    assert got == want
    assert {b for length, _, _, b in got if length == 1.0} <= {-1, 0} and len({b for length, _, _, b in got if length == 0.05}) > 2


def test_gaussian_numbers_are_normal(spark):
    x = np.array([r.g for r in spark.range(4000).withColumnRenamed("id", "u").select(L.gaussian("u", 1, 3).alias("g")).collect()])
    assert abs(x.mean()) < 0.06 and abs(x.std() - 1) < 0.04 and abs((np.abs(x) < 1).mean() - 0.6827) < 0.03


def test_gaussian_pairs_are_exact_in_shared_buckets(mk):
    rows = random_ratings(30, 20, 0.4, 4)
    df = mk(rows)
    buckets = L.gaussian_buckets(df, 3, (0.1, 0.4), 1)
    held = {}
    for r in buckets.collect():
        held.setdefault((r.bucketLength, r.movieId), {})[r.hash_table] = r.bucket
    cos = brute_cosines(rows)
    want = {}
    for length in (0.1, 0.4):
        for (i, j), c in cos.items():
            same = [t for t in range(3) if held[length, i][t] == held[length, j][t]]
            if same and c > 0.2:
                want[length, i, j] = min(same)
    got = {(r.bucketLength, r.movie_i, r.movie_j): r.first_table for r in L.gaussian_pairs(df, buckets, min_cosine=0.2).collect()}
    assert got == want and len({k[0] for k in got}) == 2


def test_fine_lengths_in_the_sweep_leave_the_others_alone(mk):
    df = mk(random_ratings(40, 25, 0.4, 6))
    grid = dict(tables=(1, 2), thresholds=(1.2,), top_ks=(5,))
    rows = P.parameter_sweep(df, bucket_lengths=(0.05, 0.3, 1.0, 3.0), **grid).collect()
    coarse = P.parameter_sweep(df, bucket_lengths=(1.0, 3.0), **grid).collect()
    key = lambda r: (r.bucketLength, r.numHashTables)
    assert sorted(map(key, rows)) == [(b, t) for b in (0.05, 0.3, 1.0, 3.0) for t in (1, 2)]
    fine = {key(r): r.rmse for r in rows}
    assert all(fine[key(r)] == pytest.approx(r.rmse, abs=1e-12) for r in coarse)
    assert fine[0.05, 1] != fine[1.0, 1]
    with pytest.raises(ValueError):
        L.gaussian_buckets(df, 1, (0.0,))


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_the_sampled_interval_holds_the_full_recall(spark):
    wl = Workload(spark, SF)
    full = {r.num_tables: r.recall for r in wl.lsh_recall().collect()}
    for r in wl.lsh_recall_sampled().collect():
        assert r.low <= full[r.num_tables] <= r.high
    lp = wl.part_ratings
    sig = L.probed_signatures(lp, RECALL_BANDS, L.bits_for(2000, 64), PROBES, wl.p.seed)
    held = sig.groupBy("movieId").agg(F.collect_set(F.struct("band", "bucket")).alias("b"))
    truth = E.exact_cosine_pairs(lp, min_cosine=PREFIX_COSINE)
    a, b = (held.select(F.col("movieId").alias(f"movie_{s}"), F.col("b").alias(f"b{s}")) for s in "ij")
    first = truth.join(a, "movie_i").join(b, "movie_j").select(F.array_min(F.array_intersect("bi", "bj"))["band"].alias("t")).collect()
    for r in wl.part_recall_sampled().collect():
        recall = sum(x.t is not None and x.t < r.num_tables for x in first) / len(first)
        assert r.low <= recall <= r.high
        if r.num_tables == RECALL_BANDS:
            assert recall >= 0.9


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_no_table_of_all_pairs_in_the_sampled_plan(spark):
    plan = Workload(spark, SF).lsh_recall_sampled()._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan and "CartesianProduct" not in plan


def test_sampling_every_item_gives_the_full_recall(mk):
    rows = random_ratings(30, 20, 0.5, 8)
    df = mk(rows)
    sig = L.projection_signatures(df, 3, 2, 1)
    pairs = L.projection_pairs(df, sig, min_cosine=0.4)
    full = {r.num_tables: r.recall for r in L.lsh_recall(E.exact_cosine_pairs(df, min_cosine=0.4), pairs, 3).collect()}
    for r in L.sampled_recall(df, sig, 3, min_cosine=0.4, sample=100).collect():
        assert r.recall == pytest.approx(full[r.num_tables]) and r.low == r.high == pytest.approx(r.recall)
    none = L.sampled_recall(df, sig, 2, min_cosine=0.9999, sample=5).collect()
    assert [(r.true_pairs, r.recall, r.low) for r in none] == [(0, None, None)] * 2


def test_work_of_the_buckets(mk):
    rows = random_ratings(20, 15, 0.5, 1)
    sig = L.probed_signatures(mk(rows), 2, L.bits_for(15, EVENT_BUCKET), 1)
    work = L.bucket_work(sig).first()
    assert (work["items"], work.buckets, work.largest_bucket, work.pairs) == (15, 4, 15, 4 * 105)
