import numpy as np
import pytest

from recsim.llm import vectors
from recsim.llm.registry import QUERIES

SF = "/root/testdata/sf0.001"


def brute(rows, t):
    good = {}
    for k, (i, v) in enumerate(rows):
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[k] = np.array(v, float)
    n, root = [0] * len(rows), list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k
    for a in good:
        for b in good:
            if a < b and len(good[a]) == len(good[b]) and vectors.exact_cosine(good[a], good[b]) >= t:
                n[a] += 1
                n[b] += 1
                root[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(rows):
        low[find(k)] = min(low.get(find(k), i), i)
    return sorted((i, n[k], low[find(k)], i == low[find(k)]) for k, (i, _) in enumerate(rows))


def cloud(seed, n, dim, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(max(1, n // 12), dim))
    return [(int(i), (centres[rng.integers(len(centres))] + rng.normal(0, spread, dim)).tolist()) for i in rng.permutation(n)]


@pytest.mark.parametrize("t,dim,cell,block", [(0.9, 8, 4096, 4096), (0.9, 8, 20, 16), (0.95, 3, 7, 5), (0.5, 2, 10, 50), (1.0, 4, 10, 10)])
def test_equals_brute_force(spark, t, dim, cell, block):
    rows = cloud(dim, 240, dim, 0.35)
    rows += [(1000 + k, v) for k, (_, v) in enumerate(rows[:30])] + [(2000, [2 * x for x in rows[0][1]]), (2001, [-x for x in rows[0][1]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = sorted(tuple(r) for r in vectors.near_duplicates(df, t, cell_vectors=cell, block_rows=block).collect())
    want = brute(rows, t)
    if t == 1.0:                                   # rounding decides: only exact copies are sure
        assert all(g[1] >= 1 for g in got if 1000 <= g[0] < 1030)
    else:
        assert got == want


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 2.0]), (8, [1.0, 2.0]),
            (8, [1.0, 2.0]), (9, [1.0, 2.0, 0.0]), (10, [1e-300, 2e-300]), (11, [1e300, 2e300]), (12, [-0.0, 1.0]), (13, [0.0, 1.0])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, cell int, data string")
    got = sorted(tuple(r) for r in vectors.near_duplicates(df).collect())
    kept = [(i, 0, i, True) for i in (1, 2, 3, 4, 5, 6, 9)]
    assert got == sorted(kept + [(7, 4, 7, True), (8, 4, 7, False), (8, 4, 7, False), (10, 4, 7, False), (11, 4, 7, False)]
                         + [(12, 1, 12, True), (13, 1, 12, False)])
    none = spark.createDataFrame([(None, [1.0])], "vec_id long, embedding array<float>")
    assert vectors.near_duplicates(none).count() == 0 == vectors.near_duplicates(none.limit(0)).count()


def test_one_crowded_cell_is_cut_into_blocks(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (np.array([1.0, 0, 0]) + rng.normal(0, 0.02, 3)).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in vectors.near_duplicates(df, cell_vectors=50, block_rows=32).collect())
    assert got == brute(rows, 0.9)


def test_query_equals_brute_force(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = sorted(tuple(r) for r in QUERIES["op2_embedding_near_dedup"](spark, SF).select("vec_id", "n_links", "component_id", "kept").collect())
    assert got == brute(rows, 0.9)
