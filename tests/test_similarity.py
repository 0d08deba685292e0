import pytest

from recsim.operators import gram
from recsim.operators import similarity as E
from tests.helpers import brute_cosines, random_ratings

# Hand-worked 4 users x 5 items.  Item 5 is rated only by user 4.
TINY = [
    (1, 1, 5.0), (1, 2, 3.0), (1, 3, 4.0),
    (2, 1, 3.0), (2, 2, 1.0), (2, 4, 2.0),
    (3, 2, 4.0), (3, 3, 5.0), (3, 4, 4.0),
    (4, 1, 1.0), (4, 4, 5.0), (4, 5, 3.0),
]


def _pairs(df):
    return {(r.movie_i, r.movie_j): r.cosine_similarity for r in df.collect()}


def test_tiny_exact_cosine_by_hand(mk):
    got = _pairs(E.exact_cosine_pairs(mk(TINY)))
    # items 1 and 2: dot = 5*3 + 3*1 = 18, |1|^2 = 25+9+1 = 35, |2|^2 = 9+1+16 = 26
    assert got[(1, 2)] == pytest.approx(18 / (35 * 26) ** 0.5, abs=1e-12)
    # items 4 and 5 share only user 4: dot = 15, |4|^2 = 4+16+25 = 45, |5|^2 = 9
    assert got[(4, 5)] == pytest.approx(15 / (45 * 9) ** 0.5, abs=1e-12)
    assert (2, 5) not in got          # no co-rater, no pair
    assert got == pytest.approx(brute_cosines(TINY), abs=1e-12)


@pytest.mark.parametrize("item_block,side_rows", [(1, 1), (2, 3), (3, 7), (2048, 10 ** 6)])
def test_blocked_gram_equals_brute_force_for_any_layout(mk, item_block, side_rows):
    rows = random_ratings(30, 25, 0.3, seed=item_block)
    got = _pairs(E.exact_cosine_pairs(mk(rows), item_block=item_block, side_rows=side_rows))
    want = brute_cosines(rows)
    assert set(got) == set(want)
    assert got == pytest.approx(want, abs=1e-12)


def test_hot_user_with_a_third_of_all_rows(mk):
    rows = random_ratings(60, 200, 0.02, seed=3, hot_user=0, hot_share=0.34)
    share = sum(1 for r in rows if r[0] == 0) / len(rows)
    assert share > 0.3
    layout = gram.block_map(gram.item_stats(mk(rows)), item_block=16, side_rows=10).collect()
    assert max(r["_s"] for r in layout) > 1          # the hot block is striped
    got = _pairs(E.exact_cosine_pairs(mk(rows), item_block=16, side_rows=10))
    assert got == pytest.approx(brute_cosines(rows), abs=1e-12)


def test_sparse_kernel_in_small_chunks(monkeypatch):
    import numpy as np
    monkeypatch.setattr(gram, "_CHUNK", 7)
    rng = np.random.default_rng(5)
    a = (rng.random((40, 12)) < 0.3) * rng.integers(1, 6, (40, 12))
    b = (rng.random((40, 9)) < 0.4) * rng.integers(1, 6, (40, 9))
    ua, ia = np.nonzero(a)
    ub, ib = np.nonzero(b)
    for acc in (1 << 22, 4):            # dense accumulator, then sorted pair keys
        monkeypatch.setattr(gram, "_DENSE_ACC", acc)
        for kernel in (gram._sparse_gram, gram._dense_gram):
            r, c, v = kernel(ua, ia, a[ua, ia].astype(float), ub, ib, b[ub, ib].astype(float), 40, 12, 9)
            g = np.zeros((12, 9))
            g[r, c] = v
            assert np.array_equal(g, a.T @ b)
    # diagonal cell: strictly upper triangle only
    r, c, v = gram._sparse_gram(ua, ia, a[ua, ia].astype(float), ua, ia, a[ua, ia].astype(float), 40, 12, 12,
                                upper=True)
    full = a.T @ a
    assert np.all(r < c) and np.array_equal(v, full[r, c])
    assert len(v) == int(np.count_nonzero(np.triu(full, k=1)))


def test_cosine_properties(mk):
    rows = random_ratings(40, 30, 0.25, seed=7)
    df = E.exact_cosine_pairs(mk(rows))
    pairs = df.collect()
    assert all(0.0 <= r.cosine_similarity <= 1.0 + 1e-12 for r in pairs)
    assert all(r.movie_i < r.movie_j for r in pairs)
    assert len({(r.movie_i, r.movie_j) for r in pairs}) == len(pairs)
    sym = E.symmetric_pairs(df).collect()
    s = {(r.movie_i, r.movie_j): r.cosine_similarity for r in sym}
    assert all(s[(j, i)] == c for (i, j), c in s.items())
    assert len(sym) == 2 * len(pairs)


def test_result_unchanged_by_repartition(mk):
    rows = random_ratings(25, 20, 0.3, seed=11)
    a = _pairs(E.exact_cosine_pairs(mk(rows)))
    b = _pairs(E.exact_cosine_pairs(mk(rows).repartition(7, "userId")))
    assert a == b


def test_topk_ties_break_by_id(mk):
    # items 2, 3, 4 are identical vectors, so all have the same cosine to item 1
    rows = [(u, i, float(r)) for u, r in [(1, 5), (2, 3), (3, 1)] for i in (2, 3, 4)]
    rows += [(1, 1, 4.0), (2, 1, 4.0), (3, 1, 2.0)]
    sym = E.symmetric_pairs(E.exact_cosine_pairs(mk(rows)))
    top = E.topk_neighbors(sym, 2, keep_rank=True).where("movie_i = 1").orderBy("rank").collect()
    assert [r.movie_j for r in top] == [2, 3]
    assert top[0].cosine_similarity == top[1].cosine_similarity


def test_topk_at_most_k_per_item(mk):
    rows = random_ratings(30, 25, 0.4, seed=2)
    top = E.topk_neighbors(E.symmetric_pairs(E.exact_cosine_pairs(mk(rows))), 3)
    counts = top.groupBy("movie_i").count().collect()
    assert max(r["count"] for r in counts) <= 3
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_threshold_is_strict(mk):
    rows = random_ratings(30, 20, 0.3, seed=4)
    allp = _pairs(E.exact_cosine_pairs(mk(rows)))
    cut = sorted(allp.values())[len(allp) // 2]
    kept = _pairs(E.exact_cosine_pairs(mk(rows), min_cosine=cut))
    assert kept == {k: v for k, v in allp.items() if v > cut}


def test_similar_items_untitled_vanish(mk, spark):
    from tests.conftest import ITEM_SCHEMA
    sym = E.symmetric_pairs(E.exact_cosine_pairs(mk(TINY)))
    nb = E.topk_neighbors(sym, 10)
    items = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], ITEM_SCHEMA)   # 4 and 5 untitled
    res = E.similar_items(nb, items, 1, k=5).collect()
    assert {r.movie_j for r in res} <= {2, 3}
    assert [r.cosine_similarity for r in res] == sorted([r.cosine_similarity for r in res], reverse=True)


def test_exact_path_has_no_row_python_udf(mk):
    plan = E.exact_cosine_pairs(mk(TINY))._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan
    assert "FlatMapGroupsInPandas" in plan


@pytest.mark.parametrize("item_block,side_rows,cut", [(2048, 10 ** 6, None), (3, 10 ** 6, 0.3), (3, 7, 0.3), (1, 5, None)])
def test_exact_topk_equals_window_over_all_pairs(mk, item_block, side_rows, cut):
    rows = random_ratings(35, 30, 0.3, seed=17)
    # duplicate some item vectors so that cosine ties cross cell borders
    rows += [(u, 100 + i, r) for u, i, r in rows if i < 4]
    r = mk(rows)
    want = E.topk_neighbors(E.symmetric_pairs(E.exact_cosine_pairs(r, min_cosine=cut)), 4, keep_rank=True)
    got = E.exact_topk_neighbors(r, 4, min_cosine=cut, item_block=item_block, side_rows=side_rows, keep_rank=True)
    key = lambda x: (x.movie_i, x.rank)
    w = sorted(want.collect(), key=key)
    g = sorted(got.collect(), key=key)
    assert [(x.movie_i, x.movie_j, x.rank) for x in g] == [(x.movie_i, x.movie_j, x.rank) for x in w]
    assert [x.cosine_similarity for x in g] == pytest.approx([x.cosine_similarity for x in w], abs=1e-12)


def test_hot_item_is_spread_over_stripes(mk):
    rows = random_ratings(120, 60, 0.03, seed=23)
    have = {(u, i) for u, i, _ in rows}
    rows += [(u, 0, float(1 + u % 5)) for u in range(120) if (u, 0) not in have]   # item 0: every user
    share = sum(1 for r in rows if r[1] == 0) / len(rows)
    assert share > 0.3
    stats = gram.item_stats(mk(rows))
    layout = gram.block_map(stats, item_block=16, side_rows=25).collect()
    hot_block = [r for r in layout if r["_s"] > 1]
    assert hot_block                                   # the hot item's block is striped
    got = _pairs(E.exact_cosine_pairs(mk(rows), item_block=16, side_rows=25))
    assert got == pytest.approx(brute_cosines(rows), abs=1e-12)
    top = E.exact_topk_neighbors(mk(rows), 3, item_block=16, side_rows=25, keep_rank=True).collect()
    ref = E.topk_neighbors(E.symmetric_pairs(E.exact_cosine_pairs(mk(rows))), 3, keep_rank=True).collect()
    assert sorted((x.movie_i, x.rank, x.movie_j) for x in top) == sorted((x.movie_i, x.rank, x.movie_j) for x in ref)
