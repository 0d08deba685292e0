"""Products of the pairs of a bucket from users' histories: the rows of the Gram product of the buckets, and what is sent."""

import numpy as np
import pytest

from recsim.operators import bucket_histories as B
from recsim.operators import histories as H
from recsim.operators import lsh as L
from tests.helpers import random_ratings

PROBE = dict(bands=3, bucket_items=2, probes=2)


def _rows(df):
    return sorted((r.movie_i, r.movie_j, round(r.cosine_similarity, 9)) for r in df.collect())


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture
def large(monkeypatch):
    monkeypatch.setattr(H, "LEAST_ROWS", 0)
    monkeypatch.setattr(B, "PRODUCTS", 20)


@pytest.mark.parametrize("codes,step", [(1, 3), (1 << 19, 1 << 19)])
def test_neighbours_equal_those_of_the_cells(mk, large, monkeypatch, codes, step):
    """Null users and items, zero and null ratings, signed ratings; in one piece and in many."""
    rng = np.random.default_rng(5)
    rows = random_ratings(60, 40, 0.15, 5, hot_user=3, hot_share=0.03) + [(None, i, float(rng.normal())) for i in range(12)]
    df = mk(rows + [(7000, 5, 0.0), (7001, 6, None), (7000, 900, 0.0), (7002, None, 2.0), (7002, 4, 3.0)]).repartition(5)
    monkeypatch.setattr(B, "CODES", codes)
    monkeypatch.setattr(B, "STEP", step)
    got = [L.multiprobe_topk_neighbors(df, k, min_cosine=c, **PROBE) for k, c in ((3, None), (30, 0.2))]
    assert all("MapInArrow" in _plan(x) and "FlatMapGroupsInPandas" not in _plan(x) for x in got)
    got = [_rows(x) for x in got]
    monkeypatch.setattr(H, "LEAST_ROWS", 1 << 60)
    cells = [L.multiprobe_topk_neighbors(df, k, min_cosine=c, **PROBE) for k, c in ((3, None), (30, 0.2))]
    assert all("FlatMapGroupsInPandas" in _plan(x) for x in cells)
    assert got == [_rows(x) for x in cells] and len(got[1]) > 50


def test_users_too_wide_and_buckets_too_full_go_by_cells(mk, large, monkeypatch):
    df = mk(random_ratings(60, 40, 0.15, 5))
    sig = L.probed_signatures(df, 3, 5, 2)
    assert B.bucket_products(df, sig, df.count(), side_rows=1000) is not None
    assert B.bucket_products(df, sig, df.count(), side_rows=20) is None
    dense = mk(random_ratings(20, 40, 0.9, 5))
    monkeypatch.setattr(B, "PRODUCTS", 2)
    assert B.bucket_products(dense, L.probed_signatures(dense, 3, 1, 1), dense.count(), side_rows=1000) is None
    assert B.bucket_products(df.where("false"), sig.where("false"), 0, side_rows=1000) is None


def test_a_pair_meets_once_however_many_buckets_it_shares(monkeypatch):
    monkeypatch.setattr(B, "STEP", 1)
    user = np.array([0, 0, 0, 1, 1])
    codes = [[1, 2, 3], [1, 2], [3, 1 << 61], [1, 2, 3], [4]]
    got = [p for a, b in B.shared_pairs(user, np.array([len(c) for c in codes]), np.concatenate(codes)) for p in zip(a.tolist(), b.tolist())]
    assert sorted(got) == [(0, 1), (0, 2)]


def test_signatures_of_rarely_rated_items_are_summed_where_their_ratings_lie(mk, monkeypatch):
    """No partial sums of every bit are shuffled: the plan aggregates behind the one exchange of the ratings."""
    df = mk(random_ratings(30, 20, 0.3, 4))
    plan = L.probed_signatures(df, 3, 5, 2)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan
    rows = sorted(map(tuple, L.probed_signatures(df, 3, 5, 2).collect()))
    monkeypatch.setattr(L, "FEW", 0)
    assert rows == sorted(map(tuple, L.probed_signatures(df, 3, 5, 2).collect()))
