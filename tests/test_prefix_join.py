"""Prefix-filter cosine join against brute force, and what it prunes."""

import numpy as np
import pytest

from recsim.operators import prefix_join as X
from tests.helpers import brute_cosines, random_ratings


def joined(df, t, **kw):
    found = X.prefix_cosine_join(df, t, **kw)
    return {(r.movie_i, r.movie_j): r.cosine_similarity for r in found.pairs.collect()}, found.work.first()


@pytest.mark.parametrize("seed,density,t,block", [(0, 0.3, 0.3, 2048), (1, 0.1, 0.2, 4), (2, 0.6, 0.8, 3), (3, 0.05, 0.05, 2048), (4, 0.3, 1.0, 2)])
def test_equals_brute_force(mk, seed, density, t, block):
    rows = random_ratings(40, 25, density, seed)
    got, work = joined(mk(rows).repartition(5), t, list_block=block)
    want = {k: c for k, c in brute_cosines(rows).items() if c > t}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    degree = np.bincount([u for u, _, _ in rows])
    assert work.ratings == len(rows) and work.products_done + work.products_pruned == sum(d * (d - 1) // 2 for d in degree)


def test_hot_users_are_not_paired(mk):
    """Users who rated everything fill the longest lists; at a high threshold hardly a product of theirs is made."""
    rng = np.random.default_rng(7)
    rows = [(100 + u, i, 1.0) for u in range(3) for i in range(300)]
    rows += [(1000 + i // 2 * 40 + k, i, float(rng.integers(3, 6))) for i in range(300) for k in range(12)]
    got, work = joined(mk(rows), 0.7, list_block=16)
    want = {k: c for k, c in brute_cosines(rows).items() if c > 0.7}
    assert got.keys() == want.keys() and len(got) >= 100
    assert work.products_pruned > 0.95 * (work.products_done + work.products_pruned)


def test_weights_of_either_sign_and_empty(mk):
    rng = np.random.default_rng(3)
    rows = [(u, i, float(rng.normal())) for u in range(15) for i in range(12) if rng.random() < 0.7]
    got, _ = joined(mk(rows), 0.25)
    assert got.keys() == {k for k, c in brute_cosines(rows).items() if c > 0.25}
    got, work = joined(mk([]), 0.5)
    assert got == {} and work.ratings == work.products_done == work.products_pruned == 0
    assert joined(mk([(1, 1, 0.0), (1, 2, 3.0), (2, 3, 1.0)]), 0.5)[0] == {}
    with pytest.raises(ValueError):
        X.prefix_cosine_join(mk(rows), 0.0)


def test_one_users_single_ratings_all_pair(mk):
    rows = [(9, i, 4.0) for i in range(30)]                     # every pair has cosine 1: the one hot list is the answer
    got, _ = joined(mk(rows), 0.9, list_block=5)
    assert len(got) == 30 * 29 // 2 and all(c == 1.0 for c in got.values())


def test_the_order_of_users_travels_without_keys(mk, monkeypatch):
    """Only numbers go with a rating: the md5 that orders the users is made inside the task that needs it."""
    written = {}
    cut = X.cut_lineage
    monkeypatch.setattr(X, "cut_lineage", lambda df, name: written.setdefault(name, cut(df, name)))
    entries = X.prefix_entries(mk(random_ratings(40, 25, 0.3, 2)), 0.3)
    assert dict(written["user-order"].dtypes) == {"userId": "bigint", "movieId": "bigint", "rating": "double", "_range": "int"}
    plan = entries._jdf.queryExecution().executedPlan().toString()
    assert "md5" in plan and entries.count() == written["user-order"].count()
