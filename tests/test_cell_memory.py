"""What a Gram cell holds: narrow ratings, a small slab, and a few products or users at a time."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest

from recsim.operators import gram
from recsim.operators import similarity as E
from tests.helpers import brute_cosines, random_ratings


def _frames(users, items, each, step=10_000):
    """``each`` ratings of whole users, one of every band of items, in batches that come in no order of users."""
    rng = np.random.default_rng(1)
    u = np.repeat(np.arange(users), each)
    i = (np.tile(np.arange(each), users) * (items // each) + rng.integers(0, items // each, users * each))
    order = rng.permutation(len(u))
    u, i = u[order] * 1_000_003, i[order]
    for at in range(0, len(u), step):
        s = slice(at, at + step)
        yield pd.DataFrame({"userId": u[s], "movieId": i[s], "rating": np.full(len(u[s]), 2.0), "_norm2": np.full(len(u[s]), 9.0),
                            "_blk": np.zeros(len(u[s]), np.int32), "_stripe": 0, "_lo": 0, "_hi": 0})


@pytest.mark.parametrize("users,items,each", [(25_000, 3000, 20), (25_000, 60, 20)])
def test_a_cell_of_half_a_million_ratings_holds_little(users, items, each):
    frames = list(_frames(users, items, each))
    cell = gram._cell_function([], False)
    tracemalloc.start()
    total = sum(float(f["_dot"].sum()) for f in cell(iter(frames)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert total == 4.0 * users * each * (each - 1) / 2
    assert peak < 100 << 20


@pytest.mark.parametrize("side", [1, 50, 1 << 20])
def test_users_by_pieces_give_the_whole_product(monkeypatch, side):
    monkeypatch.setattr(gram, "_DENSE_SIDE", side)
    rng = np.random.default_rng(7)
    a, b = rng.integers(0, 4, (30, 9)) * (rng.random((30, 9)) < 0.5), rng.integers(0, 4, (30, 5)) * (rng.random((30, 5)) < 0.5)
    triplets = []
    for x in (a, b):
        u, i = rng.permutation(np.argwhere(x)).T
        triplets += [u.astype(np.int32), i.astype(np.int32), x[u, i].astype(np.uint8)]
    for kernel in (gram._dense_gram, gram._sparse_gram):
        got = np.zeros((9, 5))
        r, c, v = kernel(*triplets, 30, 9, 5)
        got[r, c] = v
        assert (got == a.T @ b).all()


def test_stripes_that_lack_a_block_and_null_users(mk):
    rows = random_ratings(25, 30, 0.2, 3) + [(None, i, 2.5) for i in range(0, 30, 4)]
    got = {(r.movie_i, r.movie_j): r.cosine_similarity for r in E.exact_cosine_pairs(mk(rows), item_block=3, side_rows=2).collect()}
    want = brute_cosines([(-1 if u is None else u, i, r) for u, i, r in rows])
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
