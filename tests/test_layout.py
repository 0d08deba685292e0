"""The Gram product's result does not depend on how it is laid out over tasks."""

import tracemalloc

import numpy as np
import pytest

from recsim.operators import gram
from recsim.operators import similarity as E

LAYOUTS = [(8192, 10 ** 6), (4, 120), (4, 60), (8, 37)]


def _rows(df):
    return sorted((*r[:2], *(round(x, 9) if isinstance(x, float) else x for x in r[2:])) for r in df.collect())


@pytest.fixture
def same_items(mk):
    """60 items, 16 of them rated alike, so that many cosines tie."""
    rng = np.random.default_rng(0)
    rows = []
    for user in range(40):
        alike = float(rng.integers(1, 6))
        for item in range(60):
            if item < 16 or rng.random() < 0.4:
                rows.append((user, item, alike if item < 16 else float(rng.integers(1, 6))))
    return mk(rows).cache()


@pytest.fixture
def signed(mk):
    """Ratings of both signs: the dot products of some pairs cancel to zero."""
    rng = np.random.default_rng(1)
    rows = [(u, i, float(rng.choice([-2, -1, 1, 2]))) for u in range(24) for i in range(20) if rng.random() < 0.7]
    rows += [(100, 50, 1.0), (101, 50, 1.0), (100, 51, 1.0), (101, 51, -1.0)]
    return mk(rows).cache()


@pytest.mark.parametrize("k", [1, 5])
def test_neighbours_are_the_same_in_every_layout(same_items, k):
    want = _rows(E.exact_topk_neighbors(same_items, k, keep_rank=True))
    assert len(want) == 60 * k
    for item_block, side_rows in LAYOUTS[1:]:
        assert _rows(E.exact_topk_neighbors(same_items, k, item_block=item_block, side_rows=side_rows, keep_rank=True)) == want


def test_pairs_are_the_same_in_every_layout(signed):
    want = _rows(E.exact_cosine_pairs(signed))
    assert not any(r[:2] == (50, 51) for r in want) and all(-1 <= r[2] <= 1 for r in want)
    for item_block, side_rows in LAYOUTS[1:] + [(8192, 5)]:
        assert _rows(E.exact_cosine_pairs(signed, item_block=item_block, side_rows=side_rows)) == want


@pytest.mark.parametrize("hot", [4, 8, 16])
def test_sparse_kernel_memory_is_flat(hot):
    """Beside the pairs themselves; users who rated every item cost products, not memory."""
    na, rng = 2500, np.random.default_rng(2)
    users = np.concatenate([np.repeat(np.arange(hot), na), hot + np.arange(5000)])
    items = np.concatenate([np.tile(np.arange(na), hot), rng.integers(0, na, 5000)])
    values = np.ones(len(users))
    tracemalloc.start()
    rows, _, _ = gram._sparse_gram(users, items, values, users, items, values, hot + 5000, na, na, upper=True)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert len(rows) == na * (na - 1) // 2
    assert peak < 500e6


def _frames(users, items, step=10_000):
    import pandas as pd
    u, i = (x.ravel() for x in np.meshgrid(np.arange(users), np.arange(items), indexing="ij"))
    rating = np.random.default_rng(3).normal(size=len(u))
    norm2 = np.bincount(i, weights=rating * rating)
    for at in range(0, len(u), step):
        s = slice(at, at + step)
        yield pd.DataFrame({"userId": u[s], "movieId": i[s], "rating": rating[s], "_norm2": norm2[i[s]], "_blk": np.zeros(len(u[s]), np.int32), "_stripe": 0, "_lo": 0, "_hi": 0})


def test_a_dense_cell_holds_a_slab_and_not_its_pairs():
    """3,000 dense vectors make 4.5M pairs; those behind the threshold are never held, and the others leave slab by slab."""
    frames = list(_frames(16, 3000))
    cell = gram._cell_function([], True, None, 0.9)
    tracemalloc.start()
    n = sum(len(f) for f in cell(iter(frames)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert 0 < n < 10_000 and peak < 120 << 20
