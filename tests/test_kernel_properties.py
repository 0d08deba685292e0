"""Property tests of the two in-task Gram kernels against numpy (no Spark)."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from recsim.operators import gram


@st.composite
def blocks(draw):
    nu = draw(st.integers(1, 25))
    na = draw(st.integers(1, 12))
    nb = draw(st.integers(1, 12))
    seed = draw(st.integers(0, 2 ** 31 - 1))
    rng = np.random.default_rng(seed)
    a = (rng.random((nu, na)) < draw(st.floats(0.05, 1.0))) * rng.integers(1, 6, (nu, na))
    b = (rng.random((nu, nb)) < draw(st.floats(0.05, 1.0))) * rng.integers(1, 6, (nu, nb))
    return a.astype(float), b.astype(float)


def _run(kernel, a, b, upper=False):
    ua, ia = np.nonzero(a)
    ub, ib = np.nonzero(b)
    r, c, v = kernel(ua, ia, a[ua, ia], ub, ib, b[ub, ib], a.shape[0], a.shape[1], b.shape[1], upper=upper)
    g = np.zeros((a.shape[1], b.shape[1]))
    g[r, c] = v
    return r, c, g


@settings(max_examples=60, deadline=None)
@given(blocks(), st.sampled_from([1, 3, 1 << 22]), st.sampled_from([2, 1 << 22]))
def test_kernels_equal_numpy(ab, chunk, acc):
    a, b = ab
    old = gram._CHUNK, gram._DENSE_ACC
    gram._CHUNK, gram._DENSE_ACC = chunk, acc
    try:
        for kernel in (gram._sparse_gram, gram._dense_gram):
            r, c, g = _run(kernel, a, b)
            assert np.array_equal(g, a.T @ b)
            assert len(set(zip(r.tolist(), c.tolist()))) == len(r)       # each pair once
            ru, cu, gu = _run(kernel, a, a, upper=True)
            assert np.all(ru < cu)
            assert np.array_equal(gu, np.triu(a.T @ a, k=1))
    finally:
        gram._CHUNK, gram._DENSE_ACC = old
