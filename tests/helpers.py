"""Brute-force references used by the tests (numpy over small fixtures)."""

from __future__ import annotations

import itertools

import numpy as np


def brute_cosines(rows):
    """{(i, j): cosine} over all co-rated pairs i < j of (user, item, rating) rows."""
    users = sorted({r[0] for r in rows})
    items = sorted({r[1] for r in rows})
    ui = {u: k for k, u in enumerate(users)}
    ii = {i: k for k, i in enumerate(items)}
    m = np.zeros((len(users), len(items)))
    for u, i, r in rows:
        m[ui[u], ii[i]] = r
    norms = (m * m).sum(axis=0)
    out = {}
    for a, b in itertools.combinations(range(len(items)), 2):
        dot = float(m[:, a] @ m[:, b])
        if dot != 0.0:
            out[(items[a], items[b])] = dot / np.sqrt(norms[a] * norms[b])
    return out


def random_ratings(n_users, n_items, density, seed=0, hot_user=None, hot_share=0.0):
    rng = np.random.default_rng(seed)
    rows = []
    for u in range(n_users):
        for i in range(n_items):
            if rng.random() < density:
                rows.append((u, i, float(rng.integers(1, 6))))
    if hot_user is not None:
        have = {(u, i) for u, i, _ in rows}
        target = int(hot_share * len(rows) / (1 - hot_share)) if hot_share < 1 else n_items
        for i in range(min(n_items, target)):
            if (hot_user, i) not in have:
                rows.append((hot_user, i, float(rng.integers(1, 6))))
    return rows
