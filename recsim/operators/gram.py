"""Blocked Gram product: dot(i, j) = sum over users u of r(u, i) * r(u, j).

The shared kernel of exact cosine similarity and of the bucket-restricted
LSH verification.  The textbook relational form, a self join of the rating
table on the user, emits one row per co-rated pair *per user*: a user holding
a third of all ratings would push (N/3)^2 rows through one join key.  Here:

* items are hashed into V virtual blocks; one aggregate pass writes the
  per-item statistics (count, squared norm) and a small layout table follows
  from them: ``n_sub`` = ceil(items / item_block) sub-blocks per group (unions
  of virtual blocks) and ``ceil(rows / side_rows)`` user stripes per sub-block,
  so a hot item is spread over many stripes too; a cell (stripe, lo, hi) uses
  the larger stripe count of its two blocks;
* a rating of block ``b`` is sent to the cell (stripe, min(b, o), max(b, o))
  for every non-empty partner block ``o`` (replication factor ``n_sub``);
* each cell multiplies its two sparse blocks inside one pandas task, either
  as dense BLAS (dense data) or as a chunked sparse expansion, both in column
  slabs of bounded size, whichever costs less.  A heavy user is one matrix row; per-user pairs never
  become rows;
* every rating carries its item's squared norm, so a cell also emits the
  product of the norms; Spark sums the dot products of the stripes (map-side
  partial aggregation, skipped when every block has one stripe) and divides
  once, and the pair table is never joined back to the norms.

The only values that reach the driver are the maximum stripe count (one
number) and the parallelism target; everything else stays in Spark.
Per-task memory and work are bounded by ``item_block`` and ``side_rows`` for
any skew of users or items.

Large sparse tables without groups, where a user has rated few of the items, go by ``histories`` instead: there a
rating is sent only to blocks its user has rated, and every sum is final in its cell.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recsim.operators import histories as H
from recsim.session import cut_lineage, ship_by_value

# The cell functions run in Python workers: ship them by value so executors do
# not need this package on their import path.
ship_by_value(__name__)

DEFAULT_ITEM_BLOCK = 8192
DEFAULT_SIDE_ROWS = 1_000_000
DEFAULT_VIRTUAL_BLOCKS = 8192   # fine hash buckets of items; sub-blocks are unions of them
_CHUNK = 1 << 18          # products expanded per numpy step in the sparse kernel
_DENSE_MAX = 1 << 24      # users x items of a block up to which a cell may go dense
_DENSE_SIDE = 1 << 20     # entries (8 MB) of a dense operand: so many users at once
_MIN_BLOCK = 64           # smallest sub-block the parallelism floor may create
_DENSE_ACC = 1 << 20      # largest dense accumulator (entries, 8 MB); larger products go slab by slab
_PIECE = 1 << 17          # entries of a slab that leave a cell at once
_ZERO = 1e-12             # cosines up to this size are rounding of a zero dot product
RANK_DIGITS = 9           # cosines are ranked at so many digits, so equal ones tie whatever the layout


def _joined(slabs):
    parts = list(zip(*slabs))
    if not parts:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
    return tuple(np.concatenate(x) for x in parts)


def _sparse_gram(*triplets, upper: bool = False):
    """``_sparse_slabs`` in one piece."""
    return _joined(_sparse_slabs(*triplets, upper=upper))


def _dense_gram(*triplets, upper: bool = False):
    """``_dense_slabs`` in one piece."""
    return _joined(_dense_slabs(*triplets, upper=upper))


def _sparse_slabs(ua, ia, va, ub, ib, vb, n_users, na, nb, upper: bool = False, floor=None):
    """sum_u a_u^T b_u from (user, column, value) triplets, as COO (rows, cols, values) per slab of columns.

    The product is formed in column slabs of at most ``_DENSE_ACC`` entries.  Within a slab the
    users' outer products are expanded in chunks of about ``_CHUNK`` products and added to one
    dense accumulator, so beside the result memory is flat whatever the users hold.
    ``upper`` keeps only row < col (diagonal cells); ``floor`` (the rows' and the columns' share of a bound) only values
    above the product of both shares.
    """
    ua, ia, va = _by_user(ua, ia, va)
    ub, ib, vb = _by_user(ub, ib, vb)
    step = max(1, _DENSE_ACC // max(na, 1))
    for c0 in range(0, nb, step):
        width = min(step, nb - c0)
        inside = (ib >= c0) & (ib < c0 + width)
        us, cs, vs = ub[inside], ib[inside] - c0, vb[inside]
        count = np.bincount(us, minlength=n_users)
        first = np.cumsum(count) - count
        rep = count[ua]
        cum = np.cumsum(rep)
        acc = np.zeros(na * width)
        start, n = 0, len(ua)
        while start < n:
            base = cum[start - 1] if start else 0
            end = max(int(np.searchsorted(cum, base + _CHUNK, side="right")), start + 1)
            r = rep[start:end]
            tot = int(r.sum())
            if tot:
                ka = np.repeat(np.arange(start, end), r)
                kb = first[ua[ka]] + np.arange(tot) - np.repeat(np.cumsum(r) - r, r)
                np.add.at(acc, ia[ka] * width + cs[kb], va[ka] * vs[kb].astype(np.float64))
            start = end
        yield _above(acc.reshape(na, width), c0, upper, floor)


def _by_user(u, i, v):
    """Triplets in the order of their users."""
    if np.all(u[1:] >= u[:-1]):
        return u, i, v
    order = np.argsort(u, kind="stable")
    return u[order], i[order], v[order]


def _above(g, c0: int, upper: bool, floor):
    """The entries of a slab that stay."""
    if floor is None:
        rows, cols = np.nonzero(g)
    else:
        rows, cols = np.nonzero(g > floor[0][:, None] * floor[1][None, c0:c0 + g.shape[1]])
    vals, cols = g[rows, cols], cols + c0
    if upper:
        keep = rows < cols
        rows, cols, vals = rows[keep], cols[keep], vals[keep]
    return rows, cols, vals


def _dense_slabs(ua, ia, va, ub, ib, vb, n_users, na, nb, upper: bool = False, floor=None):
    """Same result as ``_sparse_slabs`` through BLAS on dense operands of ``_DENSE_SIDE`` entries, some users at a time; the
    product is formed in column slabs so the result never exceeds ``_DENSE_ACC`` entries."""
    some = max(1, _DENSE_SIDE // max(na, nb, 1))
    if some < n_users:
        ua, ia, va = _by_user(ua, ia, va)
        ub, ib, vb = _by_user(ub, ib, vb)
    edges = list(range(0, n_users, some)) + [n_users]
    at_a, at_b = ([0, len(u)] if some >= n_users else np.searchsorted(u, edges) for u in (ua, ub))

    def dense(u, i, v, at, c, n):
        x = np.zeros((min(some, n_users - edges[c]), n))
        part = slice(at[c], at[c + 1])
        x[u[part] - edges[c], i[part]] = v[part]
        return x

    step = max(1, _DENSE_ACC // max(na, 1))
    for c0 in range(0, nb, step):
        g = np.zeros((na, min(step, nb - c0)))
        for c in range(len(edges) - 1):
            xa = dense(ua, ia, va, at_a, c, na)
            xb = xa if upper else dense(ub, ib, vb, at_b, c, nb)
            g += xa.T @ xb[:, c0:c0 + step]
        yield _above(g, c0, upper, floor)


def _pieces(slabs):
    for slab in slabs:
        for at in range(0, max(len(slab[0]), 1), _PIECE):
            yield tuple(x[at:at + _PIECE] for x in slab)


def _cell_top_k(a, b, cos, k):
    """Directed edges (src, dst, cos) keeping each source's best k by cos (at
    ``RANK_DIGITS`` digits) desc, dst asc."""
    return _best_k(np.concatenate((a, b)), np.concatenate((b, a)), np.concatenate((cos, cos)), k)


def _best_k(src, dst, c, k):
    order = np.lexsort((dst, -np.round(c, RANK_DIGITS), src))
    src, dst, c = src[order], dst[order], c[order]
    if len(src) == 0:
        return src, dst, c
    starts = np.r_[0, np.flatnonzero(np.diff(src)) + 1]
    rank = np.arange(len(src)) - np.repeat(starts, np.diff(np.r_[starts, len(src)]))
    keep = rank < k
    return src[keep], dst[keep], c[keep]


def _gathered(batches: Iterator[pd.DataFrame], blocks: Sequence[int]) -> tuple[int, list[tuple]]:
    """The number of users of a cell and, per block, (items, their squared norms, triplets), read batch by batch: users and
    items as 32-bit places, ratings as narrow as they are exact, so that no whole frame of the group stands beside them."""
    held = [[] for _ in blocks]
    for batch in batches:
        user, item, blk = (batch[name].to_numpy() for name in ("userId", "movieId", "_blk"))
        rating, norm2 = (batch[name].to_numpy(dtype=np.float64) for name in ("rating", "_norm2"))
        for side, b in zip(held, blocks):
            mine = np.flatnonzero(blk == b)
            if len(mine):
                ids, first, column = np.unique(item[mine], return_index=True, return_inverse=True)
                side.append((user[mine], ids, norm2[mine][first], column.astype(np.int32), H._narrow(rating[mine])))
    users = np.unique(np.concatenate([part[0] for side in held for part in side]))
    sides = []
    for side in held:
        if not side:                                           # a stripe may lack one of its blocks
            sides.append((users[:0], np.zeros(0), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0)))
            continue
        ids, first = np.unique(np.concatenate([part[1] for part in side]), return_index=True)
        norms = np.concatenate([part[2] for part in side])[first]
        column = np.concatenate([np.searchsorted(ids, part[1]).astype(np.int32)[part[3]] for part in side])
        rating = np.concatenate([part[4] for part in side])
        place = np.concatenate([np.searchsorted(users, part[0]).astype(np.int32) for part in side])
        side.clear()
        sides.append((ids, norms, place, column, rating))
    return len(users), sides


def _cell_function(group_cols: Sequence[str], final: bool, top_k: int | None = None, min_cosine: float | None = None):
    """The product of one cell, slab by slab.  ``final`` cells (one stripe) give cosines, others their share of the
    dot product and the product of the squared norms, to be divided once after the stripe sum."""
    def frame(keys: list, **columns) -> pd.DataFrame:
        return pd.DataFrame({c: np.repeat(key, len(columns["movie_i"])) for c, key in zip(group_cols, keys)} | columns)

    def cell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one = next(batches)
        lo, hi, keys = int(one["_lo"].iat[0]), int(one["_hi"].iat[0]), [one[c].iat[0] for c in group_cols]
        nu, sides = _gathered(itertools.chain([one], batches), (lo, hi)[:1 + (lo != hi)])
        (ids_a, norm_a, ua, ca, va), (ids_b, norm_b, ub, cb, vb) = sides[0], sides[-1]
        na, nb = len(ids_a), len(ids_b)
        # cost of the two kernels: dense flops vs expanded (user, a, b) products
        per_user_a = np.bincount(ua, minlength=nu)
        per_user_b = per_user_a if lo == hi else np.bincount(ub, minlength=nu)
        expanded = float(np.dot(per_user_a.astype(np.float64), per_user_b))
        dense_flops = float(nu) * na * nb
        kernel = _dense_slabs if nu * max(na, nb) <= _DENSE_MAX and dense_flops < 64.0 * expanded else _sparse_slabs
        floor = None
        if final and min_cosine is not None and min_cosine > 0:        # a little below the bound; what passes is tested as it is
            floor = (min_cosine * (1 - 1e-9) * np.sqrt(norm_a), np.sqrt(norm_b))
        best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        slabs = kernel(ua, ca, va, ub, cb, vb, nu, na, nb, upper=(lo == hi), floor=floor)
        if not final or top_k is None:
            slabs = _pieces(slabs)
        for ii, jj, dots in slabs:
            a, b, norms = ids_a[ii].astype(np.int64), ids_b[jj].astype(np.int64), norm_a[ii] * norm_b[jj]
            if not final:
                yield frame(keys, movie_i=np.minimum(a, b), movie_j=np.maximum(a, b), _dot=dots, _norms=norms)
                continue
            cos = np.clip(dots / np.sqrt(norms), -1.0, 1.0)
            keep = np.abs(cos) > _ZERO
            if min_cosine is not None:
                keep &= cos > min_cosine
            a, b, cos = a[keep], b[keep], cos[keep]
            if top_k is None:
                yield frame(keys, movie_i=np.minimum(a, b), movie_j=np.maximum(a, b), cosine_similarity=cos)
            else:
                best = _best_k(*(np.concatenate(x) for x in zip(best, (a, b, cos), (b, a, cos))), top_k)
        if final and top_k is not None:
            yield frame(keys, movie_i=best[0], movie_j=best[1], cosine_similarity=best[2])

    return cell


def _history_cell(blocks: int, side_rows: int, top_k: int | None, min_cosine: float | None):
    """All pairs of a block's items, each in one block only, or with ``top_k`` the best partners of the block's items."""
    half = top_k is None

    def cell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, one = H.Sums(), next(batches)
        own = int(one["cell"].iat[0])
        bodies = itertools.chain(one.pop("body"), (body for batch in batches for body in batch["body"]))
        for stripe in H.stripes(bodies, side_rows):
            for a, b, (items, rating, norm2) in H.products(stripe, own, blocks, half):
                sums.add(H.summed(items[a], items[b], [rating[a] * rating[b]], [norm2[a] * norm2[b]]))
        i, j, dots, norms = sums.settle()
        if not len(i):
            return
        cos = np.clip(dots[0] / np.sqrt(norms[0]), -1.0, 1.0)
        keep = np.abs(cos) > _ZERO
        if min_cosine is not None:
            keep &= cos > min_cosine
        i, j, cos = i[keep], j[keep], cos[keep]
        if half:
            i, j = np.minimum(i, j), np.maximum(i, j)
        else:
            i, j, cos = _best_k(i, j, cos, top_k)
        yield from H.frames(movie_i=i, movie_j=j, cosine_similarity=cos)

    return cell


def item_stats(ratings: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """Per (group, item): rating count and squared norm (partial aggregation map-side)."""
    return ratings.where(F.col("rating") != 0).groupBy(*group_cols, "movieId").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.col("rating") * F.col("rating")).alias("_norm2"))


def _vblk(virtual_blocks: int):
    return F.pmod(F.xxhash64("movieId"), F.lit(virtual_blocks)).cast("int")


def block_map(stats: DataFrame, group_cols: Sequence[str] = (), *, item_block: int = DEFAULT_ITEM_BLOCK,
              side_rows: int = DEFAULT_SIDE_ROWS, virtual_blocks: int = DEFAULT_VIRTUAL_BLOCKS,
              min_sub: int = 1) -> DataFrame:
    """Small table (group, _vblk) -> (_blk, _nsub, _s): the block layout of every group.

    From the per-item statistics: rows and items per virtual block (hash(item)
    % V), n_sub = ceil(items / item_block) sub-blocks per group (unions of
    virtual blocks: sub-block = virtual block % n_sub), and ``_s`` =
    ceil(rows / side_rows) user stripes per sub-block.  ``min_sub`` raises the
    sub-block count for parallelism (blocks keep at least ``_MIN_BLOCK`` items).
    At most groups x V rows; Spark broadcasts it if its written size allows.
    """
    g = list(group_cols)
    vb = stats.groupBy(*g, _vblk(virtual_blocks).alias("_vblk")).agg(
        F.sum("_n").alias("_rows"), F.count(F.lit(1)).alias("_items"))
    items = F.sum("_items")
    floor = F.least(F.lit(min_sub), F.ceil(items / F.lit(_MIN_BLOCK)))
    nsub = F.greatest(F.lit(1), F.ceil(items / F.lit(item_block)), floor)
    if g:
        laid = vb.join(vb.groupBy(*g).agg(nsub.cast("int").alias("_nsub")), g)
    else:   # one group: the count is a scalar subquery
        laid = vb.withColumn("_nsub", vb.agg(nsub.cast("int")).scalar())
    laid = laid.withColumn("_blk", F.pmod(F.col("_vblk"), F.col("_nsub")).cast("int"))
    stripes = laid.groupBy(*g, "_blk").agg(
        F.greatest(F.lit(1), F.ceil(F.sum("_rows") / F.lit(side_rows))).cast("int").alias("_s"))
    return laid.join(stripes, [*g, "_blk"]).select(*g, "_vblk", "_blk", "_nsub", "_s")


def gram_products(ratings: DataFrame, group_cols: Sequence[str] = (), *, item_block: int = DEFAULT_ITEM_BLOCK,
                  side_rows: int = DEFAULT_SIDE_ROWS, virtual_blocks: int = DEFAULT_VIRTUAL_BLOCKS,
                  top_k: int | None = None, min_cosine: float | None = None) -> DataFrame:
    """(group..., movie_i, movie_j, cosine_similarity) for item pairs i < j sharing a group, those above ``min_cosine`` if given.

    With ``top_k`` the result is instead a *directed* edge list that contains, for
    every item, at least its ``top_k`` best partners above ``min_cosine`` (cosine
    desc, partner id asc) - a superset for a final per-item window.  When every
    block has one stripe the cells prune to their own top_k per item, so at most
    (|A| + |B|) * top_k edges leave a cell instead of |A| * |B| pairs.

    ``ratings`` needs ``userId, movieId, rating`` plus ``group_cols``; an item
    may belong to several groups (one row per membership).  Pairs with a zero
    dot product (no co-rater) are not returned.  The input is read twice: once
    for the per-item statistics (norms and the block layout; runs one job that
    writes them to the checkpoint folder, and one tiny job over the layout),
    once for the product; the pair table is never joined again.  When every
    block has a single user stripe each pair comes out of exactly one cell and
    the stripe-sum shuffle is skipped.  Either way the dot products are summed
    first and divided, tested for zero and clipped to [-1, 1] once, so the layout
    does not show in the result (fractional ratings: beyond rounding, which
    ``RANK_DIGITS`` hides from the ranking).
    """
    g = list(group_cols)
    # Without groups, ask for enough sub-blocks to give every core about two cells.
    min_sub = 1
    if not g:
        target = 2 * ratings.sparkSession.sparkContext.defaultParallelism
        while min_sub * (min_sub + 1) // 2 < target:
            min_sub += 1
    # One job: the per-item statistics (one row per item and group) are written to
    # the shared checkpoint folder, so the layout's branches read that small table
    # instead of re-aggregating the ratings each time.
    stats = cut_lineage(item_stats(ratings, g), "item-stats")
    # virtual blocks enough to cut the largest group into sub-blocks of item_block items
    most = stats.groupBy(*g).count().agg(F.max("count")).first()[0] or 0
    virtual_blocks = max(virtual_blocks, 8 * -(-most // item_block))
    if not g:       # sparse ratings: histories instead of cells of two blocks
        rows, items, hottest = stats.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.count(F.lit(1)), F.max("_n")).first()
        n_sub = max(min_sub, -(-items // item_block))
        rated = ratings.where(F.col("rating") != 0).select("userId", "movieId", F.col("rating").cast("double").alias("rating"))
        found = H.blocks_for(rated, items, hottest, n_sub, side_rows, rows * n_sub)
        if found:
            return H.by_cells(rated.join(stats.select("movieId", "_norm2"), "movieId"), ["rating", "_norm2"], found, top_k is None,
                              _history_cell(found.blocks, side_rows, top_k, min_cosine),
                              "movie_i long, movie_j long, cosine_similarity double", "history-pairs")
    layout = block_map(stats, g, item_block=item_block, side_rows=side_rows, virtual_blocks=virtual_blocks,
                       min_sub=min_sub)
    layout = cut_lineage(layout, "gram-layout")     # small: at most groups x V rows
    single_stripe = (layout.agg(F.max("_s")).first()[0] or 1) == 1
    stripes = layout.select(*g, F.col("_blk").alias("_other"), F.col("_s").alias("_s2")).distinct()
    rep = (ratings.where(F.col("rating") != 0)
           .select(*g, "userId", "movieId", "rating")
           # per-item norms: one row per item; AQE broadcasts it when it is small
           .join(stats.select(*g, "movieId", "_norm2"), [*g, "movieId"])
           .withColumn("_vblk", _vblk(virtual_blocks))
           .join(layout, [*g, "_vblk"])
           .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_nsub") - 1)))
           # partner blocks without ratings drop out here
           .join(stripes, [*g, "_other"])
           .select(*g, "userId", "movieId", "rating", "_norm2", "_blk",
                   F.pmod(F.xxhash64("userId"), F.greatest("_s", "_s2")).cast("int").alias("_stripe"),
                   F.least("_blk", "_other").alias("_lo"), F.greatest("_blk", "_other").alias("_hi")))
    gfields = sorted((f for f in ratings.schema.fields if f.name in g), key=lambda f: g.index(f.name))
    ends = [T.StructField("movie_i", T.LongType()), T.StructField("movie_j", T.LongType())]
    cells = rep.groupBy(*g, "_stripe", "_lo", "_hi")
    if single_stripe:
        schema = T.StructType(gfields + ends + [T.StructField("cosine_similarity", T.DoubleType())])
        return cells.applyInPandas(_cell_function(g, True, top_k, min_cosine), schema)
    shares = [T.StructField("_dot", T.DoubleType()), T.StructField("_norms", T.DoubleType())]
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("_dot") / F.sqrt("_norms")))
    summed = (cells.applyInPandas(_cell_function(g, False), T.StructType(gfields + ends + shares))
              .groupBy(*g, "movie_i", "movie_j").agg(F.sum("_dot").alias("_dot"), F.max("_norms").alias("_norms"))
              .select(*g, "movie_i", "movie_j", cosine.alias("cosine_similarity"))
              .where(F.abs("cosine_similarity") > _ZERO))
    if min_cosine is not None:
        summed = summed.where(F.col("cosine_similarity") > F.lit(float(min_cosine)))
    if top_k is None:
        return summed
    both = F.explode(F.array(
        F.struct(F.col("movie_i").alias("a"), F.col("movie_j").alias("b")),
        F.struct(F.col("movie_j").alias("a"), F.col("movie_i").alias("b")))).alias("_e")
    return summed.select(*g, both, "cosine_similarity").select(
        *g, F.col("_e.a").alias("movie_i"), F.col("_e.b").alias("movie_j"), "cosine_similarity")
