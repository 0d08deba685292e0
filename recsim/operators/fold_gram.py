"""One Gram product for all folds of a cross-validation.

Run c of a k-fold cross-validation trains on the ratings outside fold c.  The product of two ratings counts in
every run but those of its two folds, so one product over all ratings serves every run: run c is the
total less what touches fold c.  Each rating enters the blocked product of ``gram`` once, with its
fold; the shuffle of ratings does not depend on k.  The items' counts and norms per run come to
the cells in a table of their own, one row per item and cell.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recsim.operators import gram as K
from recsim.operators.similarity import symmetric_pairs, topk_neighbors
from recsim.session import cut_lineage, ship_by_value

ship_by_value(__name__)


def fold_products(ua, ia, va, fa, ub, ib, vb, fb, n_users, na, nb, k):
    """Yields (first column, dots): for a slab of columns the dot products of each run, as an array (run, row, column).

    Ratings are (user, column, value, fold 0..k-1).  Small dense operands multiply once per run by BLAS; else the users' products are
    expanded once, and each is added to the total and to what touches its folds."""
    step = max(1, 4 * K._DENSE_ACC // max(1, na * (k + 1)))
    expanded = float(np.dot(np.bincount(ua, minlength=n_users).astype(np.float64), np.bincount(ub, minlength=n_users)))
    dense = n_users * max(na, nb) <= K._DENSE_MAX // 4 and k * float(n_users) * na * nb < 64.0 * expanded
    if dense:
        xa, ya = np.zeros((n_users, na)), np.full((n_users, na), -1, np.int16)
        xa[ua, ia], ya[ua, ia] = va, fa
        xb, yb = np.zeros((n_users, nb)), np.full((n_users, nb), -1, np.int16)
        xb[ub, ib], yb[ub, ib] = vb, fb
        for c0 in range(0, nb, step):
            part = slice(c0, c0 + step)
            yield c0, np.stack([np.where(ya == c, 0, xa).T @ np.where(yb[:, part] == c, 0, xb[:, part]) for c in range(k)])
        return
    oa, ob = np.argsort(ua, kind="stable"), np.argsort(ub, kind="stable")
    ua, ia, va, fa = ua[oa], ia[oa], va[oa], fa[oa]
    ub, ib, vb, fb = ub[ob], ib[ob], vb[ob], fb[ob]
    for c0 in range(0, nb, step):
        width = min(step, nb - c0)
        inside = (ib >= c0) & (ib < c0 + width)
        us, cs, vs, fs = ub[inside], ib[inside] - c0, vb[inside], fb[inside]
        count = np.bincount(us, minlength=n_users)
        first = np.cumsum(count) - count
        rep = count[ua]
        cum = np.cumsum(rep)
        size = na * width
        total, touch = np.zeros(size), np.zeros(k * size)
        start = 0
        while start < len(ua):
            base = cum[start - 1] if start else 0
            end = max(int(np.searchsorted(cum, base + 4 * K._CHUNK, side="right")), start + 1)
            r = rep[start:end]
            if r.sum():
                a = np.repeat(np.arange(start, end), r)
                b = first[ua[a]] + np.arange(len(a)) - np.repeat(np.cumsum(r) - r, r)
                at, product = ia[a] * width + cs[b], va[a] * vs[b]
                total += np.bincount(at, weights=product, minlength=size)
                touch += np.bincount(fa[a] * size + at, weights=product, minlength=k * size)
                other = fs[b] != fa[a]
                touch += np.bincount(fs[b][other] * size + at[other], weights=product[other], minlength=k * size)
            start = end
        yield c0, (total[None] - touch.reshape(k, size)).reshape(k, na, width)


def _cell_function(k: int, final: bool, top_k: int | None, min_cosine: float | None):
    def cell(pdf: pd.DataFrame, norms: pd.DataFrame) -> pd.DataFrame:
        names = ["cv", "movie_i", "movie_j"] + (["cosine_similarity"] if final else ["_dot", "_norms"])
        got = {name: [] for name in names}
        if len(pdf):
            lo, hi = int(pdf["_lo"].iat[0]), int(pdf["_hi"].iat[0])
            users, u = np.unique(pdf["userId"].to_numpy(), return_inverse=True)
            blk, item, fold = pdf["_blk"].to_numpy(), pdf["movieId"].to_numpy(), pdf["fold"].to_numpy() - 1
            value = pdf["rating"].to_numpy(dtype=np.float64)
            known = norms["movieId"].to_numpy()
            order = np.argsort(known, kind="stable")
            known, norm2 = known[order], np.array(norms["_run_norm2"].tolist(), np.float64).reshape(len(known), k)[order]
            sides = []
            for b in (lo, hi):
                m = blk == b
                ids, col = np.unique(item[m], return_inverse=True)
                sides.append((ids, norm2[np.searchsorted(known, ids)], (u[m], col, value[m], fold[m])))
            (ids_a, norm_a, a), (ids_b, norm_b, b) = sides
            for c0, dots in fold_products(*a, *b, len(users), len(ids_a), len(ids_b), k):
                for c in range(k):
                    rows, cols = np.nonzero(dots[c])
                    dot, cols = dots[c][rows, cols], cols + c0
                    product = norm_a[rows, c] * norm_b[cols, c]                # 0 where an item lacks support in the run
                    keep = (product > 0) & ((rows < cols) if lo == hi else True)
                    rows, cols, dot, product = rows[keep], cols[keep], dot[keep], product[keep]
                    i, j = ids_a[rows], ids_b[cols]
                    if final:
                        cos = np.clip(dot / np.sqrt(product), -1.0, 1.0)
                        keep = np.abs(cos) > K._ZERO
                        if min_cosine is not None:
                            keep &= cos > min_cosine
                        i, j, cos = i[keep], j[keep], cos[keep]
                        if top_k is not None:
                            i, j, cos = K._cell_top_k(i, j, cos, top_k)
                        values = (i, j, cos)
                    else:
                        values = (np.minimum(i, j), np.maximum(i, j), dot, product)
                    for name, x in zip(names, (np.full(len(i), c + 1, np.int32), *values)):
                        got[name].append(x)
        return pd.DataFrame({name: np.concatenate(x) if x else np.zeros(0) for name, x in got.items()})

    return cell


def fold_topk_neighbors(folded: DataFrame, k: int, top_k: int, *, min_ratings: int, min_cosine: float | None = None,
                        item_block: int = K.DEFAULT_ITEM_BLOCK, side_rows: int = K.DEFAULT_SIDE_ROWS) -> DataFrame:
    """(cv, movie_i, movie_j, cosine_similarity): the top-``top_k`` neighbours of every run 1..k over the items with at least
    ``min_ratings`` ratings in the run's training part.

    ``folded`` has userId, movieId, rating and fold (1..k), one row per user and item.  Same result as the exact neighbours of the
    k training parts, from one product.
    """
    spark = folded.sparkSession
    r = folded.where(F.col("rating") != 0).select("userId", "movieId", F.col("rating").cast("double").alias("rating"), F.col("fold").cast("int").alias("fold"))
    square = F.col("rating") * F.col("rating")
    out_n = [(F.count(F.lit(1)) - F.count_if(F.col("fold") == c)).alias(f"_n{c}") for c in range(1, k + 1)]
    out_s = [(F.sum(square) - F.coalesce(F.sum(F.when(F.col("fold") == c, square)), F.lit(0.0))).alias(f"_s{c}") for c in range(1, k + 1)]
    runs = F.array(*[F.when((F.col(f"_n{c}") >= min_ratings) & (F.col(f"_s{c}") > 0), F.col(f"_s{c}")).otherwise(F.lit(0.0)) for c in range(1, k + 1)])
    stats = cut_lineage(r.groupBy("movieId").agg(F.count(F.lit(1)).alias("_n"), F.sum(square).alias("_norm2"), *out_n, *out_s)
                        .select("movieId", "_n", "_norm2", runs.alias("_run_norm2")).where(F.exists("_run_norm2", lambda x: x > 0)), "fold-stats")
    target, min_sub = 2 * spark.sparkContext.defaultParallelism, 1
    while min_sub * (min_sub + 1) // 2 < target:
        min_sub += 1
    items = stats.count()
    virtual = max(K.DEFAULT_VIRTUAL_BLOCKS, 8 * -(-items // item_block))
    layout = cut_lineage(K.block_map(stats, item_block=item_block, side_rows=side_rows, virtual_blocks=virtual, min_sub=min_sub), "fold-layout")
    single = (layout.agg(F.max("_s")).first()[0] or 1) == 1
    others = layout.select(F.col("_blk").alias("_other"), F.col("_s").alias("_s2")).distinct()

    def dealt(df: DataFrame) -> DataFrame:
        return (df.withColumn("_vblk", K._vblk(virtual)).join(layout, "_vblk").withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_nsub") - 1)))
                .join(others, "_other").withColumn("_lo", F.least("_blk", "_other")).withColumn("_hi", F.greatest("_blk", "_other"))
                .withColumn("_of", F.greatest("_s", "_s2")))

    ratings = (dealt(r.join(stats.select("movieId"), "movieId", "left_semi")).withColumn("_stripe", F.pmod(F.xxhash64("userId"), F.col("_of")).cast("int"))
               .select("userId", "movieId", "rating", "fold", "_blk", "_stripe", "_lo", "_hi"))
    norms = (dealt(stats.select("movieId", "_run_norm2")).withColumn("_stripe", F.explode(F.sequence(F.lit(0), F.col("_of") - 1)))
             .select("movieId", "_run_norm2", "_stripe", "_lo", "_hi"))
    cell = ["_stripe", "_lo", "_hi"]
    ends = [T.StructField("cv", T.IntegerType()), T.StructField("movie_i", T.LongType()), T.StructField("movie_j", T.LongType())]
    last = ["cosine_similarity"] if single else ["_dot", "_norms"]
    schema = T.StructType(ends + [T.StructField(c, T.DoubleType()) for c in last])
    found = ratings.groupBy(*cell).cogroup(norms.groupBy(*cell)).applyInPandas(_cell_function(k, single, top_k, min_cosine), schema)
    if single:
        return topk_neighbors(found, top_k, ["cv"])
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("_dot") / F.sqrt("_norms")))
    summed = (found.groupBy("cv", "movie_i", "movie_j").agg(F.sum("_dot").alias("_dot"), F.max("_norms").alias("_norms"))
              .select("cv", "movie_i", "movie_j", cosine.alias("cosine_similarity")).where(F.abs("cosine_similarity") > K._ZERO))
    if min_cosine is not None:
        summed = summed.where(F.col("cosine_similarity") > F.lit(float(min_cosine)))
    return topk_neighbors(symmetric_pairs(summed, ["cv"]), top_k, ["cv"])
