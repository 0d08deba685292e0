"""Recommendation scores as a rectangular product: rating blocks (users x items) times neighbour blocks (items x candidates).

score(u, c) = sum cos(c, j) r(u, j) / sum cos(c, j) over the neighbours j of c that u rated.  The relational form joins
ratings with neighbour lists and shuffles (user, candidate) sums.  Here users are dealt into blocks of bounded
rating rows and candidates into blocks of bounded number; a rating goes to every candidate block, a neighbour
edge to every user block.  A cell adds the products into dense sums over a slab of its users, takes out what they
have seen and keeps each user's best n, so at most users x n x candidate blocks rows are shuffled for the last window, whatever
the hubs among the items or neighbours.

A user whose ratings exceed what a cell may hold goes through the relational form, which splits over joins.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recsim.operators.gram import RANK_DIGITS
from recsim.session import cut_lineage, ship_by_value

ship_by_value(__name__)

USER_ROWS = 500_000          # rating rows of a user block; a user with more is scored relationally
FOLD_ROWS = 250_000          # the same where test ratings are predicted by folds
CANDIDATES = 4096            # candidates of a block
_SLAB = 1 << 21              # entries of a dense sum
_CHUNK = 1 << 20             # products added per numpy step


def best_per_user(score: np.ndarray, count: np.ndarray, ids: np.ndarray, n: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's best ``n`` scores with ``count`` >= ``least``: score at ``RANK_DIGITS`` digits desc, then id."""
    key = np.where((count >= least) & np.isfinite(score), np.round(score, RANK_DIGITS), -np.inf)
    if key.shape[1] > n:
        floor = np.partition(key, key.shape[1] - n, axis=1)[:, key.shape[1] - n, None]
        rows, cols = np.nonzero((key >= floor) & (key > -np.inf))
    else:
        rows, cols = np.nonzero(key > -np.inf)
    order = np.lexsort((ids[cols], -key[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    return rows[place < n], cols[place < n]


def _cell(n: int, least: int):
    def cell(ratings: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        out = {"userId": [], "movie_i": [], "score": [], "num_neighbors": []}
        users, u = np.unique(ratings["userId"].to_numpy(), return_inverse=True)
        ids, c = np.unique(edges["movie_i"].to_numpy(), return_inverse=True)
        # edges by neighbour j; each rating of j meets its run of edges
        order = np.argsort(edges["movie_j"].to_numpy(), kind="stable")
        ej, ec, cos = edges["movie_j"].to_numpy()[order], c[order], edges["cosine_similarity"].to_numpy()[order]
        by_user = np.argsort(u, kind="stable")
        u, j = u[by_user], ratings["movieId"].to_numpy()[by_user]
        r = ratings["rating"].to_numpy(dtype=np.float64)[by_user]
        first = np.searchsorted(ej, j)
        many = np.searchsorted(ej, j, "right") - first
        seen = np.searchsorted(ids, j)
        is_seen = (seen < len(ids)) & (ids[np.minimum(seen, len(ids) - 1)] == j) if len(ids) else np.zeros(len(j), bool)
        step = max(1, _SLAB // max(1, len(ids)))
        for lo in range(0, len(users) if len(ids) else 0, step):
            a, b = np.searchsorted(u, lo), np.searchsorted(u, lo + step)
            width = min(step, len(users) - lo)
            num, den, cnt = (np.zeros(width * len(ids)) for _ in range(3))
            total = np.cumsum(many[a:b])
            i = a
            while i < b:
                base = total[i - a - 1] if i > a else 0
                e = max(int(np.searchsorted(total, base + _CHUNK, "right")) + a, i + 1)
                m = many[i:e]
                row = np.repeat(np.arange(i, e), m)
                at = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(m) - m, m)
                key = (u[row] - lo) * len(ids) + ec[at]
                num += np.bincount(key, weights=cos[at] * r[row], minlength=len(num))
                den += np.bincount(key, weights=cos[at], minlength=len(num))
                cnt += np.bincount(key, minlength=len(num))
                i = e
            hide = np.flatnonzero(is_seen[a:b]) + a
            cnt[(u[hide] - lo) * len(ids) + seen[hide]] = 0
            with np.errstate(divide="ignore", invalid="ignore"):
                score = (num / den).reshape(width, -1)
            cnt = cnt.reshape(width, -1)
            rows, cols = best_per_user(score, cnt, ids, n, least)
            for name, x in (("userId", users[lo + rows]), ("movie_i", ids[cols]), ("score", score[rows, cols]), ("num_neighbors", cnt[rows, cols].astype(np.int64))):
                out[name].append(x)
        return pd.DataFrame({k: np.concatenate(v) if v else np.zeros(0) for k, v in out.items()})

    return cell


def blocked_scores(train: DataFrame, neighbors: DataFrame, top_n: int, min_neighbors: int = 1, *, user_rows: int = USER_ROWS,
                   candidates: int = CANDIDATES) -> tuple[DataFrame, DataFrame | None]:
    """(scores, rest): per user and candidate block the best ``top_n`` unseen candidates (userId, movie_i, score, num_neighbors), for the
    users that fit a block; ``rest`` holds the training rows of the others, None if there are none.

    ``train`` has one row per (userId, movieId); ``neighbors`` one per (movie_i, movie_j).  ``min_neighbors`` >= 1.
    Two small aggregates (rows and users; candidates) reach the driver.
    """
    spark = train.sparkSession
    degrees = cut_lineage(train.groupBy("userId").agg(F.count(F.lit(1)).alias("_d")), "user-degrees")
    rows, heavy = degrees.agg(F.coalesce(F.sum(F.when(F.col("_d") <= user_rows, F.col("_d"))), F.lit(0)),
                              F.count_if(F.col("_d") > user_rows)).first()
    items = neighbors.agg(F.count_distinct("movie_i")).first()[0]
    u_blocks = max(-(-rows // user_rows), min(2 * spark.sparkContext.defaultParallelism, -(-rows // 1000)), 1)
    c_blocks = max(1, -(-items // candidates))
    fits = train
    if heavy:
        large = degrees.where(F.col("_d") > user_rows).select("userId")
        fits = train.join(large, "userId", "left_anti")
        rest = train.join(large, "userId", "left_semi")
    else:
        rest = None
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = fits.select("userId", "movieId", "rating", F.pmod(F.xxhash64("userId"), F.lit(u_blocks)).cast("int").alias("_ub"), each(c_blocks).alias("_cb"))
    right = neighbors.select("movie_i", "movie_j", "cosine_similarity", each(u_blocks).alias("_ub"),
                             F.pmod(F.xxhash64("movie_i"), F.lit(c_blocks)).cast("int").alias("_cb"))
    schema = T.StructType([T.StructField("userId", train.schema["userId"].dataType), T.StructField("movie_i", neighbors.schema["movie_i"].dataType),
                           T.StructField("score", T.DoubleType()), T.StructField("num_neighbors", T.LongType())])
    scores = left.groupBy("_ub", "_cb").cogroup(right.groupBy("_ub", "_cb")).applyInPandas(_cell(top_n, min_neighbors), schema)
    return scores, rest


def _prediction_cell(default_rating: float):
    def cell(ratings: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        users, u = np.unique(ratings["userId"].to_numpy(), return_inverse=True)
        items, item = np.unique(ratings["movieId"].to_numpy(), return_inverse=True)
        r, fold = ratings["rating"].to_numpy(dtype=np.float64), ratings["fold"].to_numpy(dtype=np.int64)
        rated = u * len(items) + item
        order = np.argsort(rated)
        rated = rated[order]
        # the edges of run c and item i one after another; those to an item that no user of the block has rated find nothing
        if len(items):
            place = np.minimum(np.searchsorted(items, edges["movie_j"].to_numpy()), len(items) - 1)
            edges = edges[items[place] == edges["movie_j"].to_numpy()]
        run, of, to = (edges[c].to_numpy() for c in ("cv", "movie_i", "movie_j"))
        at_i = np.searchsorted(items, of)
        known = at_i < len(items)
        known[known] = items[at_i[known]] == of[known]
        group = (run.astype(np.int64) * len(items) + at_i)[known]
        by_group = np.argsort(group, kind="stable")
        group = group[by_group]
        to, cos = np.searchsorted(items, to[known])[by_group], edges["cosine_similarity"].to_numpy()[known][by_group]
        test = np.flatnonzero(ratings["_test"].to_numpy(dtype=bool))
        asked = fold[test] * len(items) + item[test]
        first = np.searchsorted(group, asked)
        many = np.searchsorted(group, asked, "right") - first
        num, den, cnt = (np.zeros(len(test)) for _ in range(3))
        total = np.cumsum(many)
        i = 0
        while i < len(test):
            base = total[i - 1] if i else 0
            e = max(int(np.searchsorted(total, base + _CHUNK // 2, "right")), i + 1)
            row = np.repeat(np.arange(i, e), many[i:e])
            at = first[row] + np.arange(len(row)) - (total - many)[row] + base
            key = u[test[row]] * len(items) + to[at]
            found = np.minimum(np.searchsorted(rated, key), len(rated) - 1)
            has = rated[found] == key
            row, at, found = row[has], at[has], order[found[has]]
            other = fold[found] != fold[test[row]]
            row, at, found = row[other] - i, at[other], found[other]
            num[i:e] = np.bincount(row, weights=cos[at] * r[found], minlength=e - i)
            den[i:e] = np.bincount(row, weights=cos[at], minlength=e - i)
            cnt[i:e] = np.bincount(row, minlength=e - i)
            i = e
        none = (cnt == 0) | (den == 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            predicted = np.where(none, default_rating, num / den)
        return pd.DataFrame({"cv": fold[test].astype(np.int32), "userId": users[u[test]], "movieId": items[item[test]], "true_rating": r[test],
                             "predicted_rating": predicted, "is_fallback": none, "num_neighbors": cnt.astype(np.int64)})

    return cell


def blocked_fold_predictions(rated: DataFrame, neighbors: DataFrame, default_rating: float, *, user_rows: int = FOLD_ROWS,
                             candidates: int = CANDIDATES) -> tuple[DataFrame, DataFrame]:
    """(predictions, rest): the prediction of every rating marked ``_test`` by the neighbours of its own run and the user's ratings of other folds.

    ``rated`` has userId, movieId, rating, fold and _test, one row per user and item; ``neighbors`` cv, movie_i, movie_j, cosine_similarity.
    Ratings meet the neighbour lists in cells, so no (rating, neighbour) row is shuffled.  ``rest`` has the tests that no cell takes:
    those of a user with more than ``user_rows`` ratings, and those with a null item or rating.
    """
    spark = rated.sparkSession
    plain = F.col("userId").isNotNull() & F.col("movieId").isNotNull() & F.col("rating").isNotNull()
    degrees = cut_lineage(rated.groupBy("userId").agg(F.count(F.lit(1)).alias("_d")), "user-degrees")
    rows, heavy = degrees.agg(F.coalesce(F.sum(F.when(F.col("_d") <= user_rows, F.col("_d"))), F.lit(0)),
                              F.count_if(F.col("_d") > user_rows)).first()
    items = neighbors.agg(F.count_distinct("movie_i")).first()[0]
    u_blocks = max(-(-rows // user_rows), min(2 * spark.sparkContext.defaultParallelism, -(-rows // 1000)), 1)
    c_blocks = max(1, -(-items // candidates))
    fits, rest = rated.where(plain), rated.where(F.col("_test") & ~plain)
    if heavy:
        large = degrees.where(F.col("_d") > user_rows).select("userId")
        rest = rest.unionByName(fits.where("_test").join(large, "userId", "left_semi"))
        fits = fits.join(large, "userId", "left_anti")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = (fits.select("userId", "movieId", F.col("rating").cast("double").alias("rating"), "fold", "_test", block("userId", u_blocks).alias("_ub"), each(c_blocks).alias("_cb"))
            .withColumn("_test", F.col("_test") & (F.col("_cb") == block("movieId", c_blocks))))
    right = neighbors.select("cv", "movie_i", "movie_j", "cosine_similarity", each(u_blocks).alias("_ub"), block("movie_i", c_blocks).alias("_cb"))
    schema = T.StructType([T.StructField("cv", T.IntegerType()), T.StructField("userId", rated.schema["userId"].dataType),
                           T.StructField("movieId", rated.schema["movieId"].dataType), T.StructField("true_rating", T.DoubleType()),
                           T.StructField("predicted_rating", T.DoubleType()), T.StructField("is_fallback", T.BooleanType()), T.StructField("num_neighbors", T.LongType())])
    found = left.groupBy("_ub", "_cb").cogroup(right.groupBy("_ub", "_cb")).applyInPandas(_prediction_cell(float(default_rating)), schema)
    return found, rest


def relational_scores(train: DataFrame, neighbors: DataFrame, min_neighbors: int = 1, by: Sequence[str] = ()) -> DataFrame:
    """(userId, movie_i, score, num_neighbors) of every unseen candidate, by joins."""
    by = list(by)
    rated = train.select(*by, "userId", F.col("movieId").alias("movie_j"), "rating")
    cand = rated.join(neighbors.select(*by, "movie_i", "movie_j", "cosine_similarity"), [*by, "movie_j"])
    scores = cand.groupBy(*by, "userId", "movie_i").agg(
        F.try_divide(F.sum(F.col("cosine_similarity") * F.col("rating")), F.sum("cosine_similarity")).alias("score"),
        F.count(F.lit(1)).alias("num_neighbors"))
    seen = train.select(*by, "userId", F.col("movieId").alias("movie_i"))
    return (scores.where((F.col("num_neighbors") >= min_neighbors) & F.col("score").isNotNull())
            .join(seen, [*by, "userId", "movie_i"], "left_anti"))
