"""Exact cosine join above a threshold by prefix filtering.

With a threshold t, popular users need no pairing.  All users stand in one order, rarest first.  An
item's *prefix* holds its users up to where what is left of its vector, the *suffix*, is shorter than t of its
norm.  Two items with a cosine of at least t share a user in both prefixes: take the one whose prefix ends
first; if no common user lay in it, their product would come from its suffix alone, and by Cauchy-Schwarz that is
below t.

* The prefixes are an inverted index over each item's rarest users.  Only its lists are paired, so the longest lists, those of
  popular users, hardly count.
* The products of a pair over the index are summed.  The pair goes on only if the sum and an L2 bound on what is left reach t:
  what both items have behind their last common index entry, or what one of the suffixes can add.
* A pair that goes on is completed from the two suffixes, or anew over the item with fewer ratings if that is less.

A user's list is dealt into blocks and every pair of blocks meets in a group of its own, so a hot user's list never is
one group; the prefix ends are running totals over ranges of the user order, so a hot item's ratings never meet in one task.

Where the index holds most products anyhow and the table is large, the same steps run in the cells of ``histories``: there the sums of
a pair are final, so candidates and open pairs are counted but never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recsim.operators import histories as H
from recsim.operators.indexing import running_total
from recsim.session import cut_lineage, ship_by_value

ship_by_value(__name__)

LIST_BLOCK = 2048        # entries of a user's list that meet each other in one group
MOST_RATINGS = 100_000   # of a user whose history goes to cells whole
LIKE = 1.5               # products of all ratings over those of the index, up to which cells take whole histories
_SLACK = 1e-9            # rounding allowed for in the bounds; pairs that pass are computed exactly


@dataclass
class PrefixJoin:
    pairs: DataFrame     # movie_i < movie_j, cosine_similarity, above the threshold
    work: DataFrame      # one row: ratings, indexed, candidates, completed, products_done, products_pruned


def prefix_entries(ratings: DataFrame, min_cosine: float) -> DataFrame:
    """Every rating with its place: (movieId, userId, rating, rest, norm2, n, in_prefix), ``rest`` the squared length of the item's
    vector behind the entry in the user order, ``n`` and ``norm2`` the item's count and squared norm.

    Users are ordered by the binary digits of their number of ratings, then by md5; a range of the order is such a number and
    the first two digits of the md5."""
    users = ratings.groupBy("userId").agg(F.length(F.bin(F.count(F.lit(1)))).alias("_level"))
    square = F.col("rating") * F.col("rating")
    stats = ratings.groupBy("movieId").agg(F.count(F.lit(1)).alias("n"), F.sum(square).alias("norm2"))
    key = F.md5(F.col("userId").cast("string"))         # made where it is needed: no key is written or shuffled with a rating
    placed = ratings.join(users, "userId").withColumn("_range", F.col("_level") * 256 + F.conv(F.substring(key, 1, 2), 16, 10).cast("int")).drop("_level")
    done = running_total(cut_lineage(placed, "user-order"), ["movieId"], "_range", [key, "userId"], {"_before": square})
    left = F.col("norm2") - F.col("_before")
    return done.join(stats, "movieId").select("movieId", "userId", "rating", (left - square).alias("rest"), "norm2", "n",
                                              (left >= F.lit(min_cosine * min_cosine - _SLACK) * F.col("norm2")).alias("in_prefix"))


def index_products(index: DataFrame, list_block: int = LIST_BLOCK) -> DataFrame:
    """(movie_i, movie_j, dot, behind): the products of every pair summed over the index, and the product of the
    squared lengths that both have behind their last common entry."""
    lists = index.groupBy("userId").agg(F.ceil(F.count(F.lit(1)) / list_block).cast("int").alias("_parts"))
    dealt = index.join(lists, "userId").withColumn("_own", F.pmod(F.xxhash64("movieId"), F.col("_parts")).cast("int"))
    side = lambda low, high, s: dealt.select("userId", low, high, *[F.col(c).alias(f"{c}_{s}") for c in ("movieId", "rating", "rest")])
    # group (lo, hi) of a list holds the entries of part lo on one side and those of part hi on the other
    first = side(F.col("_own").alias("_lo"), F.explode(F.sequence(F.col("_own"), F.col("_parts") - 1)).alias("_hi"), "i")
    second = side(F.explode(F.sequence(F.lit(0), F.col("_own"))).alias("_lo"), F.col("_own").alias("_hi"), "j")
    both = first.join(second, ["userId", "_lo", "_hi"]).where((F.col("_lo") < F.col("_hi")) | (F.col("movieId_i") < F.col("movieId_j")))
    return both.groupBy(F.least("movieId_i", "movieId_j").alias("movie_i"), F.greatest("movieId_i", "movieId_j").alias("movie_j")).agg(
        F.sum(F.col("rating_i") * F.col("rating_j")).alias("dot"), F.min(F.col("rest_i") * F.col("rest_j")).alias("behind"))


def prefix_cosine_join(ratings: DataFrame, min_cosine: float, list_block: int = LIST_BLOCK) -> PrefixJoin:
    """All item pairs (movie_i < movie_j) with a cosine strictly above ``min_cosine`` > 0, exactly, and the work it took.

    ``work`` counts the ratings, the entries of the index, the candidate pairs that it gave, those that had to be completed, the
    products of ratings that were multiplied, and those of the plain join (one per user and pair of ratings) that
    were not.  Weights of either sign are allowed.  One rating per user and item.
    """
    if not 0 < min_cosine <= 1:
        raise ValueError("min_cosine must lie above 0 and not above 1")
    rated = ratings.where(F.col("rating") != 0).select("userId", "movieId", F.col("rating").cast("double").alias("rating"))
    entries = cut_lineage(prefix_entries(rated, min_cosine), "prefixes")
    index = entries.where("in_prefix").select("movieId", "userId", "rating", "rest")
    items = cut_lineage(entries.groupBy("movieId").agg(F.first("norm2").alias("norm2"), F.first("n").alias("n"), F.count_if(~F.col("in_prefix")).alias("tail"),
                                                       F.min(F.when(F.col("in_prefix"), F.col("rest"))).alias("over")), "items")
    side = lambda s: items.select(*[F.col(c).alias(f"{c}_{s}" if c != "movieId" else f"movie_{s}") for c in items.columns])
    sizes = items.agg(F.count(F.lit(1)), F.coalesce(F.max("n"), F.lit(0))).first()
    per_user = cut_lineage(entries.groupBy("userId").agg(F.count(F.lit(1)).alias("_d"), F.count_if("in_prefix").alias("_p")), "lists")
    every, paired = per_user.agg(F.coalesce(F.sum(F.col("_d") * F.col("_d")), F.lit(0)), F.coalesce(F.sum(F.col("_p") * F.col("_p")), F.lit(0))).first()
    layout = H.blocks_for(entries, sizes[0], sizes[1], 1, MOST_RATINGS, paired, H.CELL_PRODUCTS // 4) if every <= LIKE * paired else None
    lists = _lists(per_user)
    if layout:
        return _joined_in_cells(entries, items, lists, min_cosine, layout)
    candidates = cut_lineage(index_products(index, list_block), "candidates")
    known = candidates.join(side("i"), "movie_i").join(side("j"), "movie_j")
    root = lambda c: F.sqrt(F.greatest(c, F.lit(0.0)))
    by_suffix = root(F.greatest(F.col("over_i") * F.col("norm2_j"), F.col("over_j") * F.col("norm2_i")))
    more: Column = F.least(root(F.col("behind")), by_suffix)
    norms = F.col("norm2_i") * F.col("norm2_j")
    open_ = cut_lineage(known.where(F.col("dot") + more >= F.lit(min_cosine - _SLACK) * F.sqrt(norms)).withColumn("norms", norms)
                        .withColumn("anew", F.col("tail_i") + F.col("tail_j") > F.least("n_i", "n_j"))
                        .select("movie_i", "movie_j", "dot", "norms", "anew", (F.col("n_i") <= F.col("n_j")).alias("i_fewer")), "open-pairs")

    # what the index did not hold: the suffix of i against all of j, and that of j against the prefix of i
    ask = lambda x, y, whole: F.struct(F.col(x).alias("x"), F.col(y).alias("y"), F.lit(whole).alias("whole"))
    asked = F.when(F.col("anew"), F.array(F.when(F.col("i_fewer"), ask("movie_i", "movie_j", True)).otherwise(ask("movie_j", "movie_i", True)))).otherwise(
        F.array(ask("movie_i", "movie_j", True), ask("movie_j", "movie_i", False)))
    asks = open_.select("movie_i", "movie_j", "anew", F.explode(asked).alias("a")).select("movie_i", "movie_j", "anew", "a.*")
    mine = entries.select(F.col("movieId").alias("x"), "userId", F.col("rating").alias("_a"), F.col("in_prefix").alias("_pa"))
    theirs = entries.select(F.col("movieId").alias("y"), "userId", F.col("rating").alias("_b"), F.col("in_prefix").alias("_pb"))
    added = cut_lineage(asks.join(mine, "x").where("anew or not _pa").join(theirs, ["y", "userId"]).where("whole or _pb")
                        .groupBy("movie_i", "movie_j").agg(F.sum(F.col("_a") * F.col("_b")).alias("_more"), F.count(F.lit(1)).alias("_products")), "completed")
    dot = F.when(F.col("anew"), F.lit(0.0)).otherwise(F.col("dot")) + F.coalesce("_more", F.lit(0.0))
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot / F.sqrt("norms")))
    pairs = (open_.join(added, ["movie_i", "movie_j"], "left").select("movie_i", "movie_j", cosine.alias("cosine_similarity"))
             .where(F.col("cosine_similarity") > F.lit(float(min_cosine))))

    return PrefixJoin(pairs, _work(lists, candidates.agg(F.count(F.lit(1)).alias("candidates")), open_.agg(F.count(F.lit(1)).alias("completed")),
                                   added.agg(F.coalesce(F.sum("_products"), F.lit(0)).alias("_more"))))


def _lists(per_user: DataFrame) -> DataFrame:
    plain = lambda c: F.coalesce(F.sum(F.col(c) * (F.col(c) - 1) / 2), F.lit(0)).cast("bigint")
    return per_user.agg(F.coalesce(F.sum("_d"), F.lit(0)).alias("ratings"), F.coalesce(F.sum("_p"), F.lit(0)).alias("indexed"),
                        plain("_d").alias("_all"), plain("_p").alias("_indexed"))


def _work(*counts: DataFrame) -> DataFrame:
    """One row from tables of one row each."""
    work = counts[0].withColumn("_k", F.lit(0))
    for c in counts[1:]:
        work = work.join(c.withColumn("_k", F.lit(0)), "_k")
    return (work.withColumn("products_done", F.col("_indexed") + F.col("_more"))
            .select("ratings", "indexed", "candidates", "completed", "products_done", (F.col("_all") - F.col("products_done")).alias("products_pruned")))


_COLUMNS = ("rating", "rest", "norm2", "n", "in_prefix", "tail", "over")


def _cell(min_cosine: float, blocks: int):
    """The pairs of one block above the threshold, and a row without pair that counts candidates, completed pairs and their products."""
    def cell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bodies, own = [], 0
        for batch in batches:
            own = int(batch["cell"].iat[0])
            bodies += list(batch["body"])
        root = lambda x: np.sqrt(np.maximum(x, 0.0))
        index = H.Sums()
        for stripe in H.stripes(bodies, H.STEP):
            for a, b, (items, rating, rest, norm2, n, inside, tail, over) in H.products(stripe, own, blocks, True):
                both = (inside[a] > 0) & (inside[b] > 0)
                a, b = a[both], b[both]
                index.add(H.summed(items[a], items[b], [rating[a] * rating[b], np.ones(len(a))],
                                   [rest[a] * rest[b], norm2[a] * norm2[b], np.maximum(over[a] * norm2[b], over[b] * norm2[a]),
                                    (tail[a] + tail[b] > np.minimum(n[a], n[b])).astype(np.float64)]))
        i, j, sums, lows = index.settle()
        if not len(i):
            return
        (dot, common), (behind, norms, suffix, anew) = sums, lows
        candidates = len(i)
        open_ = dot + np.minimum(root(behind), root(suffix)) >= (min_cosine - _SLACK) * np.sqrt(norms)
        i, j, dot, common, norms, anew = (x[open_] for x in (i, j, dot, common, norms, anew))
        completed, products = len(i), int(common[anew > 0].sum())
        if completed:       # what the index did not hold, of the open pairs alone
            ids_i, ids_j = np.unique(i), np.unique(j)
            at = lambda x, y: np.searchsorted(ids_i, x) * (len(ids_j) + 1) + np.searchsorted(ids_j, y)
            known = at(i, j)                                                                            # in order, as the pairs are
            for stripe in H.stripes(bodies, H.STEP):
                for a, b, (items, rating, _, _, _, inside, _, _) in H.products(stripe, own, blocks, True):
                    more = (inside[a] == 0) | (inside[b] == 0)
                    a, b = a[more], b[more]
                    place = np.minimum(np.searchsorted(known, at(items[a], items[b])), completed - 1)
                    hit = (i[place] == items[a]) & (j[place] == items[b])
                    a, b, place = a[hit], b[hit], place[hit]
                    dot += np.bincount(place, weights=rating[a] * rating[b], minlength=completed)
                    products += len(place)
        cos = np.clip(dot / np.sqrt(norms), -1.0, 1.0)
        keep = cos > min_cosine
        i, j, cos = i[keep], j[keep], cos[keep]
        yield from H.frames(movie_i=np.minimum(i, j), movie_j=np.maximum(i, j), cosine_similarity=cos, candidates=np.zeros(len(i), np.int64),
                            completed=np.zeros(len(i), np.int64), products=np.zeros(len(i), np.int64))
        yield pd.DataFrame({"movie_i": pd.array([None], "Int64"), "movie_j": pd.array([None], "Int64"), "cosine_similarity": [0.0], "candidates": [candidates],
                            "completed": [completed], "products": [products]})

    return cell


def _joined_in_cells(entries: DataFrame, items: DataFrame, lists: DataFrame, min_cosine: float, layout: H.Layout) -> PrefixJoin:
    """The join from users' histories: a cell sums the products over the index, drops the pairs whose bound stays below the
    threshold, and completes the others, so neither candidates nor open pairs are shuffled."""
    full = entries.join(items.select("movieId", "tail", "over"), "movieId").withColumn("in_prefix", F.col("in_prefix").cast("int"))
    found = H.by_cells(full, _COLUMNS, layout, True, _cell(min_cosine, layout.blocks),
                       "movie_i long, movie_j long, cosine_similarity double, candidates long, completed long, products long", "prefix-pairs", write=True)
    total = found.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in (("candidates", "candidates"), ("completed", "completed"), ("products", "_more"))])
    return PrefixJoin(found.where("movie_i is not null").select("movie_i", "movie_j", "cosine_similarity"), _work(lists, total))
