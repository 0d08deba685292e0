"""Exact item-item cosine, symmetric edge lists, top-K neighbours, similar-item queries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recsim.operators.gram import DEFAULT_ITEM_BLOCK, DEFAULT_SIDE_ROWS, RANK_DIGITS, gram_products


def best_first():
    """Order of neighbours: cosine at ``RANK_DIGITS`` digits desc, then neighbour id asc."""
    return F.round("cosine_similarity", RANK_DIGITS).desc(), F.col("movie_j").asc()


def exact_cosine_pairs(ratings: DataFrame, *, min_cosine: float | None = None,
                       by: Sequence[str] = (), item_block: int = DEFAULT_ITEM_BLOCK,
                       side_rows: int = DEFAULT_SIDE_ROWS) -> DataFrame:
    """All co-rated item pairs (movie_i < movie_j) with their exact cosine.

    ``min_cosine`` keeps pairs with cosine strictly above it (a distance
    threshold t between unit vectors is the cosine cut 1 - t^2/2).
    """
    by = list(by)
    return gram_products(ratings, by, item_block=item_block, side_rows=side_rows, min_cosine=min_cosine).select(
        *by, "movie_i", "movie_j", "cosine_similarity")


def exact_topk_neighbors(ratings: DataFrame, k: int, *, min_cosine: float | None = None,
                         by: Sequence[str] = (), item_block: int = DEFAULT_ITEM_BLOCK,
                         side_rows: int = DEFAULT_SIDE_ROWS, keep_rank: bool = False) -> DataFrame:
    """Top-k exact neighbours per item (cosine desc, neighbour id asc), cosine > ``min_cosine``.

    Same result as ``topk_neighbors(symmetric_pairs(exact_cosine_pairs(...)), k)``,
    but the Gram cells keep only their own top-k per item whenever cosines are
    final inside a cell, so the full pair table is never shuffled.
    """
    by = list(by)
    edges = gram_products(ratings, by, item_block=item_block, side_rows=side_rows,
                          top_k=k, min_cosine=min_cosine)
    return topk_neighbors(edges, k, by, keep_rank=keep_rank)


def symmetric_pairs(pairs: DataFrame, by: Sequence[str] = (), extra: Sequence[str] = ()) -> DataFrame:
    """Both directions of every edge from one scan of the half edge list."""
    by, extra = list(by), list(extra)
    both = F.explode(F.array(
        F.struct(F.col("movie_i").alias("a"), F.col("movie_j").alias("b")),
        F.struct(F.col("movie_j").alias("a"), F.col("movie_i").alias("b")),
    )).alias("_e")
    return pairs.select(*by, both, "cosine_similarity", *extra).select(
        *by, F.col("_e.a").alias("movie_i"), F.col("_e.b").alias("movie_j"),
        "cosine_similarity", *extra)


def topk_neighbors(sym: DataFrame, k: int, by: Sequence[str] = (), keep_rank: bool = False) -> DataFrame:
    """At most ``k`` neighbours per item, by cosine desc then neighbour id asc.

    ``row_number() <= k`` becomes a WindowGroupLimit, which also runs before
    the shuffle, so a hub item ships at most k rows per map task.
    """
    w = Window.partitionBy(*by, "movie_i").orderBy(*best_first())
    ranked = sym.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked if keep_rank else ranked.drop("rank")


def seed_products(ratings: DataFrame, seeds: DataFrame) -> DataFrame:
    """(movie_i, movie_j, cosine_similarity) of the items ``seeds`` (column movieId) with every co-rated item: a few items against all.

    The seeds' ratings meet the histories of their raters, so the products are those of the seeds alone; norms are one
    aggregate over the ratings.  No table of neighbours or pairs is built.
    """
    own = ratings.join(seeds.select("movieId").distinct(), "movieId").select(F.col("movieId").alias("movie_i"), "userId", F.col("rating").alias("_a"))
    norms = ratings.groupBy("movieId").agg(F.sum(F.col("rating") * F.col("rating")).alias("_norm2"))
    dots = (ratings.join(own, "userId").where(F.col("movieId") != F.col("movie_i"))
            .groupBy("movie_i", F.col("movieId").alias("movie_j")).agg(F.sum(F.col("_a") * F.col("rating")).alias("_dot")))
    norm_i, norm_j = (norms.select(F.col("movieId").alias(f"movie_{s}"), F.col("_norm2").alias(f"_n{s}")) for s in "ij")
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("_dot") / F.sqrt(F.col("_ni") * F.col("_nj"))))
    return (dots.where("_dot <> 0").join(norm_j, "movie_j").join(norm_i, "movie_i").where("_ni > 0 and _nj > 0")
            .select("movie_i", "movie_j", cosine.alias("cosine_similarity")))


def seed_neighbors(ratings: DataFrame, seeds: DataFrame, k: int, *, min_cosine: float | None = None) -> DataFrame:
    """Top-k exact neighbours of the items ``seeds`` (column movieId): the rows that ``exact_topk_neighbors`` has for them."""
    found = seed_products(ratings, seeds)
    if min_cosine is not None:
        found = found.where(F.col("cosine_similarity") > F.lit(float(min_cosine)))
    return topk_neighbors(found, k)


def similar_items(neighbors: DataFrame, items: DataFrame, movie_id, k: int = 5) -> DataFrame:
    """Top-k neighbours of one item with titles (inner join: untitled neighbours vanish).

    ``movie_id`` is a literal id or a one-column DataFrame holding the id(s).
    """
    if isinstance(movie_id, DataFrame):
        sel = neighbors.join(movie_id.select(F.col(movie_id.columns[0]).alias("movie_i")), "movie_i", "left_semi")
    else:
        sel = neighbors.where(F.col("movie_i") == F.lit(movie_id))
    titled = sel.join(items.select(F.col("movieId").alias("movie_j"), "title"), "movie_j")
    return (titled.orderBy(*best_first())
            .select("movie_j", "title", "cosine_similarity").limit(k))


def similar_items_bulk(neighbors: DataFrame, items: DataFrame, ids: DataFrame, k: int = 5) -> DataFrame:
    """``similar_items`` for every id of ``ids`` (column movieId) in one job."""
    sel = neighbors.join(ids.select(F.col("movieId").alias("movie_i")), "movie_i", "left_semi")
    titled = sel.join(items.select(F.col("movieId").alias("movie_j"), "title"), "movie_j")
    w = Window.partitionBy("movie_i").orderBy(*best_first())
    return (titled.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("movie_i", "rank", "movie_j", "title", "cosine_similarity"))
