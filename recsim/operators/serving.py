"""Serving queries over the two persisted tables (similarity cache and
recommendation cache), as DataFrame functions instead of in-process lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recsim.functions.exprs import rank_confidence
from recsim.session import cut_lineage

BASKET_ROWS = 100_000       # titles of the baskets of one task
SMALL_CACHE = 200_000       # rows of a similarity cache that every task may hold


def similarity_cache(neighbors: DataFrame, items: DataFrame) -> DataFrame:
    """(movie_i, title_i, movie_j, title_j, cosine_similarity); inner title joins."""
    ti = items.select(F.col("movieId").alias("movie_i"), F.col("title").alias("title_i"))
    tj = items.select(F.col("movieId").alias("movie_j"), F.col("title").alias("title_j"))
    return neighbors.join(ti, "movie_i").join(tj, "movie_j").select(
        "movie_i", "title_i", "movie_j", "title_j", "cosine_similarity")


def recommendation_cache(recs: DataFrame) -> DataFrame:
    """(userId, title, score) as read by the user page."""
    return recs.select("userId", "title", "score")


def user_ids(ratings: DataFrame) -> DataFrame:
    return ratings.select("userId").distinct().orderBy("userId")


def _user_filter(df: DataFrame, user) -> DataFrame:
    if isinstance(user, DataFrame):
        return df.join(user.select(F.col(user.columns[0]).alias("userId")), "userId", "left_semi")
    return df.where(F.col("userId") == F.lit(user))


def user_history(ratings: DataFrame, items: DataFrame, user) -> DataFrame:
    """A user's rated titles, highest rating first (untitled items drop out)."""
    return (_user_filter(ratings, user).join(items, "movieId")
            .select("userId", "movieId", "title", "rating")
            .orderBy(F.col("rating").desc(), F.col("title").asc(), F.col("movieId").asc()))


def user_profile_stats(ratings: DataFrame, items: DataFrame, user) -> DataFrame:
    """Mean rating and count over the titled history; (0, 0) for an unknown user.

    A global aggregate always returns one row, so the empty case needs no branch.
    """
    h = _user_filter(ratings, user).join(items, "movieId")
    return h.agg(F.coalesce(F.avg("rating"), F.lit(0.0)).alias("avg_rating"),
                 F.count(F.lit(1)).alias("total_ratings"))


def recommendations_for_user(recs: DataFrame, user, top_n: int = 5) -> DataFrame:
    """Best ``top_n`` cached recommendations of a user with rank and display confidence."""
    sel = _user_filter(recs, user)
    w = Window.partitionBy("userId").orderBy(F.round("score", 9).desc(), F.col("title").asc())
    return (sel.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_n)
            .select("userId", "rank", "title", "score", rank_confidence("rank").alias("confidence")))


def item_catalog(sim_cache: DataFrame) -> DataFrame:
    """Distinct (movieId, title) of the items that have neighbours, by title."""
    return (sim_cache.select(F.col("movie_i").alias("movieId"), F.col("title_i").alias("title")).distinct()
            .orderBy("title", "movieId"))


def _seed_frame(spark, seeds) -> DataFrame:
    if isinstance(seeds, DataFrame):
        return seeds.select(F.col(seeds.columns[0]).alias("title"))
    from pyspark.sql import types as T
    return spark.createDataFrame([(s,) for s in seeds], T.StructType([T.StructField("title", T.StringType())]))


def seed_recommendations(sim_cache: DataFrame, seeds, top_n: int = 5) -> DataFrame:
    """Items most similar to a basket of seed *titles*.

    Rows whose title_i is a seed title are summed per (movie_j, title_j); items
    whose title is a seed title are excluded; best ``top_n`` by score (ties by
    id).  Titles are the key, so two items sharing a seed title both count.
    ``relative_score`` = round(100 * score / best score), 0 if the best is <= 0.
    An empty basket gives an empty result.
    """
    basket = _seed_frame(sim_cache.sparkSession, seeds)
    return seed_recommendations_bulk(
        sim_cache, basket.select(F.lit(0).alias("basket_id"), "title"), top_n).drop("basket_id")


def seed_recommendations_bulk(sim_cache: DataFrame, baskets: DataFrame, top_n: int = 5) -> DataFrame:
    """``seed_recommendations`` for many baskets (basket_id, title) in one job."""
    b = cut_lineage(baskets.select("basket_id", "title").where("title is not null").distinct(), "baskets")
    # a basket's own titles meet it like neighbours, so that one aggregate sums its hits and tells what to leave out
    own = sim_cache.select("title_j").where("title_j is not null").distinct()
    cache = cut_lineage(sim_cache.select("title_i", "movie_j", "title_j", "cosine_similarity", F.lit(False).alias("_own")).unionByName(
        own.select(F.col("title_j").alias("title_i"), F.lit(None).alias("movie_j"), "title_j", F.lit(None).alias("cosine_similarity"), F.lit(True).alias("_own"))), "baskets-cache")
    # dealt by basket before the sums: a task holds those of its own baskets, a bounded number of titles, at any size
    tasks = max(1, -(-b.count() // BASKET_ROWS), b.sparkSession.sparkContext.defaultParallelism)
    asked = b.withColumnRenamed("title", "title_i")
    if cache.count() <= SMALL_CACHE:
        hits = asked.repartition(tasks, "basket_id").join(F.broadcast(cache), "title_i")
    else:
        hits = asked.join(cache, "title_i").repartition(tasks, "basket_id")
    scores = hits.groupBy("basket_id", "title_j", "_own", "movie_j").agg(F.sum("cosine_similarity").alias("score"))
    asks = F.max("_own").over(Window.partitionBy("basket_id", "title_j"))
    kept = scores.withColumn("_asked", asks & F.col("title_j").isNotNull()).where(~F.col("_asked") & ~F.col("_own"))
    # Scores are sums of floats: compare at 1e-9 so ties break by id, not by summation order.
    w = Window.partitionBy("basket_id").orderBy(F.round("score", 9).desc(), F.col("movie_j").asc())
    top = kept.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_n)
    best = Window.partitionBy("basket_id")
    top_score = F.max("score").over(best)
    rel = F.when(top_score > 0, F.round(F.col("score") / top_score * 100)).otherwise(F.lit(0.0))
    return top.select("basket_id", "rank", "movie_j", "title_j", "score",
                      rel.cast("int").alias("relative_score"))


def filter_titles(catalog: DataFrame, query: str) -> DataFrame:
    """Case-insensitive substring match on the title (no pattern characters), without a limit; an
    empty query keeps everything."""
    return catalog.where(F.lower(F.col("title")).contains(F.lit(query.lower())))


def search_items(catalog: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """The first ``limit`` of ``filter_titles`` in title order; an empty query returns nothing."""
    if not query:
        return catalog.limit(0)
    return filter_titles(catalog, query).orderBy("title", "movieId").limit(limit)


# -- indexed title search ---------------------------------------------------------------

GRAM = 3        # code points of the longest index entry


def _grams(text, size: int):
    """Distinct substrings of ``size`` code points."""
    last = F.length(text) - size + 1
    return F.array_distinct(F.transform(F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>")),
                                        lambda i: F.substring(text, i, F.lit(size))))


def title_index(catalog: DataFrame) -> DataFrame:
    """(gram, movieId): the distinct substrings of one to three code points of every lower-cased title.  Rows without id have no entry.

    An id's titles meet before they are cut up, so entries are distinct as they come and no task holds those of many titles."""
    texts = catalog.where("movieId is not null").groupBy("movieId").agg(F.collect_set(F.lower("title")).alias("_texts"))
    grams = F.flatten(F.transform("_texts", lambda text: F.flatten(F.array(*[_grams(text, n) for n in range(1, GRAM + 1)]))))
    return texts.select(F.explode(F.array_distinct(grams)).alias("gram"), "movieId")


def search_titles(index: DataFrame, catalog: DataFrame, queries: DataFrame, rarest: int = 2) -> DataFrame:
    """(query, movieId, title): the titles that contain each of the distinct ``queries`` (column query), in any letter case.

    A query of three code points or more is looked up by its ``rarest`` trigrams, whose lists are intersected, and verified; a
    shorter one by its own entry, which is exact.  A query with a trigram that no title has finds nothing; an empty or null one
    finds nothing.  No title is scanned.
    """
    text = F.lower(F.col("query"))
    asked = queries.select("query").distinct().where(F.length("query") > 0)
    grams = asked.select("query", F.explode(F.when(F.length(text) >= GRAM, _grams(text, GRAM)).otherwise(F.array(text))).alias("gram"))
    lists = index.groupBy("gram").agg(F.count(F.lit(1)).alias("_df"))
    sized = grams.join(lists, "gram", "left").withColumn("_df", F.coalesce("_df", F.lit(0)))
    place = Window.partitionBy("query").orderBy("_df", "gram")
    picked = sized.withColumn("_k", F.row_number().over(place)).where(F.col("_k") <= rarest)
    need = picked.groupBy("query").agg(F.count(F.lit(1)).alias("_need"))
    # dealt by title first: a task that reads the index would else hold the counts of all titles that it meets
    hits = picked.select("query", "gram").join(index, "gram").repartition("movieId").groupBy("query", "movieId").agg(F.count(F.lit(1)).alias("_n"))
    both = hits.join(need, "query").where(F.col("_n") == F.col("_need")).select("query", "movieId")
    return both.join(catalog.select("movieId", "title"), "movieId").where(F.contains(F.lower("title"), text)).select("query", "movieId", "title")
