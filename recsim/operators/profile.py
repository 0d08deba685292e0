"""Profiling aggregates and inspection queries (single-pass aggregates)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recsim.functions.exprs import hash_order_key


def dataset_stats(ratings: DataFrame) -> DataFrame:
    """Rows, distinct users, distinct items and mean rating in one job."""
    return ratings.agg(
        F.count(F.lit(1)).alias("num_ratings"),
        F.countDistinct("userId").alias("num_users"),
        F.countDistinct("movieId").alias("num_items"),
        F.avg("rating").alias("avg_rating"),
    )


def rating_distribution(ratings: DataFrame) -> DataFrame:
    return ratings.groupBy("rating").agg(F.count(F.lit(1)).alias("num_ratings")).orderBy("rating")


def split_stats(tagged: DataFrame, split_col: str = "split") -> DataFrame:
    """Per split: rows, users, items, mean rating (one grouped job for all splits)."""
    return tagged.groupBy(split_col).agg(
        F.count(F.lit(1)).alias("num_ratings"),
        F.countDistinct("userId").alias("num_users"),
        F.countDistinct("movieId").alias("num_items"),
        F.avg("rating").alias("avg_rating"),
    )


def item_counts(ratings: DataFrame) -> DataFrame:
    return ratings.groupBy("movieId").agg(F.count(F.lit(1)).alias("num_ratings"))


def most_rated_items(ratings: DataFrame, n: int = 10) -> DataFrame:
    """Top-n items by support, ties by id (a top-k report: the limit is the feature)."""
    return item_counts(ratings).orderBy(F.col("num_ratings").desc(), F.col("movieId").asc()).limit(n)


def most_rated_item(ratings: DataFrame) -> DataFrame:
    """The single most rated item (ties: lowest id) as a one-row DataFrame."""
    return most_rated_items(ratings, 1)


def item_title(items: DataFrame, ids) -> DataFrame:
    """Title lookup for a literal id or for the ids of a one-column DataFrame."""
    if isinstance(ids, DataFrame):
        return items.join(ids.select(F.col(ids.columns[0]).alias("movieId")), "movieId", "left_semi").select(
            "movieId", "title")
    return items.where(F.col("movieId") == F.lit(ids)).select("movieId", "title").limit(1)


def sample_rows(ratings: DataFrame, n: int = 5, seed: int = 126784) -> DataFrame:
    """n pseudo-random rows chosen by a seeded md5 of the key (no collect, reproducible)."""
    return (ratings.withColumn("_h", hash_order_key("userId", "movieId", seed=seed))
            .orderBy("_h").limit(n).drop("_h"))


def supported_item_count(ratings: DataFrame, min_ratings: int) -> DataFrame:
    return (item_counts(ratings).where(F.col("num_ratings") >= min_ratings)
            .agg(F.count(F.lit(1)).alias("num_items")))


def value_histogram(df: DataFrame, col: str, bins: int = 20) -> DataFrame:
    """Equal-width histogram over [min, max], one row per bin, empty ones with 0; the last bin
    is closed on the right, and equal values all fall into bin 0.  No value, no bin.

    One aggregation: the values are counted by a map from bin to count, and the bins come
    from that single row.  The min/max pass is a scalar subquery.
    """
    v = F.col(col)
    rng = df.agg(F.struct(F.min(v).alias("lo"), F.max(v).alias("hi"))).scalar()
    lo, hi = rng["lo"], rng["hi"]
    width = (hi - lo) / F.lit(bins)
    b = F.when(hi == lo, F.lit(0)).otherwise(F.least(F.floor((v - lo) / width), F.lit(bins - 1))).cast("int")
    filled = (df.where(v.isNotNull()).withColumn("bin", b).groupBy("bin").agg(F.count(F.lit(1)).alias("num_values"))
              .agg(F.map_from_entries(F.collect_list(F.struct("bin", "num_values"))).alias("filled"))   # at most ``bins`` entries
              .where(F.size("filled") > 0))
    return (filled.select("filled", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
            .select("bin",
                    (lo + F.col("bin") * (hi - lo) / F.lit(bins)).alias("bin_start"),
                    (lo + (F.col("bin") + 1) * (hi - lo) / F.lit(bins)).alias("bin_end"),
                    F.coalesce(F.try_element_at("filled", F.col("bin")), F.lit(0)).alias("num_values"))
            .orderBy("bin"))
