"""Rating and item fixtures derived from the driver's Parquet tables.

The driver tables are not rating data, so each fixture is a documented
aggregate over them.  All of them are plain DataFrame plans: filters and
column pruning reach the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def event_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R_ev: user = events.user_id, item = props.k, rating = min(5, 1 + floor(max(value) / 20)).

    One row per (user, item); ratings are whole numbers 1..5.
    """
    ev = table(spark, sf_dir, "events")
    item = F.get_json_object("props", "$.k").cast("bigint")
    return (
        ev.select(F.col("user_id").alias("userId"), item.alias("movieId"), "value")
        .where(F.col("userId").isNotNull() & F.col("movieId").isNotNull())
        .groupBy("userId", "movieId")
        .agg(F.least(F.lit(5.0), F.lit(1.0) + F.floor(F.max("value") / 20)).cast("double").alias("rating"))
    )


def lineitem_ratings(spark: SparkSession, sf_dir: str, item: str = "supp") -> DataFrame:
    """R_ls / R_lp: user = o_custkey, item = l_suppkey (or l_partkey), rating = ceil(max(qty) / 10)."""
    item_col = {"supp": "l_suppkey", "part": "l_partkey"}[item]
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", item_col, "l_quantity")
    od = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return (
        li.join(od, li.l_orderkey == od.o_orderkey)
        .groupBy(F.col("o_custkey").alias("userId"), F.col(item_col).alias("movieId"))
        .agg(F.ceil(F.max("l_quantity") / 10).cast("double").alias("rating"))
    )


def part_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item titles from ``part`` (titles are not unique)."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("movieId"), F.col("p_name").alias("title"))


def embedding_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense embeddings as (item, dimension, value) entries: item = vec_id, 'user' = dimension."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("movieId"),
                    F.posexplode("embedding").alias("userId", "value")).select(
        "movieId", F.col("userId").cast("bigint").alias("userId"),
        F.col("value").cast("double").alias("rating"))
