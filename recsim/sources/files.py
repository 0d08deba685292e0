"""File readers and writers with declared schemas (no schema inference)."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recsim.schemas import GENRE_NAMES, GENRES, ITEM_FILE, METRICS, RATING_FOLD, RATINGS, USERS
from recsim.session import ensure_checkpoint_dir

ITEMS_CSV = T.StructType([
    T.StructField("movieId", T.LongType()),
    T.StructField("title", T.StringType()),
    T.StructField("genres", T.StringType()),
])


#: One CSV dialect for reading and writing: a quote inside a quoted field is doubled.
CSV = {"header": True, "quote": '"', "escape": '"'}


def read_csv_by_name(spark: SparkSession, path: str, schema: T.StructType, optional: Sequence[str] = (),
                     encoding: str = "UTF-8") -> DataFrame:
    """Header CSV whose columns are found by name, in any order; other columns are ignored.

    The header is the first line of the files (they must share it).  A column of ``schema`` that
    the header lacks is null if it is in ``optional``, else an error."""
    raw = spark.read.options(**CSV, encoding=encoding, inferSchema=False).csv(path)
    missing = [f.name for f in schema.fields if f.name not in raw.columns and f.name not in optional]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}; its header is {', '.join(raw.columns)}")
    return raw.select(*[(F.col(f"`{f.name}`") if f.name in raw.columns else F.lit(None)).try_cast(f.dataType).alias(f.name)
                        for f in schema.fields])


def read_ratings_csv(spark: SparkSession, path: str) -> DataFrame:
    """ratings.csv with header columns userId, movieId, rating[, timestamp]."""
    return read_csv_by_name(spark, path, RATINGS, optional=("timestamp",))


def read_items_csv(spark: SparkSession, path: str) -> DataFrame:
    """movies.csv with header columns movieId, title[, genres] (quoted titles may hold commas and quotes)."""
    return read_csv_by_name(spark, path, ITEMS_CSV, optional=("genres",))


def read_rating_folds(spark: SparkSession, path: str) -> DataFrame:
    """Tab separated folds without header -> canonical ratings plus ``ts`` as a timestamp."""
    raw = spark.read.schema(RATING_FOLD).option("sep", "\t").csv(path)
    return raw.select(
        F.col("user_id").alias("userId"), F.col("item_id").alias("movieId"),
        F.col("rating").cast("double").alias("rating"), F.col("ts").alias("timestamp"),
        F.timestamp_seconds("ts").alias("ts"))


def read_users(spark: SparkSession, path: str, sep: str = "|") -> DataFrame:
    return spark.read.schema(USERS).option("sep", sep).csv(path)


def read_genres(spark: SparkSession, path: str, sep: str = "|") -> DataFrame:
    """Genre list; blank trailing lines are dropped."""
    return spark.read.schema(GENRES).option("sep", sep).csv(path).where(
        F.col("name").isNotNull() & (F.trim("name") != ""))


def read_occupations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("occupation")).where(F.col("occupation") != "")


def read_item_file(spark: SparkSession, path: str, sep: str = "|", encoding: str = "ISO-8859-1") -> DataFrame:
    """Item file with 19 genre flags (Latin-1 unless told otherwise) -> movieId, title, dates, url, genres array."""
    raw = spark.read.schema(ITEM_FILE).option("sep", sep).option("quote", "\u0000").option("encoding", encoding).csv(path)
    flags = [F.when(F.col(f"g{i}") == 1, F.lit(name)) for i, name in enumerate(GENRE_NAMES)]
    genres = F.filter(F.array(*flags), lambda x: x.isNotNull())
    return raw.select(F.col("movie_id").alias("movieId"), "title", "release_date", "video_release_date",
                      "url", genres.alias("genres"))


def write_predictions(preds: DataFrame, path: str) -> None:
    """Overwrite a header CSV directory (written by the executors, never collected)."""
    (preds.select("userId", "movieId", "true_rating", "predicted_rating")
     .write.mode("overwrite").option("header", True).csv(path))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType([
        T.StructField("userId", T.LongType()), T.StructField("movieId", T.LongType()),
        T.StructField("true_rating", T.DoubleType()), T.StructField("predicted_rating", T.DoubleType())])
    return spark.read.schema(schema).option("header", True).csv(path)


def append_metrics(record: DataFrame, path: str, run: str | None = None) -> None:
    """Add metric rows under a run id; creates the table on first use (no read-modify-write).

    The table is partitioned by run and only the run's own partition is overwritten, so a run that is
    written again after a failure replaces its record instead of doubling it.  Without ``run`` every call is a run of its own.
    """
    (record.select(*[f.name for f in METRICS.fields]).withColumn("run", F.lit(run or uuid.uuid4().hex))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").option("header", True).csv(path))


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """The metric rows of all runs."""
    schema = T.StructType([*METRICS.fields, T.StructField("run", T.StringType())])
    return spark.read.schema(schema).option("header", True).csv(path).drop("run")


def write_cache(df: DataFrame, path: str, key: str, num_files: int | None = None) -> None:
    """Persist a cache table clustered by ``key``: range partitioned and sorted, so a
    point lookup on ``key`` skips most files and row groups via min/max stats."""
    n = num_files or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df.repartitionByRange(n, key).sortWithinPartitions(key).write.mode("overwrite").parquet(path)


def write_bucketed(df: DataFrame, keys: Sequence[str], num_buckets: int, name: str) -> DataFrame:
    """Persist ``df`` as a table bucketed and sorted by ``keys`` under the shared folder and read it back.

    Joins and aggregates on exactly ``keys`` read it without an Exchange; two tables with as many buckets on the
    two sides' keys are co-located.  The catalog entry gets a name of its own per call.
    """
    table = f"recsim_{name}_{uuid.uuid4().hex}"
    (df.repartition(num_buckets, *keys).write.bucketBy(num_buckets, *keys).sortBy(*keys).format("parquet")
     .option("path", scratch_path(df.sparkSession, name)).saveAsTable(table))
    return df.sparkSession.table(table)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory (never machine-local on a cluster)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/recsim-io/{name}-{uuid.uuid4().hex}"
