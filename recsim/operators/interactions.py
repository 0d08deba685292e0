"""Interaction-matrix preparation: dedupe, user index, item profiles, support, norms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recsim.operators.indexing import dense_index
from recsim.session import cut_lineage


def dedupe_ratings(ratings: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One rating per (user, item): the highest one wins.

    Sparse vectors reject repeated indices and duplicates would fan out in the
    prediction joins, so every pipeline starts here.
    """
    return ratings.groupBy(*by, "userId", "movieId").agg(F.max("rating").alias("rating"))


def user_index(ratings: DataFrame) -> DataFrame:
    """Dense 0-based ``user_idx`` of the distinct users, in userId order (two small jobs)."""
    users = ratings.select("userId").distinct()
    return dense_index(users, ["userId"], "user_idx").select(
        "userId", F.col("user_idx").cast("int").alias("user_idx"))


def indexed_ratings(ratings: DataFrame, index: DataFrame) -> DataFrame:
    """Ratings joined to the user index (inner: users without an index drop out)."""
    return ratings.join(index, "userId")


def item_support(ratings: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per item: number of ratings and squared L2 norm (partial aggregation map-side)."""
    return ratings.groupBy(*by, "movieId").agg(
        F.count(F.lit(1)).alias("num_ratings"),
        F.sum(F.col("rating") * F.col("rating")).alias("norm2"),
    )


def supported_items(ratings: DataFrame, min_ratings: int, by: Sequence[str] = ()) -> DataFrame:
    """Items with at least ``min_ratings`` ratings and a non-zero vector."""
    return item_support(ratings, by).where(
        (F.col("num_ratings") >= min_ratings) & (F.col("norm2") > 0))


def supported_ratings(ratings: DataFrame, min_ratings: int, by: Sequence[str] = ()) -> DataFrame:
    """Ratings of the supported items only (semi join on the item keys)."""
    keep = supported_items(ratings, min_ratings, by).select(*by, "movieId")
    return ratings.join(keep, [*by, "movieId"], "left_semi")


def item_profiles(indexed: DataFrame) -> DataFrame:
    """Per item: the (user_idx, rating) list sorted by user_idx, and its length.

    Builds one row per item whose width is the item's degree; only the MLlib
    vector path needs it.  The relational paths never collect a profile.
    """
    return indexed.groupBy("movieId").agg(
        F.sort_array(F.collect_list(F.struct("user_idx", "rating"))).alias("user_ratings"),
        F.count(F.lit(1)).alias("num_ratings"),
    )


def normalized_profiles(ratings: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Unit-L2 item vectors as entries: weight = rating / ||item||.

    The norm is a grouped sum joined back (AQE splits a hot item's partition),
    not a window over the item, which would put a hot item into one task.
    """
    norms = item_support(ratings, by).select(*by, "movieId", "norm2")
    return ratings.join(norms, [*by, "movieId"]).select(
        *by, "movieId", "userId", (F.col("rating") / F.sqrt("norm2")).alias("weight"))


# -- sparse vectors (MLlib path only) -----------------------------------------

# What MLlib stores a vector as: type 0 is sparse, type 1 dense (``values`` alone).
VECTOR = "struct<type:tinyint,size:int,indices:array<int>,values:array<double>>"


def item_vectors(profiles: DataFrame, index: DataFrame) -> DataFrame:
    """Sparse rating vector per item (size = number of indexed users).

    No built-in makes a sparse vector from arrays, so the vector's storage form is built as
    a struct, written to the shared checkpoint folder and read back as a vector column.
    The user count is a scalar subquery, so no driver round trip is needed.
    """
    from pyspark.ml.linalg import VectorUDT
    size = index.agg(F.count(F.lit(1))).scalar().cast("int")
    entries = F.col("user_ratings")
    stored = F.struct(F.lit(0).cast("tinyint").alias("type"), size.alias("size"),
                      F.transform(entries, lambda e: e["user_idx"].cast("int")).alias("indices"),
                      F.transform(entries, lambda e: e["rating"].cast("double")).alias("values"))
    plain = profiles.select("movieId", stored.alias("features"), "num_ratings")
    schema = T.StructType([plain.schema["movieId"], T.StructField("features", VectorUDT()), plain.schema["num_ratings"]])
    return cut_lineage(plain, "item-vectors", schema)


def normalize_vectors(vectors: DataFrame, input_col: str = "features",
                      output_col: str = "norm_features") -> DataFrame:
    from pyspark.ml.feature import Normalizer
    return Normalizer(inputCol=input_col, outputCol=output_col, p=2.0).transform(vectors)


def vector_entries(vectors: DataFrame, col: str = "features") -> DataFrame:
    """Explode sparse vectors back to (movieId, user_idx, value) entries.

    Reads only the stored entries of each vector (no dense expansion), from the storage form
    as written to the shared checkpoint folder.
    """
    stored = cut_lineage(vectors.select("movieId", F.col(col).alias("vector")), "vector-entries",
                         f"movieId {vectors.schema['movieId'].dataType.simpleString()}, vector {VECTOR}")
    entries = F.arrays_zip(
        F.coalesce("vector.indices", F.transform("vector.values", lambda _, i: i)).alias("user_idx"),
        F.col("vector.values").alias("value"))
    return (stored.select("movieId", F.explode(entries).alias("e"))
            .select("movieId", F.col("e.user_idx").cast("int").alias("user_idx"), F.col("e.value").alias("value")))
