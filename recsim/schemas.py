"""Declared schemas.  Nothing is inferred on a production path."""

from pyspark.sql import types as T

# Canonical rating table used by every operator.
RATINGS = T.StructType([
    T.StructField("userId", T.LongType()),
    T.StructField("movieId", T.LongType()),
    T.StructField("rating", T.DoubleType()),
    T.StructField("timestamp", T.LongType()),
])

# Tab separated rating folds: user id | item id | rating | unix seconds, no header.
RATING_FOLD = T.StructType([
    T.StructField("user_id", T.LongType()),
    T.StructField("item_id", T.LongType()),
    T.StructField("rating", T.IntegerType()),
    T.StructField("ts", T.LongType()),
])

# Pipe separated user table; zip codes contain letters, so they stay strings.
USERS = T.StructType([
    T.StructField("user_id", T.LongType()),
    T.StructField("age", T.IntegerType()),
    T.StructField("gender", T.StringType()),
    T.StructField("occupation", T.StringType()),
    T.StructField("zip", T.StringType()),
])

GENRES = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("genre_id", T.IntegerType()),
])

# The 19 genre flags of the item file, in file order.
GENRE_NAMES = [
    "unknown", "Action", "Adventure", "Animation", "Children's", "Comedy",
    "Crime", "Documentary", "Drama", "Fantasy", "Film-Noir", "Horror",
    "Musical", "Mystery", "Romance", "Sci-Fi", "Thriller", "War", "Western",
]

ITEM_FILE = T.StructType(
    [
        T.StructField("movie_id", T.LongType()),
        T.StructField("title", T.StringType()),
        T.StructField("release_date", T.StringType()),
        T.StructField("video_release_date", T.StringType()),
        T.StructField("url", T.StringType()),
    ]
    + [T.StructField(f"g{i}", T.IntegerType()) for i in range(len(GENRE_NAMES))]
)

METRICS = T.StructType([
    T.StructField("dataset", T.StringType()),
    T.StructField("rmse", T.DoubleType()),
    T.StructField("mae", T.DoubleType()),
    T.StructField("bucketLength", T.DoubleType()),
    T.StructField("numHashTables", T.IntegerType()),
    T.StructField("threshold", T.DoubleType()),
    T.StructField("top_k", T.IntegerType()),
    T.StructField("timestamp", T.StringType()),
])
