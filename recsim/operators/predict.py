"""Item-based rating prediction: weighted mean of the user's ratings of the
target's neighbours, with a fallback rating when no neighbour was rated."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recsim.operators.blocked_scores import CANDIDATES, USER_ROWS, blocked_scores, relational_scores
from recsim.session import cut_lineage


def warm_test(test: DataFrame, train: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Test rows of users seen in training (cold users leave the evaluation).

    The distinct user list is pre-aggregated map-side before the semi join.
    """
    users = train.select(*by, "userId").distinct()
    return test.join(users, [*by, "userId"], "left_semi")


def neighbor_expansion(test: DataFrame, neighbors: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per (test rating, neighbour of its item); at most K rows per test row."""
    nb = neighbors.select(*by, F.col("movie_i").alias("movieId"), "movie_j", "cosine_similarity")
    return test.join(nb, [*by, "movieId"]).select(
        *by, "userId", F.col("movieId").alias("target_movie"), F.col("rating").alias("true_rating"),
        F.col("movie_j").alias("neighbor_movie"), "cosine_similarity")


def neighbor_ratings(expanded: DataFrame, train: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Keep the neighbours the user rated in training, with that rating."""
    tr = train.select(*by, "userId", F.col("movieId").alias("neighbor_movie"),
                      F.col("rating").alias("neighbor_rating"))
    return expanded.join(tr, [*by, "userId", "neighbor_movie"])


def neighbor_predictions(rated: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """sum(cos * r) / sum(cos) per test rating (``try_divide``: no error on a zero sum)."""
    return rated.groupBy(*by, "userId", "target_movie", "true_rating").agg(
        F.try_divide(F.sum(F.col("cosine_similarity") * F.col("neighbor_rating")),
                     F.sum("cosine_similarity")).alias("predicted_rating"),
        F.count(F.lit(1)).alias("num_neighbors"))


def final_predictions(test: DataFrame, neighbors: DataFrame, train: DataFrame, default_rating: float,
                      by: Sequence[str] = (), fold: str | None = None) -> DataFrame:
    """Prediction for every test row: the weighted mean, or ``default_rating``.

    Fused form of expansion -> neighbour ratings -> weighted mean -> left join
    -> coalesce: two left joins and one aggregate keyed by the test row, so
    there is no second join back to the test table.  ``is_fallback`` marks the
    default predictions (a real prediction can equal the default).

    With ``fold`` (and ``by`` naming the run) the training table holds every rating once with its fold
    in that column, and a run uses those of all folds but its own.
    """
    by = list(by)
    nb = neighbors.select(*by, F.col("movie_i").alias("movieId"), "movie_j", "cosine_similarity")
    if fold:
        tr = train.select("userId", F.col("movieId").alias("movie_j"), F.col("rating").alias("_r"), F.col(fold).alias("_f"))
        rated = test.join(nb, [*by, "movieId"], "left").join(tr, ["userId", "movie_j"], "left")
        has = F.col("_r").isNotNull() & (F.col("_f") != F.col(by[0]))
    else:
        tr = train.select(*by, "userId", F.col("movieId").alias("movie_j"), F.col("rating").alias("_r"))
        rated = test.join(nb, [*by, "movieId"], "left").join(tr, [*by, "userId", "movie_j"], "left")
        has = F.col("_r").isNotNull()
    pred = F.try_divide(F.sum(F.when(has, F.col("cosine_similarity") * F.col("_r"))),
                        F.sum(F.when(has, F.col("cosine_similarity"))))
    agg = rated.groupBy(*by, "userId", "movieId", "rating").agg(
        pred.alias("_p"), F.count_if(has).alias("num_neighbors"))
    return agg.select(
        *by, "userId", "movieId", F.col("rating").alias("true_rating"),
        F.coalesce(F.col("_p"), F.lit(float(default_rating))).alias("predicted_rating"),
        F.col("_p").isNull().alias("is_fallback"), "num_neighbors")


def user_recommendations(train: DataFrame, neighbors: DataFrame, items: DataFrame, top_n: int = 5,
                         min_neighbors: int = 1, by: Sequence[str] = (), user_rows: int = USER_ROWS,
                         candidates: int = CANDIDATES) -> DataFrame:
    """Top-n unseen, titled items per user scored like a prediction.

    score(u, c) = sum cos(c, j) r(u, j) / sum cos(c, j) over the neighbours j of c
    that u rated; at least ``min_neighbors`` of them; ties by item id.  Candidates without a
    title leave before the scoring, so every block can keep its own top-n: at most
    users x n x candidate blocks rows reach the last window (``blocked_scores``).
    Users too heavy for a block, and runs keyed by ``by``, are scored by joins.
    """
    by = list(by)
    titles = items.select(F.col("movieId").alias("movie_i"), "title")
    titled = neighbors.join(titles.select("movie_i").distinct(), "movie_i", "left_semi")
    if by:
        scores = relational_scores(train, titled, min_neighbors, by)
    else:
        scores, rest = blocked_scores(train, cut_lineage(titled, "titled-neighbors"), top_n, max(1, min_neighbors), user_rows=user_rows, candidates=candidates)
        if rest is not None:
            scores = scores.unionByName(relational_scores(rest, titled, min_neighbors))
    # Scores are compared at 1e-9 so near-ties do not depend on float summation order.
    w = Window.partitionBy(*by, "userId").orderBy(F.round("score", 9).desc(), F.col("movie_i").asc())
    best = scores.join(titles, "movie_i").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_n)
    return best.select(*by, "userId", F.col("movie_i").alias("movieId"), "title", "score", "num_neighbors", "rank")
