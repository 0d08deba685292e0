"""Train/test splitting: keyed hash split, random split, k-fold, leave-n-out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recsim.functions.exprs import in_hash_sample
from recsim.operators.indexing import dense_index


def tag_hash_split(ratings: DataFrame, test_fraction: float = 0.1, salt: str = "") -> DataFrame:
    """Add ``split`` = 'test' for a reproducible ``test_fraction`` of (user, item) keys.

    The outcome depends on the key only, so it is identical for any partitioning,
    any file order and in DuckDB (unlike ``randomSplit``).
    """
    test = in_hash_sample("userId", "movieId", test_fraction, salt)
    return ratings.withColumn("split", F.when(test, F.lit("test")).otherwise(F.lit("train")))


def hash_split(ratings: DataFrame, test_fraction: float = 0.1, salt: str = "") -> tuple[DataFrame, DataFrame]:
    test = in_hash_sample("userId", "movieId", test_fraction, salt)
    return ratings.where(~test), ratings.where(test)


def random_split(ratings: DataFrame, test_fraction: float = 0.1, seed: int = 126784) -> tuple[DataFrame, DataFrame]:
    """``randomSplit`` as in the original tool.  Depends on the partitioning; prefer ``hash_split``."""
    train, test = ratings.randomSplit([1.0 - test_fraction, test_fraction], seed=seed)
    return train, test


def kfold_assign(ratings: DataFrame, k: int = 5, order_cols: Sequence[str] = ("userId", "movieId"),
                 fold_col: str = "fold") -> DataFrame:
    """Fold 1..k by position: rows (i-1)N/k+1 .. iN/k of the ``order_cols`` order form fold i.

    Positions come from the distributed dense index (no single-partition window).
    ``order_cols`` must be a unique key.
    """
    pos, total = dense_index(ratings, list(order_cols), "_pos", with_total=True)
    return (pos.withColumn(fold_col, (F.floor(F.col("_pos") * F.lit(k) / F.lit(max(total, 1))) + 1).cast("int"))
            .drop("_pos"))


def leave_n_out(ratings: DataFrame, start: int, stop: int, order_cols: Sequence[str] = ("movieId",),
                user_col: str = "userId") -> DataFrame:
    """Tag ``split`` = 'test' for the k-th rating of each user with start <= k <= stop.

    k counts from 1 in ``order_cols`` order within the user.  The filter on
    ``row_number`` is planned as a WindowGroupLimit that also runs before the
    shuffle, so a user with a huge history ships at most ``stop`` rows per map
    task to the window; the test rows are tagged back with a join on the key.
    """
    w = Window.partitionBy(user_col).orderBy(*order_cols)
    test = (ratings.select(user_col, *order_cols)
            .withColumn("_k", F.row_number().over(w))
            .where((F.col("_k") >= start) & (F.col("_k") <= stop))
            .select(user_col, *order_cols, F.lit(True).alias("_t")))
    key = [user_col, *order_cols]
    return (ratings.join(test, key, "left")
            .withColumn("split", F.when(F.col("_t"), F.lit("test")).otherwise(F.lit("base")))
            .drop("_t"))


def leave_n_out_capped(ratings: DataFrame, start: int, stop: int, max_test: int,
                       order_cols: Sequence[str] = ("movieId",), global_order: Sequence[str] = ("userId", "movieId"),
                       user_col: str = "userId") -> DataFrame:
    """``leave_n_out`` with a global cap: only the first ``max_test`` test candidates
    in ``global_order`` stay in test (``max_test <= 0``: no cap)."""
    tagged = leave_n_out(ratings, start, stop, order_cols, user_col)
    if max_test <= 0:
        return tagged
    cand = tagged.where(F.col("split") == "test").select(*global_order)
    ranked = dense_index(cand, list(global_order), "_p").where(F.col("_p") < max_test).select(
        *global_order, F.lit(True).alias("_keep"))
    return (tagged.join(ranked, list(global_order), "left")
            .withColumn("split", F.when(F.col("_keep"), F.lit("test")).otherwise(F.lit("base")))
            .drop("_keep"))


def fold_roles(folded: DataFrame, k: int, fold_col: str = "fold") -> DataFrame:
    """Replicate each rating to the k cross-validation runs: ``role`` = test in its
    own fold, train in the other k-1 (a generator, not a join)."""
    return (folded.withColumn("cv", F.explode(F.sequence(F.lit(1), F.lit(k))))
            .withColumn("role", F.when(F.col("cv") == F.col(fold_col), F.lit("test")).otherwise(F.lit("train")))
            .drop(fold_col))
