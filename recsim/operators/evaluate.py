"""Evaluation: RMSE, MAE, coverage, error statistics, metric records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recsim.params import Params


def _err():
    return F.col("predicted_rating") - F.col("true_rating")


def prediction_metrics(preds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """RMSE and MAE (the two evaluator metrics) in one aggregate."""
    e = _err()
    return preds.groupBy(*by).agg(
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        F.count(F.lit(1)).alias("num_predictions"))


def prediction_coverage(preds: DataFrame, default_rating: float, by: Sequence[str] = ()) -> DataFrame:
    """Share of predictions that came from neighbours, in percent.

    ``coverage_compat`` counts predictions different from the default value (the
    original definition: a real prediction equal to the default counts as a
    fallback); ``coverage`` uses the ``is_fallback`` flag.
    """
    n = F.count(F.lit(1))
    from_nb = F.count_if(~F.col("is_fallback"))
    not_default = F.count_if(F.col("predicted_rating") != F.lit(float(default_rating)))
    return preds.groupBy(*by).agg(
        n.alias("num_predictions"),
        from_nb.alias("num_from_neighbors"),
        not_default.alias("num_not_default"),
        (F.lit(100.0) * from_nb / n).alias("coverage"),
        (F.lit(100.0) * not_default / n).alias("coverage_compat"))


def summary(preds: DataFrame, default_rating: float, by: Sequence[str] = ()) -> DataFrame:
    """RMSE, MAE and both coverages in a single aggregate (one pass over the predictions)."""
    e = _err()
    n = F.count(F.lit(1))
    from_nb = F.count_if(~F.col("is_fallback"))
    not_default = F.count_if(F.col("predicted_rating") != F.lit(float(default_rating)))
    return preds.groupBy(*by).agg(
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        n.alias("num_predictions"),
        from_nb.alias("num_from_neighbors"),
        not_default.alias("num_not_default"),
        (F.lit(100.0) * from_nb / n).alias("coverage"),
        (F.lit(100.0) * not_default / n).alias("coverage_compat"))


def error_stats(preds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean and sample standard deviation of the error, plus MAE and RMSE."""
    e = _err()
    return preds.groupBy(*by).agg(
        F.avg(e).alias("mean_error"),
        F.stddev_samp(e).alias("std_error"),
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"))


def true_vs_predicted(preds: DataFrame) -> DataFrame:
    """(true rating, prediction rounded to 0.1) counts: the scatter plot as a table."""
    return preds.groupBy("true_rating", F.round("predicted_rating", 1).alias("predicted_bin")).agg(
        F.count(F.lit(1)).alias("num_predictions"))


def metrics_record(metrics: DataFrame, params: Params, dataset: str, num_hash_tables: int | None = None,
                   stamp: str | None = None) -> DataFrame:
    """One metrics row (dataset, rmse, mae, parameters, run stamp) per input row.

    ``stamp`` defaults to the current time as yyyyMMdd_HHmmss.
    """
    ts = F.lit(stamp) if stamp is not None else F.date_format(F.current_timestamp(), "yyyyMMdd_HHmmss")
    return metrics.select(
        F.lit(dataset).alias("dataset"), "rmse", "mae",
        F.lit(float(params.bucket_length)).alias("bucketLength"),
        F.lit(int(num_hash_tables if num_hash_tables is not None else params.num_hash_tables)).alias("numHashTables"),
        F.lit(float(params.threshold)).alias("threshold"),
        F.lit(int(params.top_k)).alias("top_k"),
        ts.alias("timestamp"))
