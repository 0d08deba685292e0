"""Distributed dense 0-based position of rows in a key order.

A global ``row_number().over(Window.orderBy(k))`` moves every row to one task
(``Exchange SinglePartition``).  Instead: range-sort, checkpoint the sorted
frame to the shared checkpoint folder (so the two passes below read the
same partitions even after an executor loss), count rows per partition,
turn the counts into offsets (one row per partition: the only data that
reaches the driver) and add ``offset + position inside the partition``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recsim.session import cut_lineage


def dense_index(df: DataFrame, order_cols: Sequence[str], index_col: str = "pos",
                num_partitions: int | None = None, with_total: bool = False):
    """Add ``index_col`` = 0-based position of the row in ``order_cols`` order.

    Keys must be unique for the result to be deterministic.  Runs two jobs
    (checkpoint + per-partition counts); the offset table has one row per
    partition, so its size is bounded by the partition count.  With
    ``with_total`` it returns ``(frame, total row count)``.
    """
    spark = df.sparkSession
    # Without an explicit count AQE may merge neighbouring range partitions; merged
    # partitions are still contiguous key ranges, so the order is preserved.
    ranged = (df.repartitionByRange(num_partitions, *order_cols) if num_partitions
              else df.repartitionByRange(*order_cols))
    ordered = ranged.sortWithinPartitions(*order_cols)
    staged = cut_lineage(
        ordered.withColumn("_pid", F.spark_partition_id())
        .withColumn("_mono", F.monotonically_increasing_id())
    )
    counts = staged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"), F.min("_mono").alias("_first"))
    rows = sorted(counts.collect(), key=lambda r: r["_pid"])
    offsets, acc = [], 0
    for r in rows:
        offsets.append((int(r["_pid"]), acc, int(r["_first"])))
        acc += int(r["_n"])
    schema = T.StructType([
        T.StructField("_pid", T.IntegerType()),
        T.StructField("_off", T.LongType()),
        T.StructField("_first", T.LongType()),
    ])
    off = spark.createDataFrame(offsets, schema)
    out = (
        staged.join(F.broadcast(off), "_pid")
        .withColumn(index_col, F.col("_off") + F.col("_mono") - F.col("_first"))
        .drop("_pid", "_mono", "_off", "_first")
    )
    return (out, acc) if with_total else out


def running_total(df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[str | Column], amounts: dict[str, Column]) -> DataFrame:
    """``df`` with, per entry of ``amounts``, its total over the rows of equal ``keys`` that come earlier in the order (bucket, ``order``).

    ``bucket`` cuts a key's rows into ranges of the order: totals per range run on over the ranges, and a window runs only inside
    a range, so a hot key never meets in one task.  ``df`` is read twice.
    """
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    over = earlier(Window.partitionBy(*keys).orderBy(bucket))
    totals = df.groupBy(*keys, bucket).agg(*[F.sum(a).alias(f"_{n}") for n, a in amounts.items()])
    offsets = totals.select(*keys, bucket, *[F.coalesce(F.sum(f"_{n}").over(over), F.lit(0)).alias(f"_{n}") for n in amounts])
    inside = earlier(Window.partitionBy(*keys, bucket).orderBy(*order))
    joined = df.join(offsets, [*keys, bucket])
    return joined.select(*df.columns, *[(F.col(f"_{n}") + F.coalesce(F.sum(a).over(inside), F.lit(0))).alias(n) for n, a in amounts.items()])
