"""Session helpers.

On a cluster the session comes from the environment; the only thing the
library needs from it is a shared ``spark.checkpoint.dir`` for lineage cuts.
A local default is created only when the setting is absent (tests, bench).
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ship_by_value(module_name: str) -> None:
    """Pickle functions of ``module_name`` by value when Spark sends them to Python
    workers, so executors need not have this package on their import path."""
    import sys

    from pyspark import cloudpickle
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "recsim") -> SparkSession:
    """Single-JVM session for tests and the local bench."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("RECSIM_DRIVER_MEMORY", "16g"))
        # one BLAS thread per Python worker: Spark already runs one worker per core
        .config("spark.executorEnv.OPENBLAS_NUM_THREADS", "1")
        .config("spark.executorEnv.OMP_NUM_THREADS", "1")
        .config("spark.executorEnv.MKL_NUM_THREADS", "1")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's ``spark.checkpoint.dir``.  Where it is unset, a single-machine master
    gets a local folder; on a cluster that would be a different folder on every executor,
    so it is an error."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not configured:
        configured = tempfile.mkdtemp(prefix="recsim-ckpt-", dir="/tmp")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut_lineage(df: DataFrame, name: str = "stage", schema=None, **options) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared checkpoint folder and read it back.

    Downstream plans start from the files (they survive executor loss) and
    keep column pruning and filter pushdown, which an RDD checkpoint would lose.
    ``schema`` reads the columns back under other types of the same layout;
    ``options`` go to the writer.  Nothing reads the shuffle files of the write once
    it has ended, so Spark removes them then and not when the driver collects garbage.
    """
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/recsim-stage/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)
    return (spark.read if schema is None else spark.read.schema(schema)).parquet(path)
