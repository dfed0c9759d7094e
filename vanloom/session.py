"""Session helpers: table access and lineage cuts that survive the loss of an executor."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder in ``spark.checkpoint.dir``.

    Where the setting is absent, a temporary folder is set, and only for a local master: on a
    cluster a machine-local folder would lose data with its machine, so that case is an error.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="vanloom-"))
        return sc._jsc.sc().getCheckpointDir().get()
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(folder)
    return folder


#: With this setting Spark removes the shuffle files of a query when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows are written once to the shared folder and lineage ends there. The shuffle files behind them,
    which nothing can read any more, are removed at once, so a query of many steps holds the disk of one."""
    checkpoint_dir(df.sparkSession)
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, "false")
    conf.set(_CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)
    finally:
        conf.set(_CLEANUP, before)


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores where the input has fewer partitions than the cluster has cores (a small file is one
    partition); larger inputs are left as they are, without a shuffle. For row-local work that is dear per row."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores else df.repartition(cores)
