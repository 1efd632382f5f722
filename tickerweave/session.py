"""Session builder shared by the tests, the bench and the command line."""

from __future__ import annotations

import os

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on. The cluster's own values win where they are already set.
_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # Folder values such as a horizon of "1d" or a ticker of "007" are text, not numbers.
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Recording the call site of every column expression doubles the time to build wide plans.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(
    app_name: str = "tickerweave",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**_DEFAULTS, **(extra or {})}.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def local_session(cores: int | None = None) -> SparkSession:
    """Small single-machine session for tests and the bench."""
    n = cores or os.cpu_count() or 4
    return build_session(
        master=f"local[{n}]",
        shuffle_partitions=n,
        extra={"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"},
    )


def shared_checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared folder the cluster names for checkpoints, or None when it names none."""
    return spark.conf.get("spark.checkpoint.dir", None)


def reuse(df: DataFrame) -> DataFrame:
    """A frame that several later parts of a job read.

    With a shared checkpoint folder it is written there once, which also cuts
    the lineage and survives the loss of executors; otherwise it is cached with
    spill to disk and Spark recomputes lost pieces.
    """
    spark = df.sparkSession
    folder = shared_checkpoint_dir(spark)
    if folder is None:
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
