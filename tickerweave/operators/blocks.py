"""Rows of a matrix as numpy blocks, for fits that pass over the same rows many times.

Each pass is one Spark job: tasks turn their blocks into sums, the sums are added up in a tree, and only sums whose size
depends on the fits, never on the rows, reach the driver.
"""

from __future__ import annotations

import pickle
import tempfile

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerweave.session import shared_checkpoint_dir

#: Row-and-fit pairs of a partition at least, and rows of a partition at most; between them a few partitions per core.
LEAST_WORK, MOST_ROWS = 32_768, 400_000


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints; a temporary one is made for a local master only."""
    folder = shared_checkpoint_dir(spark)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        folder = getattr(spark, "_fit_folder", None)
        if folder is None:
            folder = spark._fit_folder = tempfile.mkdtemp(prefix="fits-")
    return folder.rstrip("/")


def use_checkpoints(spark: SparkSession) -> None:
    spark.sparkContext.setCheckpointDir(checkpoint_folder(spark))


def to_blocks(df: DataFrame, sets: list[Column], fits: int, vector: str = "features", label: str = "label") -> RDD:
    """Blocks {x, y, key, sets, test}: features, label, a hash of ticker and date, which of the sets of training rows hold
    a row, and the fold that tests it (-1: none). Rows without a label are left out."""
    spark = df.sparkSession
    test = F.col("test_fold").cast("int") if "test_fold" in df.columns else F.lit(None).cast("int")
    rows = df.filter(F.col(label).isNotNull()).select(
        vector_to_array(vector).alias("x"), F.col(label).cast("double").alias("y"), F.xxhash64("ticker", "date").alias("key"),
        F.array(*[F.coalesce(s, F.lit(False)) for s in sets]).alias("sets"), F.coalesce(test, F.lit(-1)).alias("test"))
    n = rows.count()
    few = 4 * spark.sparkContext.defaultParallelism
    parts = max(1, -(-n // MOST_ROWS), min(few, -(-n * fits // LEAST_WORK)))
    width = len(sets)

    def pack(batches):
        for b in batches:
            if b.num_rows:
                block = {"x": b.column(0).flatten().to_numpy().reshape(b.num_rows, -1), "y": b.column(1).to_numpy(), "key": b.column(2).to_numpy(),
                         "sets": b.column(3).flatten().to_numpy(zero_copy_only=False).reshape(-1, width), "test": b.column(4).to_numpy()}
                yield pa.RecordBatch.from_pydict({"block": pa.array([pickle.dumps(block)], pa.binary())})

    packed = rows.repartition(parts, "key").mapInArrow(pack, "block binary")
    return packed.rdd.map(lambda r: pickle.loads(bytes(r[0]))).persist(StorageLevel.MEMORY_AND_DISK)


def add_up(blocks: RDD, sums):
    """The element-wise total of sums(block), a list of arrays or None, over all blocks."""

    def plus(a, b):
        if a is None or b is None:
            return b if a is None else a
        return [x + y for x, y in zip(a, b)]

    def part(items):
        total = None
        for block in items:
            total = plus(total, sums(block))
        yield total

    return blocks.mapPartitions(part).treeReduce(plus)


def out_of_fold(blocks: RDD, columns, folds: int) -> DataFrame:
    """(trial, fold, y, p) of every test row; columns(block) gives the probability of each (trial, fold) fit per row, with
    the fits of a trial side by side."""
    spark = SparkSession.getActiveSession()

    def rows(block):
        p = columns(block)
        trials = p.shape[1] // folds
        for f in range(folds):
            at = np.flatnonzero(block["test"] == f)
            for t in range(trials):
                for y, v in zip(block["y"][at].tolist(), p[at, t * folds + f].tolist()):
                    yield t, f, y, v

    return spark.createDataFrame(blocks.flatMap(rows), "trial int, fold int, y double, p double")
