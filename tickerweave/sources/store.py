"""Parquet tables that are read, merged and overwritten by partition."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def stored(spark: SparkSession, path: str, schema: StructType, partitions: tuple[str, ...] = ()) -> DataFrame | None:
    """The table at path, None before its first write.

    Only a missing path counts as "not written yet". A stored column that is absent from schema, or of another
    type, is an error, as overwriting the table would lose it.
    """
    try:
        found = spark.read.parquet(path)
    except AnalysisException as exc:
        if exc.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    want = {f.name: f.dataType for f in schema}
    clash = [f.name for f in found.schema if f.name not in partitions and want.get(f.name) != f.dataType]
    if clash:
        raise ValueError(f"{path}: stored columns do not fit the new rows: {', '.join(clash)}")
    return spark.read.schema(schema).parquet(path)


def overwrite_partitions(rows: DataFrame, path: str, by: str) -> None:
    """Replaces the partitions that rows touch, with rows that may have been read from path.

    The rows go to a side folder of their own first, as a table cannot be read and overwritten in one job.
    """
    spark = rows.sparkSession
    side = f"{path.rstrip('/')}__staged-{uuid.uuid4().hex}"
    rows.write.option("partitionOverwriteMode", "static").parquet(side)
    spark.read.schema(rows.schema).parquet(side).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(side)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
