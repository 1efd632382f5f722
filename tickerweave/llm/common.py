"""Shared helpers: intermediate tables, lookups that survive hot keys, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot when it holds at least 1/HOT_SHARE of the rows, so at most HOT_SHARE keys are hot.
HOT_SHARE = 1024

WHITE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_folder(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset and the master is
    local (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        folder = getattr(spark, "_llm_folder", None)
        if folder is None:
            folder = spark._llm_folder = tempfile.mkdtemp(prefix="llm-")
    return folder.rstrip("/")


def write_once(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written once to a table of the shared folder: lineage ends there, and lost executors cost nothing.

    A table rather than checkpoint(), which would carry what the optimizer knows of the columns from round to round of
    a loop until planning takes longer than running. The folder's owner removes the tables of finished jobs.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}.parquet"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """write_once for small results of one step of a longer computation."""
    return write_once(df, "step")


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z, every other character as it is."""
    plain = F.octet_length(c) == F.char_length(c)
    return F.when(plain, F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def lookup(left: DataFrame, table: DataFrame, keys: tuple[str, str], weight: str, values: list[str], salt: Column) -> DataFrame:
    """left with the values its key has in table (NULL where it has none).

    keys: a long column and a second column of any type, both never NULL. table has one row per
    key and, as weight, how many rows of left hold it. Hot keys, at most HOT_SHARE by the
    threshold, are broadcast; rows that hold them take no part in the join by key and are
    spread by salt, a long.
    """
    k1, k2 = keys
    total = table.agg(F.sum(weight)).first()[0] or 0
    is_hot = F.col(weight) * HOT_SHARE >= F.lit(total)
    named = lambda side: [F.col(v).alias(f"_{side}_{v}") for v in values]
    hot = table.filter(is_hot).select(F.col(k1).alias("_h1"), F.col(k2).alias("_h2"), F.lit(True).alias("_hot"), *named("hot"))
    cold = table.filter(~is_hot).select(F.col(k1).alias("_c1"), F.col(k2).alias("_c2"), *named("cold"))
    rows = left.join(F.broadcast(hot), (F.col(k1) == F.col("_h1")) & (F.col(k2) == F.col("_h2")), "left")
    rows = rows.withColumn("_k1", F.when(F.col("_hot"), salt).otherwise(F.col(k1)))
    rows = rows.withColumn("_k2", F.when(F.col("_hot").isNull(), F.col(k2)))
    rows = rows.join(cold, (F.col("_k1") == F.col("_c1")) & (F.col("_k2") == F.col("_c2")), "left")
    return rows.select(*left.columns, *[F.coalesce(f"_hot_{v}", f"_cold_{v}").alias(v) for v in values])


def components(edges: DataFrame) -> DataFrame:
    """(node, component): every node of the edges (a, b: long) and the smallest node it reaches.

    Labels fall to the smallest label among the neighbours, then to the label of their label, until none
    changes: about log2 of the longest path rounds of one job each, written to a table. The minimum per node
    is pre-aggregated before its shuffle. Nodes with very many edges, and labels that very many nodes share,
    are on one side of a plain join by key whose other side has one row per key; adaptive execution splits them.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b")
    both = cut(both.distinct())
    labels = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component"))
    labels = cut(labels)
    while True:
        seen = both.join(labels.select(F.col("node").alias("a"), "component"), "a")
        least = seen.groupBy("b").agg(F.min("component").alias("m"))
        step = labels.join(least, labels.node == least.b).select(
            "node", F.col("component").alias("old"), F.least("component", "m").alias("low"))
        # Every label is a node, whose own label before this round is at least as low as it.
        roots = labels.select(F.col("node").alias("low"), F.col("component").alias("root"))
        step = cut(step.join(roots, "low").select("node", "old", F.least("low", "root").alias("component")))
        labels = step.select("node", "component")
        if step.filter("old <> component").limit(1).count() == 0:
            return labels


def frequent_rows(counts: DataFrame, n: str, most: int) -> DataFrame:
    """Rows of counts with the largest n, at most `most`: a value of n is taken with all its rows or not at all."""
    levels = counts.groupBy(n).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc(n)).limit(most + 1).collect()
    least, held = None, 0
    for level in levels:
        if held + level["rows"] > most:
            break
        least, held = level[n], held + level["rows"]
    return counts.filter(F.col(n) >= F.lit(least))
