"""Training-data pipeline over documents: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickerweave.llm import byte_bpe, decontaminate, labelled, line_dedup, near_dup, quality
from tickerweave.llm.common import shared_folder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject (score of 0.3 and more)."""
    net = quality.learn(docs, _table(spark, sf_dir, "labels"), labelled.fold("doc_id", 5) != 0)
    return quality.score_quality(docs, net, threshold=0.3).filter("predicted = 1").select(*docs.columns)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the lines that 10 or more documents share; n_chars follows the text."""
    out = line_dedup.dedup_lines(docs, min_docs=10, min_chars=1)
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates; one row where rows repeat an id.
    Documents without an id, and without words, are compared with nothing and stay."""
    groups = near_dup.near_duplicates(docs, size=5, percent=75, permutations=64)
    first = groups.filter("kept AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("_rows"))
    rows = docs.join(first, "doc_id")
    lowest = Window.partitionBy("doc_id").orderBy(F.xxhash64(*docs.columns))
    repeated = rows.filter("_rows > 1").withColumn("_rank", F.row_number().over(lowest)).filter("_rank = 1")
    out = rows.filter("_rows = 1").select(*docs.columns).union(repeated.select(*docs.columns))
    return out.union(docs.filter("doc_id IS NULL"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    found = decontaminate.find_contamination(docs, _table(spark, sf_dir, "benchmark"), size=10)
    return found.filter(~F.col("contaminated")).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the bytes that they decode to."""
    out = byte_bpe.encode_texts(docs.select("doc_id", "lang", "source", "text"), keep_text=False, back=True)
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids",
                      F.sha2(F.col("ids_text").cast("binary"), 256).alias("ids_sha256"),
                      F.sha2("ids_bytes", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", drop_shared_lines),
    ("MinHash near-dedup", keep_one_of_each_group),
    ("benchmark decontamination", drop_contaminated),
    ("byte-level BPE", encode),
]

#: The classifier is learned, so SQL cannot repeat the rows; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; results of stages stay in the shared folder."""
    docs = _table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{k}.parquet"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
