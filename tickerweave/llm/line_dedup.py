"""Line dedup: lines that many documents share lose every occurrence. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerweave.llm.common import WHITE, cut, lookup, lower_ascii, write_once


def split_lines(text) -> Column:
    """Lines of a text; NULL and empty texts are one empty line."""
    return F.split(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without ASCII white space at both ends, A-Z lower-cased."""
    return lower_ascii(F.btrim(line, F.lit(WHITE)))


def keep_lines(text: Column, dropped: Column) -> Column:
    """Text without the lines at the dropped positions (from 1); one linear pass, order kept."""
    bound = F.array(F.struct(split_lines(text).alias("lines"), dropped.alias("dropped")))

    def rejoin(s):
        kept = F.array_except(F.sequence(F.lit(1), F.size(s["lines"])), s["dropped"])
        return F.array_join(F.transform(kept, lambda i: F.element_at(s["lines"], i)), "\n")

    return F.element_at(F.transform(bound, rejoin), 1)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10,
                min_chars: int = 1) -> DataFrame:
    """All columns of docs, text_col without shared lines, plus n_lines and n_dropped (long).

    A line's key of at least min_chars code points that occurs in at least min_docs distinct
    documents (ids) loses all its lines. Keys travel as two 64-bit hashes; only (id, row hash,
    position, key) is shuffled for the counts, and the text once, for the rewrite. A line that a
    large share of documents holds is counted with partial sums and looked up by broadcast.

    NULL text: one empty line, and the text becomes "". Rows that repeat an id are rewritten one
    by one, and count as one document; NULL is an id like any other. Ties cannot arise. An empty
    table gives an empty table. Other columns, whatever their names, pass through.
    """
    columns = docs.columns
    row = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    row = row.withColumn("_row", F.xxhash64("_text"))
    lines = row.select("_id", "_row", F.posexplode(split_lines("_text")).alias("_pos", "_line"))
    keys = lines.select("_id", "_row", (F.col("_pos") + 1).alias("_pos"), line_key(F.col("_line")).alias("_key"))
    keys = keys.filter((F.col("_key") != "") & (F.char_length("_key") >= min_chars)).select(
        "_id", "_row", "_pos", F.xxhash64("_key").alias("_k1"), F.xxhash64(F.lit("line"), "_key").alias("_k2"))
    keys = write_once(keys, "line-keys")

    found = F.count_distinct("_id") + F.max(F.col("_id").isNull().cast("int"))
    common = keys.groupBy("_k1", "_k2").agg(found.alias("_docs"), F.count(F.lit(1)).alias("_n"))
    common = cut(common.filter(F.col("_docs") >= min_docs).withColumn("_drop", F.lit(True)))

    marked = lookup(keys, common, ("_k1", "_k2"), "_n", ["_drop"], F.xxhash64("_id", "_pos")).filter("_drop")
    dropped = marked.groupBy("_id", "_row").agg(F.collect_set("_pos").alias("_dropped"))
    dropped = dropped.select(F.col("_id").alias("_did"), F.col("_row").alias("_drow"), "_dropped")

    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = docs.withColumn("_id", F.col(id_col)).withColumn("_row", F.xxhash64(text))
    out = docs.join(dropped, F.col("_id").eqNullSafe(F.col("_did")) & (F.col("_row") == F.col("_drow")), "left")
    rest = [F.col(c) for c in columns if c not in (text_col, "n_lines", "n_dropped")]
    new = F.when(F.col("_dropped").isNull(), text).otherwise(keep_lines(text, F.col("_dropped"))).alias(text_col)
    n_lines = (F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")
    return out.select(*rest, new, n_lines.alias("n_lines"),
                      F.coalesce(F.size("_dropped"), F.lit(0)).cast("long").alias("n_dropped"))
