"""Filter interaction audit: which of five filters removes what, under every order in which they can run.

A document that fails some filters survives exactly the subsets of filters that hold none of those. Its 32 subsets are
the 32 bits of a word: the truth table of "survives", built from one constant word per filter. Counting survivors of all
subsets at once is a positional popcount of the words, taken by carry-save adders.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerweave.llm.common import cut, lookup, write_once

LETTERS = "ABCDE"
SUBSETS = 1 << len(LETTERS)
ALL = (1 << SUBSETS) - 1
#: For each filter the word whose bit S is set where subset S holds the filter.
HOLDS = [sum(1 << s for s in range(SUBSETS) if s >> i & 1) for i in range(len(LETTERS))]
ORDERS = ["".join(p) for p in permutations(LETTERS)]

_UPPER = bytes(range(0x41, 0x5B))
_SYMBOLS = b"#$%&*|"
_CONTINUED = bytes(range(0x80, 0xC0))
#: Rows whose texts are Python objects at a time, and groups that a task counts before it passes them on.
SLICE = 256
GROUPS = 4096


def text_failures(text: bytes) -> int:
    """Bits of the filters that a text fails by itself: A short, B repetitive, C upper case, D symbols."""
    words = text.split()  # bytes split at exactly [\\x20\\x09-\\x0D]
    n = len(words)
    out = 1 if n < 200 else 0
    out |= 2 if 100 * len(set(words)) < 50 * n else 0
    upper = len(text) - len(text.translate(None, _UPPER))
    out |= 4 if upper and 100 * upper > 3 * len(text.translate(None, _CONTINUED)) else 0
    return out | (8 if len(text.translate(None, _SYMBOLS)) < len(text) else 0)


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(doc_id, part, fails): per row of docs the bits of the filters that it fails; bit 4 (E) is a copy of a smaller id's text.

    Copies are found over the whole table by two 64-bit hashes of the text, one row per text that occurs twice or more.
    A text that very many rows share is counted with partial sums and looked up by broadcast (lookup).
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
                       F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("copy"), text).alias("k2"), text.cast("binary").alias("text"))

    def judge(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, SLICE):
                part = batch.slice(a, SLICE)
                fails = [text_failures(t) for t in part.column(4).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(fails, pa.int32())], names=["doc_id", "part", "k1", "k2", "fails"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:4])
    facts = write_once(rows.mapInArrow(judge, fields + ", fails int"), "filter-facts")
    texts = facts.groupBy("k1", "k2").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    found = lookup(facts, cut(texts), ("k1", "k2"), "n", ["first"], F.xxhash64("doc_id"))
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    return found.select("doc_id", "part", (F.col("fails") + F.when(copy, 16).otherwise(0)).alias("fails"))


def survival_word(fails: Column) -> Column:
    """The 32 bits of the subsets that a document survives, as a long."""
    word = F.lit(ALL).cast("long")
    for i, held in enumerate(HOLDS):
        word = word.bitwiseAND(F.when(fails.bitwiseAND(F.lit(1 << i)) == 0, F.lit(ALL)).otherwise(F.lit(ALL ^ held)).cast("long"))
    return word


class Planes:
    """Carry-save counters: words of one group, kept by the weight that their bits stand for."""

    def __init__(self):
        self.levels: list[np.ndarray] = []

    def add(self, words: np.ndarray) -> None:
        """Full adders turn three words of one weight into one of that weight and one of twice the weight, until at most
        two of each weight are left."""
        k = 0
        while len(words):
            if k == len(self.levels):
                self.levels.append(np.empty(0, np.uint32))
            held, carried = np.concatenate([self.levels[k], words]), []
            while len(held) > 2:
                third = len(held) // 3
                a, b, c = held[:third], held[third : 2 * third], held[2 * third : 3 * third]
                half = a ^ b
                carried.append((a & b) | (half & c))
                held = np.concatenate([half ^ c, held[3 * third :]])
            self.levels[k] = held
            words, k = np.concatenate(carried) if carried else held[:0], k + 1

    def counts(self) -> np.ndarray:
        """How often each bit was set."""
        out = np.zeros(SUBSETS, np.int64)
        for k, held in enumerate(self.levels):
            for word in held.tolist():
                out += np.array([word >> s & 1 for s in range(SUBSETS)], np.int64) << k
        return out


def survivors(rows: DataFrame) -> DataFrame:
    """(part, label, survivors): of rows (part string, label int, word long) the survivors of each subset, one row per
    task and group; tasks hold a bounded number of groups."""

    def count(batches):
        held: dict[tuple, Planes] = {}

        def flush():
            keys = list(held)
            lists = [held[k].counts().tolist() for k in keys]
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array(lists, pa.list_(pa.int64()))],
                names=["part", "label", "survivors"])

        for batch in batches:
            names = batch.column(0).dictionary_encode()
            group = names.indices.to_numpy(zero_copy_only=False).astype(np.int64) * 4 + batch.column(1).to_numpy(zero_copy_only=False)
            words = batch.column(2).to_numpy(zero_copy_only=False).astype(np.uint32)
            order = np.argsort(group, kind="stable")
            group, words = group[order], words[order]
            edges = np.flatnonzero(np.diff(group)) + 1
            parts = names.dictionary.to_pylist()
            for a, b in zip([0, *edges], [*edges, len(group)]):
                if a < b:
                    key = (parts[group[a] >> 2], int(group[a] & 3))
                    held.setdefault(key, Planes()).add(words[a:b])
                    if len(held) >= GROUPS:
                        yield flush()
        if held:
            yield flush()

    return rows.select("part", "label", "word").mapInArrow(count, "part string, label int, survivors array<long>")


def interactions(counts: DataFrame) -> DataFrame:
    """The report of all 120 orders from (part, label, survivors); label is 1 for good plus 2 for toxic."""
    of = lambda s, keep: F.sum(F.when(keep, F.col("survivors")[s]).otherwise(F.lit(0)))
    vector = lambda keep: F.array(*[of(s, keep) for s in range(SUBSETS)])
    good, toxic = (F.col("label").bitwiseAND(F.lit(bit)) > 0 for bit in (1, 2))
    per = counts.groupBy("part").agg(vector(F.lit(True)).alias("all"), vector(good).alias("good"), vector(toxic).alias("toxic"))
    per = cut(per)

    n = len(LETTERS)
    shares = []
    for i in range(n):
        share = F.lit(0).cast("long")
        for s in range(SUBSETS):
            if not s >> i & 1:
                size = bin(s).count("1")
                share = share + (F.col("all")[s] - F.col("all")[s | 1 << i]) * F.lit(factorial(size) * factorial(n - 1 - size))
        shares.append(share)
    per = per.withColumn("shares", F.array(*shares))

    steps = []
    for order in ORDERS:
        before = 0
        for step, letter in enumerate(order, 1):
            steps.append((order, step, LETTERS.index(letter), before))
            before |= 1 << LETTERS.index(letter)
    literal = lambda k, kind: F.split(F.lit(",".join(str(s[k]) for s in steps)), ",").cast(f"array<{kind}>")
    lists = F.arrays_zip(literal(0, "string").alias("filter_order"), literal(1, "int").alias("step"), literal(2, "int").alias("i"),
                         literal(3, "int").alias("before"))
    rows = per.select("*", F.inline(lists))
    bit = F.expr("shiftleft(1, i)")
    rows = rows.withColumns({"bit": bit, "after": F.col("before").bitwiseOR(bit)})
    at = lambda v, s: F.col(v)[s]
    removed = at("all", F.col("before")) - at("all", F.col("after"))
    failing = at("all", F.lit(0)) - at("all", F.col("bit"))
    only = F.lit(SUBSETS - 1).bitwiseXOR(F.col("bit"))
    return rows.select(
        "part", "filter_order", "step", at("all", F.col("after")).alias("kept"), removed.alias("removed"),
        (failing - removed).alias("redundant"), (at("all", only) - at("all", F.lit(SUBSETS - 1))).alias("unique_fails"),
        (at("good", F.col("before")) - at("good", F.col("after"))).alias("good_lost"),
        (at("toxic", F.col("before")) - at("toxic", F.col("after"))).alias("toxic_lost"),
        at("shares", F.col("i")).alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row per part, order of the filters and step, with what the step keeps, removes and loses.

    NULL texts count as empty ones, an NULL part as "". An id that has several rows is judged row by row, and its rows do not
    count as copies of each other; a NULL id is neither a copy nor the first of its copies. An id with several labels is good
    (toxic) if one of them says so, without labels it is neither. An empty table gives no rows. Other columns play no part.
    """
    marks = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_label_id")).agg(
        (F.max(F.when(F.col("quality") == 1, 1).otherwise(0)) + F.max(F.when(F.col("toxic") == 1, 2).otherwise(0))).alias("label"))
    rows = failures(docs, id_col, text_col, part_col)
    rows = rows.join(marks, F.col("doc_id") == F.col("_label_id"), "left")
    rows = rows.select("part", F.coalesce("label", F.lit(0)).cast("int").alias("label"), survival_word(F.col("fails")).alias("word"))
    return interactions(survivors(rows))
