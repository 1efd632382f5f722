"""Benchmark decontamination: Aho-Corasick automata over normalised windows of benchmark words."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tickerweave.llm.common import UPPER, write_once

#: A word: ASCII letters and digits and every character beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Most bytes of window text that one automaton, and so one broadcast, may hold.
BLOCK_BYTES = 16 << 20

_SPACES = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()
_SPANS = "array<struct<start:long,end:long,item_id:string>>"


def normal_words(text: str | None) -> list[bytes]:
    """Words of a text in UTF-8, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_SPACES).split()


def windows(items: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(window, items): each run of `size` words, or the whole of a shorter item, with the ids that hold it."""
    text = F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, UPPER.lower())
    words = items.select(F.col(id_col).cast("string").alias("item"), F.regexp_extract_all(text, F.lit(f"({WORD})")).alias("w"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    words = words.filter(F.size("w") > 0).select("item", "w", F.explode(starts).alias("s"))
    words = words.select("item", F.array_join(F.slice("w", F.col("s"), size), " ").alias("window")).distinct()
    return words.groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _automaton(patterns: list[tuple[str, list[str]]]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for window, items in patterns:
        # One byte is one character, so that offsets are offsets of bytes; blanks keep matches on word borders.
        raw = window.encode("utf-8", "surrogatepass")
        found.add_word(f" {raw.decode('latin-1')} ", (len(raw), items))
    found.make_automaton()
    return found


def _scan(text: str, words: list[bytes], automaton) -> tuple[int, list[tuple[int, int, str]]]:
    """Words under any match, and the word ranges [start, end) of the matches by item."""
    line = b" " + b" ".join(words) + b" "
    hits = list(automaton.iter(line.decode("latin-1")))
    if not hits:
        return 0, []
    begins = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)[:-1]
    spans = []
    cover = np.zeros(len(words) + 1, np.int64)
    for last, (size, items) in hits:
        a, b = int(np.searchsorted(begins, last - size - 1)), int(np.searchsorted(begins, last - 1, side="right"))
        cover[a] += 1
        cover[b] -= 1
        spans += [(a, b, i) for i in items]
    return int((np.cumsum(cover[:-1]) > 0).sum()), spans


_FINDER = re.compile(WORD)
_LOWER = str.maketrans(UPPER, UPPER.lower())


def _original(text: str, spans: list[tuple[int, int, str]]) -> list[dict]:
    """Word ranges as character offsets of the text as it came; ranges of an item that touch are one."""
    at = [m.span() for m in _FINDER.finditer(text.translate(_LOWER))]
    merged: list[list] = []
    for item, a, b in sorted((i, a, b) for a, b, i in spans):
        if merged and merged[-1][0] == item and a <= merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([item, a, b])
    return [{"start": at[a][0], "end": at[b - 1][1], "item_id": i} for i, a, b in merged]


def find_contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       item_id: str = "item_id", item_text: str = "text", size: int = 10,
                       block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows of docs with n_words, n_hit (words inside any window), n_items, items_sha256, contaminated and
    spans: (start, end, item_id) in characters of the original text.

    The windows of all items form one automaton, broadcast after its size is measured. Were they over
    block_bytes, they would be cut into blocks by hash and every text scanned once per block, with the
    hits of a text merged by word. Texts are whole and no row moves.

    NULL and empty texts have no words. Items without words, or with NULL text, match nothing; a NULL
    item_id takes part as "" in the joined ids. Equal windows of several items count for each of them,
    repeated rows of docs are judged alike one by one, an empty table of docs or items gives no rows
    or no hits. Columns of docs with the names of results are replaced; all others pass through.
    """
    patterns = write_once(windows(items.withColumn(item_id, F.coalesce(F.col(item_id).cast("string"), F.lit(""))),
                                  item_id, item_text, size), "windows")
    total = patterns.agg(F.sum(F.octet_length("window") + 64)).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    spark = docs.sparkSession
    sent = []
    for b in range(blocks):
        part = patterns.filter(F.pmod(F.xxhash64("window"), F.lit(blocks)) == b) if blocks > 1 else patterns
        sent.append(spark.sparkContext.broadcast([(r[0], list(r[1])) for r in part.collect()]))

    new = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"]
    kept = [c for c in docs.columns if c not in new]
    text_at = kept.index(text_col)
    base = docs.select(*kept)

    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("item_id", pa.string())])
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(span)]

    def scan(batches):
        machines = [_automaton(s.value) for s in sent]
        for batch in batches:
            out = {n: [] for n in new}
            for text in batch.column(text_at).to_pylist():
                words = normal_words(text)
                spans: list[tuple[int, int, str]] = []
                hit = 0
                for machine in machines if words else []:
                    if len(machine):
                        hit, more = _scan(text, words, machine)
                        spans += more
                if spans and len(machines) > 1:
                    cover = np.zeros(len(words) + 1, np.int64)
                    np.add.at(cover, [s[0] for s in spans], 1)
                    np.add.at(cover, [s[1] for s in spans], -1)
                    hit = int((np.cumsum(cover[:-1]) > 0).sum())
                ids = sorted({s[2] for s in spans})
                out["n_words"].append(len(words))
                out["n_hit"].append(hit)
                out["n_items"].append(len(ids))
                out["items_sha256"].append(hashlib.sha256(",".join(ids).encode()).hexdigest())
                out["contaminated"].append(bool(spans))
                out["spans"].append(_original(text, spans) if spans else [])
            columns = [pa.array(out[n], kind) for n, kind in zip(new, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*kept, *new])

    types = StructType.fromDDL(f"n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans {_SPANS}")
    return base.mapInArrow(scan, StructType(base.schema.fields + types.fields))
