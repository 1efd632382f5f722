"""Token counts by section: one encoding of the whole document, token spans joined to section spans."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from tickerweave.llm.tokens import BYTE_BPE, encoder, read_ranks

RULES = ("first", "last", "largest")


def line_sections(text: str) -> list[tuple[int, int]]:
    """Spans (start, end) in characters of the lines of a text, each with its line feed; together the whole text."""
    ends = [i + 1 for i, c in enumerate(text) if c == "\n"] if "\n" in text else []
    if not ends or ends[-1] < len(text) or not text:
        ends.append(len(text))
    return list(zip([0, *ends[:-1]], ends, strict=True))


def byte_offsets(raw: bytes) -> np.ndarray:
    """Byte at which each character starts, and the length of the whole."""
    starts = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
    return np.append(starts, len(raw))


def attribute(lengths: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens per section and, of these, those that also lie in another.

    lengths: bytes of each token in order. bounds: where the adjoining sections start, and the end
    of the last. A token in one section counts there. One that crosses bounds counts in the section
    of its first byte ("first"), of its last ("last"), or in the one that holds most of it, the
    earlier at a tie ("largest").
    """
    n = len(bounds) - 1
    ends = np.cumsum(lengths)
    starts = ends - lengths
    left = np.searchsorted(bounds, starts, side="right") - 1
    right = np.searchsorted(bounds, ends - 1, side="right") - 1
    cross = left != right
    home = right if rule == "last" else left.copy()
    if rule == "largest":
        for t in np.flatnonzero(cross):
            parts = range(int(left[t]), int(right[t]) + 1)
            home[t] = max(parts, key=lambda s: (min(ends[t], bounds[s + 1]) - max(starts[t], bounds[s]), -s))
    return np.bincount(home, minlength=n), np.bincount(home[cross], minlength=n)


def count_tokens(docs: DataFrame, text_col: str = "text", sections=line_sections, rule: str = "largest",
                 ranks_path: str = BYTE_BPE) -> DataFrame:
    """Rows of docs, without the text, with n_tokens, n_crossing, n_sections and section_tokens (array, in order).

    Every text is encoded once and whole; the spans of its tokens are then joined to the adjoining
    spans of its sections, which sections(text) gives in characters, and tokens over a border go where
    rule says, see attribute. section_tokens adds up to n_tokens. No row moves between tasks.

    NULL and empty texts: no tokens, one empty section with 0. A section may be empty and then holds
    none. Repeated rows are counted one by one, an empty table stays empty, columns of docs with the
    names of results are replaced and all others pass through.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    new = {"n_tokens": pa.int64(), "n_crossing": pa.int64(), "n_sections": pa.int64(), "section_tokens": pa.list_(pa.int64())}
    kept = [c for c in docs.columns if c not in new and c != text_col]
    base = docs.select(*kept, text_col)

    def count(batches):
        bpe = encoder(ranks.value)
        size_of = np.zeros(max(ranks.value.values()) + 1, np.int64)
        for piece, rank in ranks.value.items():
            size_of[rank] = len(piece)
        for batch in batches:
            rows = []
            for text in batch.column(len(kept)).to_pylist():
                text = text or ""
                ids = np.array(bpe.encode_ordinary(text), np.int64)
                spans = sections(text)
                at = byte_offsets(text.encode("utf-8"))
                bounds = at[[spans[0][0], *[s[1] for s in spans]]]
                if len(ids):
                    each, crossing = attribute(size_of[ids], bounds, rule)
                else:
                    each = crossing = np.zeros(len(spans), np.int64)
                rows.append((len(ids), int(crossing.sum()), len(spans), each.tolist()))
            columns = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), new.values(), strict=True)] if rows else [pa.array([], t) for t in new.values()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *columns], names=[*kept, *new])

    types = StructType.fromDDL("n_tokens long, n_crossing long, n_sections long, section_tokens array<long>")
    return base.mapInArrow(count, StructType(base.schema.fields[: len(kept)] + types.fields))
