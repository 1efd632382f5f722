"""Helpers for classifiers: which rows may be learned from, and bounded samples of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a NULL id counts as the empty text."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def bounded(rows: DataFrame, id_col: str, bound: int) -> DataFrame:
    """At most about `bound` of the rows, drawn evenly by a hash of the id; all of them when there are fewer."""
    total = rows.count()
    if total <= bound:
        return rows
    part = F.pmod(F.xxhash64(F.lit("sample"), F.col(id_col)), F.lit(1_000_000))
    return rows.filter(part < int(1_000_000 * bound / total))
