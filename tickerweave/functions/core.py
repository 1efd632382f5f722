"""Null-safe arithmetic, frames and rounding used by every operator.

Missing values are always NULL, never NaN: a NaN compares greater than any
number in Spark, which would turn every threshold flag wrong.
"""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

TRADING_DAYS = 252


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def div(a, b) -> Column:
    """a / b, NULL where b is 0 or either side is missing."""
    return F.try_divide(col(a), col(b))


def finite(c) -> Column:
    """NaN and infinities become NULL."""
    c = col(c)
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), None).otherwise(c)


def safe_double(c) -> Column:
    """Text (or any scalar) to a finite double, NULL when it is not one."""
    return finite(col(c).try_cast("double"))


def flag(cond: Column) -> Column:
    """1 when the condition holds, 0 when it does not or is unknown."""
    return F.coalesce(cond.cast("int"), F.lit(0))


def rnd(c, places: int = 6) -> Column:
    """Rounded value without a negative zero."""
    return F.round(col(c), places) + F.lit(0.0)


def ordered(part=("ticker",), order=("date",)):
    return Window.partitionBy(*part).orderBy(*order)


def trailing(n: int, part=("ticker",), order=("date",)):
    """Last n rows, current one included."""
    return ordered(part, order).rowsBetween(-(n - 1), 0)


def running(part=("ticker",), order=("date",)):
    return ordered(part, order).rowsBetween(Window.unboundedPreceding, 0)


def full(n: int, value: Column, agg: Column, part=("ticker",), order=("date",), need: int | None = None) -> Column:
    """Rolling aggregate that is NULL until `need` (default n) non-null values are in the frame."""
    w = trailing(n, part, order)
    return F.when(F.count(value).over(w) >= (need or n), agg.over(w))


def sma(c, n: int, **kw) -> Column:
    c = col(c)
    return full(n, c, F.avg(c), **kw)


def pct_change(c, k: int, part=("ticker",), order=("date",)) -> Column:
    """Change over k rows; a missing value counts as the last one before it."""
    past = ordered(part, order).rowsBetween(Window.unboundedPreceding, -k)
    return div(ffill(c, part, order), F.last(col(c), ignorenulls=True).over(past)) - 1


def log_return(c, part=("ticker",), order=("date",)) -> Column:
    c = col(c)
    return F.ln(div(c, F.lag(c, 1).over(ordered(part, order))))


def ffill(c, part=("ticker",), order=("date",)) -> Column:
    """Last non-null value up to and including this row."""
    return F.last(col(c), ignorenulls=True).over(running(part, order))


def wide_frame(df, columns: dict[str, Column]):
    """Add many columns in one projection."""
    return df.select("*", *[v.alias(k) for k, v in columns.items()])
