"""Exponentially weighted means as a two-level scan over window frames.

The mean starts at the first value. A later value x moves it to (1-b)*mean + b*x, where b is the
smoothing factor a after a value, and a / (a + (1-a)^(g+1)) after a gap of g missing values: what came
before the gap has aged with every row. On a missing value the mean stays as it is.

A key's rows are cut into blocks of 64. Inside a block the scan is a running sum scaled by the product
of its factors, which cannot overflow; the result of each finished block that holds a value is
gathered in order and folded into the rows of the next ones. Only blocks whose weight still counts are
in the frame, so a row carries a bounded list however long its key is. There is no Python and no join.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 64


@dataclass(frozen=True)
class Ewm:
    out: str
    value: Column
    alpha: float
    min_periods: int = 1

    @staticmethod
    def span(out: str, value: Column, span: int) -> "Ewm":
        return Ewm(out, value, 2.0 / (span + 1))


def _carry_values(alpha: float) -> int:
    """Number of values after which older ones weigh less than 1e-18, in whole blocks."""
    return BLOCK * (1 + max(1, math.ceil(math.log(1e-18) / (BLOCK * math.log(1.0 - alpha)))))


def add_ewm(df: DataFrame, specs: list[Ewm], part=("ticker",), order=("date",)) -> DataFrame:
    """Add one smoothed column per spec; specs with the same input share its counters."""
    keep = df.columns
    line = Window.partitionBy(*part).orderBy(*order)
    upto = line.rowsBetween(Window.unboundedPreceding, 0)
    before = line.rowsBetween(Window.unboundedPreceding, -1)

    inputs: dict[str, str] = {}
    staged = []
    for s in specs:
        key = str(s.value)
        if key not in inputs:
            inputs[key] = f"__x{len(inputs)}"
            staged.append(s.value.cast("double").alias(inputs[key]))
    df = df.select("*", *staged)
    df = df.select("*", (F.row_number().over(line) - 1).alias("__rn"), *[F.count(x).over(upto).alias(f"{x}n") for x in inputs.values()])
    rn = F.col("__rn")
    df = df.select(
        "*", (rn % BLOCK).alias("__pos"), F.floor(rn / BLOCK).cast("int").alias("__blk"),
        # Rows from the last value to this one.
        *[(rn - F.last(F.when(F.col(x).isNotNull(), rn), ignorenulls=True).over(before)).alias(f"{x}g") for x in inputs.values()],
    )
    pos, block = F.col("__pos"), F.col("__blk")
    blk = Window.partitionBy(*part, "__blk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)

    names = [inputs[str(s.value)] for s in specs]
    decay, weight = [], []
    for i, (s, x) in enumerate(zip(specs, names, strict=True)):
        later = F.col(x).isNotNull() & (F.col(f"{x}n") > 1)
        old = F.greatest(F.pow(F.lit(1.0 - s.alpha), F.col(f"{x}g")), F.lit(1e-300))
        decay.append(F.sum(F.when(later, F.ln(old / (old + s.alpha))).otherwise(0.0)).over(blk).alias(f"__d{i}"))
        weight.append(F.when(later, F.lit(s.alpha) / (old + s.alpha)).otherwise(1.0).alias(f"__w{i}"))
    df = df.select("*", *decay, *weight)
    local = [
        (F.exp(f"__d{i}") * F.coalesce(F.sum(F.col(f"__w{i}") * F.col(x) * F.exp(-F.col(f"__d{i}"))).over(blk), F.lit(0.0))).alias(f"__l{i}")
        for i, x in enumerate(names)
    ]
    df = df.select("*", *local, *[F.count(x).over(blk).alias(f"{x}b") for x in inputs.values()])
    closing = []
    for i, (s, x) in enumerate(zip(specs, names, strict=True)):
        recent = Window.partitionBy(*part).orderBy(f"{x}n").rangeBetween(-_carry_values(s.alpha), 0)
        end = F.when((pos == BLOCK - 1) & (F.col(f"{x}b") > 0), F.struct(block.alias("k"), F.col(f"__l{i}").alias("v"), F.col(f"__d{i}").alias("d")))
        closing.append(F.collect_list(end).over(recent).alias(f"__e{i}"))
    df = df.select("*", *closing)

    out = []
    for i, (s, x) in enumerate(zip(specs, names, strict=True)):
        done = F.array_sort(F.filter(f"__e{i}", lambda e: e["k"] < block))
        carry = F.aggregate(done, F.lit(0.0), lambda acc, e: acc * F.exp(e["d"]) + e["v"])
        value = F.col(f"__l{i}") + F.when(block > 0, F.exp(f"__d{i}") * carry).otherwise(F.lit(0.0))
        out.append(F.when((F.col(f"{x}n") >= s.min_periods) & (F.col(f"{x}n") > 0), value).alias(s.out))
    return df.select(*keep, *out)
