"""Running totals over a long ordering, spread over many tasks."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickerweave.functions.ranks import at_ranks, from_key

BUCKETS = 128
#: Rows that a task sorts at least before a group is cut.
PIECE = 1 << 18
#: Keys that a group's rows are spread over where they meet its cuts.
SALTS = 32


def _bucket(cuts: Column, value: Column, most: int = BUCKETS) -> Column:
    """How many of the at most `most` - 1 sorted cuts lie below the value, by halving."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range((most - 1).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(cuts, at + step - 1) < value, at + step).otherwise(at))


def _order_key(df: DataFrame, order: str) -> Column:
    """A long or double that never falls along the order, NULLs first. Values that share one are told apart by the order itself."""
    kind, c = df.schema[order].dataType, F.col(order)
    if isinstance(kind, T.TimestampType):
        c = F.unix_micros(c)
    elif isinstance(kind, T.DateType | T.TimestampNTZType):
        c = F.unix_date(c.cast("date")).cast("long")
    elif isinstance(kind, T.IntegralType):
        c = c.cast("long")
    elif isinstance(kind, T.NumericType):
        return F.coalesce(c.cast("double"), F.lit(float("-inf")))
    else:
        raise TypeError(f"{order} must be a number, a date or a time, not {kind.simpleString()}")
    return F.coalesce(c, F.lit(-(1 << 63)))


def row_numbers(df: DataFrame, part: list[str], order: str, number: str, count: str, marks: Column | None = None, passed: str = "") -> DataFrame:
    """Adds the 0-based place of a row in the order of its group, rows with equal `order` in any order, and the group's size.

    No task sorts a whole group: groups are cut at exact ranks of `order`, a number, date or time, which are found by reading
    that column some four times. Keys and `order` may be NULL. One row per group goes through the driver.

    `marks`, an array made from `count`, are row numbers; `passed` then tells how many of them a row has reached. That takes
    no sorting where the rows on both sides of a mark differ in `order`, so a job that reads `passed` but not `number` moves
    none but the rows that are equal there. These are numbered by their other columns, the same way each time.
    """
    spark = df.sparkSession
    keys = [f"__g{k}" for k in range(len(part))]
    same = reduce(lambda a, b: a & b, [F.col(p).eqNullSafe(F.col(k)) for p, k in zip(part, keys)])
    groups = df.groupBy(*[F.col(p).alias(k) for p, k in zip(part, keys)]).agg(F.count(F.lit(1)).alias(count))
    groups = groups.withColumn("__marks", F.array().cast("array<long>") if marks is None else marks.cast("array<long>")).toArrow()
    wide = len(groups.column("__marks")[0]) if len(groups) else 0
    key = _order_key(df, order)
    of = spark.createDataFrame(groups.select(keys).append_column("__of", pa.array(range(len(groups)), pa.int32())))
    values = df.select(*part, key.alias("__x")).join(of, same).select(F.col("__of").alias("g"), F.lit(0).alias("c"), F.col("__x").alias("x0"))
    double = values.schema["x0"].dataType.typeName() == "double"
    asked = []

    def wanted(sizes):
        for g, at in enumerate(groups.column("__marks").to_pylist()):
            n = int(sizes[g][0])
            pieces = min(BUCKETS, -(-n // PIECE))
            asked.extend((g, m, min(m, n)) for m in at if m > 0)
            asked.extend((g, None, n * k // pieces) for k in range(1, pieces))
        return [(g, 1, r) for g, _, r in asked]

    _, found = at_ranks(values, len(groups), wanted)
    table = [{"__cuts": {}} for _ in range(len(groups))]
    at_mark = [{} for _ in range(len(groups))]
    for (g, m, r), (k, below, upto) in zip(asked, found):
        table[g]["__cuts"][k] = int(upto[0])
        if m is not None:
            at_mark[g][m] = k, int(below[0]) if upto[0] > r else None
    ties = False
    for g, (row, at) in enumerate(zip(table, groups.column("__marks").to_pylist())):
        cuts = sorted(row["__cuts"].items())
        row["__cuts"], row["__upto"] = [from_key(k) if double else k for k, _ in cuts], [0, *[n for _, n in cuts]]
        for j, m in enumerate(at):
            k, below = at_mark[g].get(m, (None, None))
            row[f"__m{j}"], row[f"__l{j}"] = from_key(k) if double and k is not None else k, below
            ties = ties or below is not None
    kind = pa.float64() if double else pa.int64()
    kinds = {"__cuts": pa.list_(kind), "__upto": pa.list_(pa.int64())} | {f"__{c}{j}": t for j in range(wide) for c, t in (("m", kind), ("l", pa.int64()))}
    for c, t in kinds.items():
        groups = groups.append_column(c, pa.array([row[c] for row in table], t))
    d = df.withColumn("__x", key).join(spark.createDataFrame(groups), same)
    x = F.col("__x")
    # Rows equal to the one before a mark, some of them behind it.
    tied = reduce(lambda a, b: a | b, [F.col(f"__l{j}").isNotNull() & (F.col(f"__m{j}") == x) for j in range(wide)], F.lit(False))
    inside = d.filter(~tied) if ties else d
    inside = inside.withColumn("__b", _bucket(F.col("__cuts"), x, 2 * BUCKETS))
    w = Window.partitionBy(*part, "__b").orderBy(order)
    place = F.get("__upto", F.col("__b")) + F.row_number().over(w) - 1
    reached = reduce(lambda a, b: a + b, [F.when(F.col(f"__m{j}").isNull() | (F.col(f"__m{j}") < x), 1).otherwise(0) for j in range(wide)], F.lit(0))
    added = lambda n, p: [n.cast("long").alias(number), count, *([p.cast("int").alias(passed)] if passed else [])]
    out = inside.select(*df.columns, *added(place, reached))
    if not ties:
        return out
    rest = [f.name for f in df.schema if f.name not in (*part, order) and "map<" not in f.dataType.simpleString()]
    below = F.coalesce(*[F.when(F.col(f"__m{j}") == x, F.col(f"__l{j}")) for j in range(wide)])
    d = d.filter(tied).withColumn("__n", below + F.row_number().over(Window.partitionBy(*part, "__x").orderBy(order, *rest)) - 1)
    return out.unionByName(d.select(*df.columns, *added(F.col("__n"), F.size(F.filter("__marks", lambda m: m <= F.col("__n"))))))


def running_totals(df: DataFrame, part: list[str], order: str, totals: dict[str, Column]) -> DataFrame:
    """Adds, per output name, the sum of the column over all rows with a smaller `order` value.

    Rows must be unique on (part, order). The ordering is cut at approximate
    quantiles; a window over at most 128 bucket totals carries the sums across
    buckets, a second window runs inside each bucket. No task sorts a whole group, and a group's rows meet its cuts
    under SALTS keys.
    """
    cuts = F.array(*[F.lit(k / BUCKETS) for k in range(1, BUCKETS)])
    bounds = df.groupBy(*part).agg(F.percentile_approx(order, cuts, F.lit(10 * BUCKETS)).alias("__cuts"))
    value = F.col(order)
    bounds = bounds.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    d = df.withColumn("__salt", F.pmod(F.xxhash64(order), F.lit(SALTS)).cast("int"))
    d = d.join(bounds, [*part, "__salt"]).drop("__salt").withColumn("__b", _bucket(F.col("__cuts"), value)).drop("__cuts")
    d = d.withColumns({f"__v_{k}": c for k, c in totals.items()})
    sums = d.groupBy(*part, "__b").agg(*[F.sum(f"__v_{k}").alias(k) for k in totals])
    before = Window.partitionBy(*part).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*part, "__b", *[F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"__o_{k}") for k in totals])
    inside = Window.partitionBy(*part, "__b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    d = d.join(sums, [*part, "__b"])
    return d.select(
        *df.columns,
        *[(F.col(f"__o_{k}") + F.coalesce(F.sum(f"__v_{k}").over(inside), F.lit(0))).alias(k) for k in totals],
    )
