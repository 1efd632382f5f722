"""As-of alignment: last row at or before, first row at or after, forward fill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_backward(
    left: DataFrame,
    right: DataFrame,
    by: list[str],
    on: str = "date",
    values: list[str] | None = None,
    bucket: str | None = None,
) -> DataFrame:
    """For each left row the values of the last right row with the same key and `on` not later.

    A matched NULL stays NULL (it is the value of the last row, not the last
    known value). Both sides are stacked and swept once per key, so there is no
    range join. Right rows must be unique per key and time.

    `bucket` (e.g. "month") is for keys whose history has no small bound: keys
    are then swept per (key, period) and the value carried into a period comes
    from one pre-aggregated row per earlier period, so a key that holds most of
    the rows is spread over its periods.
    """
    values = values or [c for c in right.columns if c not in (*by, on)]
    cols = left.columns
    l = left.select(
        *by, F.col(on).alias("__t"), F.lit(1).alias("__left"), F.struct(*cols).alias("__row"),
        F.lit(None).cast(right.select(F.struct(*values).alias("s")).schema["s"].dataType).alias("__val"),
    )
    r = right.select(
        *by, F.col(on).alias("__t"), F.lit(0).alias("__left"),
        F.lit(None).cast(left.select(F.struct(*cols).alias("s")).schema["s"].dataType).alias("__row"),
        F.struct(*values).alias("__val"),
    )
    both = l.unionByName(r)
    keys = list(by)
    if bucket:
        both = both.withColumn("__b", F.date_trunc(bucket, "__t"))
        keys = [*by, "__b"]
    sweep = Window.partitionBy(*keys).orderBy("__t", "__left").rowsBetween(Window.unboundedPreceding, 0)
    # A struct of NULLs is not NULL, so ignoring NULLs skips left rows only.
    hit = F.last("__val", ignorenulls=True).over(sweep)
    if not bucket:
        out = both.select("__left", "__row", hit.alias("__hit")).filter("__left = 1")
    else:
        swept = both.select(*keys, "__left", "__row", hit.alias("__hit")).filter("__left = 1")
        # max_by skips rows whose ordering is NULL only; the struct keeps NULL payloads.
        tails = both.groupBy(*keys).agg(
            F.max_by("__val", F.when(F.col("__left") == 0, F.col("__t"))).alias("__tail")
        )
        before = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
        carry = tails.select(*keys, F.last("__tail", ignorenulls=True).over(before).alias("__carry"))
        out = swept.join(carry, keys, "left").select(
            "__left", "__row", F.coalesce("__hit", "__carry").alias("__hit")
        )
    return out.select(*[F.col(f"__row.{c}").alias(c) for c in cols], *[F.col(f"__hit.{v}").alias(v) for v in values])


def asof_forward(events: DataFrame, calendar: DataFrame, by: list[str], event_on: str, on: str = "date") -> DataFrame:
    """Move each event to the first calendar row of its key at or after it.

    Events after the last calendar row are dropped; of several events that land
    on one row the latest stays. Returns one row per (key, calendar row) hit.
    """
    values = [c for c in events.columns if c not in (*by, event_on)]
    e = events.select(*by, F.col(event_on).cast("date").alias("__t"), F.lit(0).alias("__cal"),
                      F.struct(F.col(event_on).alias("__at"), *values).alias("__val"))
    c = calendar.select(*by, on).distinct().select(
        *by, F.col(on).alias("__t"), F.lit(1).alias("__cal"),
        F.lit(None).cast(e.schema["__val"].dataType).alias("__val"))
    ahead = Window.partitionBy(*by).orderBy("__t", "__cal").rowsBetween(0, Window.unboundedFollowing)
    day = F.first(F.when(F.col("__cal") == 1, F.col("__t")), ignorenulls=True).over(ahead)
    landed = e.unionByName(c).select(*by, day.alias(on), "__cal", "__val").filter(
        (F.col("__cal") == 0) & F.col(on).isNotNull()
    )
    best = landed.groupBy(*by, on).agg(F.max_by("__val", "__val.__at").alias("v"))
    return best.select(*by, on, *[F.col(f"v.{x}").alias(x) for x in values])


def align_symbols(bars: DataFrame, links: DataFrame, series: DataFrame, out: str) -> DataFrame:
    """Bars plus the close, as of each bar date, of the symbol linked to the ticker.

    The calendar is reduced to one row per (symbol, date) first, so a symbol
    shared by many tickers (a broad index) is swept once, not once per ticker.
    """
    linked = bars.join(links.select("ticker", F.col("symbol").alias("__sym")), "ticker", "left")
    cal = linked.select(F.col("__sym").alias("symbol"), "date").distinct()
    level = asof_backward(cal, series.select("symbol", "date", "close"), ["symbol"]).select(
        F.col("symbol").alias("__sym"), "date", F.col("close").alias(out)
    )
    return linked.join(level, ["__sym", "date"], "left").drop("__sym")


def align_levels(bars: DataFrame, series: DataFrame, symbols: dict[str, str]) -> DataFrame:
    """Bars plus one column per symbol ({symbol: column}): its close as of each bar date, for symbols that serve every ticker.

    The series is read once and folded to one row per date with all symbols side by side; the days of the bars are laid
    in, everything is swept once, and one join by date brings the levels back. A matched NULL stays NULL.
    """
    level = lambda s: F.max(F.when(F.col("symbol") == s, F.struct("close")))
    wanted = series.filter(F.col("symbol").isin(*symbols)).groupBy("date").agg(*[level(s).alias(c) for s, c in symbols.items()])
    marked = wanted.withColumn("__day", F.lit(0))
    days = bars.select("date").distinct().withColumn("__day", F.lit(1))
    # A struct of NULLs is not NULL, so ignoring NULLs skips dates without a row of the symbol only.
    sweep = Window.partitionBy(F.lit(0)).orderBy("date", "__day").rowsBetween(Window.unboundedPreceding, 0)
    swept = marked.unionByName(days, allowMissingColumns=True).select(
        "date", "__day", *[F.last(c, ignorenulls=True).over(sweep).alias(c) for c in symbols.values()]
    )
    levels = swept.filter("__day = 1").select("date", *[F.col(f"{c}.close").alias(c) for c in symbols.values()])
    return bars.join(levels, "date", "left")


def pick_level(symbol: Column, symbols: dict[str, str]) -> Column:
    """Of the columns that align_levels added, the one of the row's symbol; NULL for any other symbol."""
    return F.coalesce(*[F.when(symbol == s, F.col(c)) for s, c in symbols.items()])


def align_symbol(bars: DataFrame, series: DataFrame, symbol: str, out: str) -> DataFrame:
    """As above for one symbol."""
    return align_levels(bars, series, {symbol: out})
