"""Daily bars: reading, history windows, validation, partitioned storage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickerweave.functions.core import finite

BAR_SCHEMA = T.StructType(
    [
        T.StructField("ticker", T.StringType(), False),
        T.StructField("date", T.DateType(), False),
        *[T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume")],
    ]
)
PRICE_COLUMNS = ["open", "high", "low", "close", "volume"]
MIN_ROWS = 245
SUMMARY_MIN_ROWS = 20
MAX_NULL_RATE = 0.01


def read_bars(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """The required columns of a bar table in any letter case; NaN becomes NULL."""
    if fmt == "csv":
        raw = spark.read.schema(BAR_SCHEMA).option("header", True).csv(path)
    else:
        raw = spark.read.format(fmt).load(path)
    by_name = {c.lower(): c for c in raw.columns}
    return raw.select(
        F.col(by_name["ticker"]).alias("ticker"),
        F.to_date(F.col(by_name["date"])).alias("date"),
        *[finite(F.col(by_name[c]).cast("double")).alias(c) for c in PRICE_COLUMNS],
    )


def trade_order(ts, tie) -> Column:
    """Time of day and integer tie-breaker as one number.

    A fixed-width ordering key keeps min_by / max_by in hash aggregation; with a
    struct Spark would sort all trades before the partial aggregation.
    """
    t = F.col(ts)
    micros = F.unix_micros(t.cast("timestamp")) - F.unix_micros(F.date_trunc("day", t).cast("timestamp"))
    return (micros.cast("decimal(12,0)") * F.lit("10000000000000000000").cast("decimal(20,0)") + F.col(tie).cast("decimal(19,0)")).cast("decimal(38,0)")


def bars_from_trades(df: DataFrame, ticker: str, ts: str, price: str, tie: str, volume=None) -> DataFrame:
    """One bar per ticker and day from single trades; first and last trade decided by `tie`.

    A plain grouped aggregation: partial results are merged before the shuffle,
    so a ticker that holds most of the trades costs no more than the others.
    """
    order = trade_order(ts, tie)
    return df.groupBy(F.col(ticker).alias("ticker"), F.to_date(ts).alias("date")).agg(
        F.min_by(price, order).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, order).alias("close"),
        (F.sum(volume) if volume is not None else F.count(F.lit(1))).cast("double").alias("volume"),
    )


def history_window(bars: DataFrame, end: str, years: int = 5, start: str | None = None) -> DataFrame:
    """Bars in [start, end); start defaults to `years` * 365 days before `end`."""
    stop = F.to_date(F.lit(end))
    begin = F.to_date(F.lit(start)) if start else F.date_sub(stop, years * 365)
    return bars.filter((F.col("date") >= begin) & (F.col("date") < stop))


def validation_report(bars: DataFrame, min_rows: int = MIN_ROWS, expected: DataFrame | None = None) -> DataFrame:
    """Status and first failing reason per ticker, in the fixed order of checks."""
    need = [c for c in PRICE_COLUMNS if c in bars.columns]
    missing = len(need) < len(PRICE_COLUMNS)
    stats = bars.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.greatest(
            *[F.avg(F.col(c).isNull().cast("double")) for c in need],
            F.lit(0.0),
        ).alias("max_null_rate"),
        F.max((F.col("close") <= 0).cast("int")).alias("bad_close") if "close" in need else F.lit(0).alias("bad_close"),
    )
    if expected is not None:
        stats = expected.select("ticker").distinct().join(stats, "ticker", "left")
    n = F.coalesce("n_rows", F.lit(0))
    reason = (
        F.when(n == 0, "empty")
        .when(F.lit(missing), "missing_columns")
        .when(n < min_rows, "too_few_rows")
        .when(F.col("max_null_rate") > MAX_NULL_RATE, "too_many_nulls")
        .when(F.col("bad_close") == 1, "non_positive_close")
    )
    return stats.select(
        "ticker",
        n.alias("n_rows"),
        F.coalesce("max_null_rate", F.lit(0.0)).alias("max_null_rate"),
        F.when(reason.isNull(), "ok").otherwise("rejected").alias("status"),
        F.coalesce(reason, F.lit("")).alias("reason"),
    )


def keep_valid(bars: DataFrame, report: DataFrame) -> DataFrame:
    return bars.join(report.filter("status = 'ok'"), "ticker", "left_semi")


def write_bars(bars: DataFrame, path: str) -> None:
    """Partitioned by ticker; only the tickers in this batch are replaced."""
    (
        bars.withColumn("ingested_at", F.current_timestamp())
        .repartition("ticker")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("ticker")
        .parquet(path)
    )


def read_fresh(spark: SparkSession, path: str, max_age_days: float, now=None) -> DataFrame:
    """Stored bars whose age does not exceed the limit; exactly at the limit still counts as fresh."""
    moment = F.lit(now).cast("timestamp") if now is not None else F.current_timestamp()
    age = moment.cast("double") - F.col("ingested_at").cast("double")
    stored = T.StructType([*BAR_SCHEMA.fields, T.StructField("ingested_at", T.TimestampType())])
    return spark.read.schema(stored).parquet(path).filter(age <= max_age_days * 86400)


def summarize(bars: DataFrame) -> DataFrame:
    """First / last date, rows, price range, mean close and NULL count per ticker."""
    nulls = sum(F.sum(F.col(c).isNull().cast("long")) for c in PRICE_COLUMNS)
    return bars.groupBy("ticker").agg(
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.count(F.lit(1)).alias("n_rows"),
        F.round(F.min("close"), 4).alias("min_close"),
        F.round(F.max("close"), 4).alias("max_close"),
        F.round(F.avg("close"), 4).alias("mean_close"),
        nulls.alias("null_count"),
    )


def year_position(bars: DataFrame) -> DataFrame:
    """Where the mean close of the last 365 days lies between its low and its high, in percent."""
    last = bars.groupBy("ticker").agg(F.max("date").alias("last_date"))
    year = bars.join(last, "ticker").filter(F.col("date") > F.date_sub("last_date", 365))
    s = year.groupBy("ticker").agg(
        F.avg("close").alias("m"), F.min("close").alias("lo"), F.max("close").alias("hi")
    )
    pos = (F.col("m") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(0.01)) * 100
    return s.select("ticker", pos.alias("position_pct"))


def price_series(bars: DataFrame, symbols: list[str]) -> DataFrame:
    """Close series of index symbols as (symbol, date, close)."""
    return bars.filter(F.col("ticker").isin(symbols)).select(F.col("ticker").alias("symbol"), "date", "close")
