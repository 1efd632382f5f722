"""Option chains to daily snapshots, and the snapshot store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickerweave.functions.core import div
from tickerweave.sources.store import overwrite_partitions, stored

# Limits of a usable contract.
MIN_VOLUME = 1
MIN_OPEN_INTEREST = 10
MAX_SPREAD = 0.50
TARGET_DAYS = 30


def usable_contracts(chain: DataFrame) -> DataFrame:
    """Contracts that trade, are quoted tightly and carry a positive implied volatility."""
    mid = (F.col("bid") + F.col("ask")) / 2
    spread = F.coalesce(div(F.col("ask") - F.col("bid"), mid), F.lit(1.0))
    traded = (F.coalesce("volume", F.lit(0.0)) >= MIN_VOLUME) | (
        F.coalesce("open_interest", F.lit(0.0)) >= MIN_OPEN_INTEREST
    )
    return chain.filter(traded & (spread <= MAX_SPREAD) & (F.col("iv") > 0))


def both_sides(calls: DataFrame, puts: DataFrame) -> DataFrame:
    return calls.withColumn("side", F.lit("call")).unionByName(puts.withColumn("side", F.lit("put")))


def atm_iv(chain: DataFrame, spot: DataFrame) -> DataFrame:
    """Distance-weighted volatility of the two nearest strikes per side, and how many were used.

    The rank filter is pushed into the shuffle (window group limit), so a chain
    with very many quotes sends two rows per side and map task.
    """
    keys = ["ticker", "snapshot_date", "expiry"]
    near = usable_contracts(chain).join(spot, ["ticker", "snapshot_date"])
    near = near.withColumn("__d", F.abs(F.col("strike") - F.col("spot")))
    w = Window.partitionBy(*keys, "side").orderBy("__d", "strike", "iv")
    near = near.withColumn("__r", F.row_number().over(w)).filter("__r <= 2")
    weight = 1.0 / (F.col("__d") + 1.0)
    return near.groupBy(*keys).agg(
        div(F.sum(F.col("iv") * weight), F.sum(weight)).alias("atm_iv"),
        F.count(F.lit(1)).cast("int").alias("n_used"),
    )


def constant_maturity(iv_near, d_near, iv_next, d_next, target: int = TARGET_DAYS) -> Column:
    """Volatility at a fixed tenor, linear in total variance between the two expiries."""
    v1, v2 = iv_near * iv_near * d_near, iv_next * iv_next * d_next
    var = v1 + (v2 - v1) * div(target - d_near, d_next - d_near)
    return (
        F.when(iv_near.isNull(), iv_next)
        .when(iv_next.isNull() | d_next.isNull() | (d_next <= d_near), iv_near)
        .when(F.lit(target) <= d_near, iv_near)
        .when(F.lit(target) >= d_next, iv_next)
        .when(var <= 0, iv_near)
        .otherwise(F.sqrt(F.greatest(var, F.lit(0.0)) / target))
    )


def chain_snapshots(chain: DataFrame, spot: DataFrame, fetched_at=None, asked: DataFrame | None = None) -> DataFrame:
    """One snapshot row per ticker and day: near and next expiry, ATM and 30-day volatility, put/call ratios.

    `asked` has the (ticker, snapshot_date) that get a row, by default those of the chain. One without quotes, without a
    price or without an expiry to come is not optionable, used no contract and is NULL otherwise.
    """
    day = ["ticker", "snapshot_date"]
    asked = (chain if asked is None else asked).select(*day).distinct()
    live = chain.filter(F.col("expiry") > F.col("snapshot_date")).join(spot.select(*day), day, "left_semi")
    vol, oi = F.coalesce("volume", F.lit(0.0)), F.coalesce("open_interest", F.lit(0.0))
    call, put = F.col("side") == "call", F.col("side") == "put"
    per_expiry = live.groupBy(*day, "expiry").agg(
        F.sum(F.when(call, vol).otherwise(0.0)).alias("cv"),
        F.sum(F.when(put, vol).otherwise(0.0)).alias("pv"),
        F.sum(F.when(call, oi).otherwise(0.0)).alias("co"),
        F.sum(F.when(put, oi).otherwise(0.0)).alias("po"),
    )
    per_expiry = per_expiry.join(atm_iv(live, spot), [*day, "expiry"], "left")
    # At most a few dozen expiries per ticker and day remain; keep the first two.
    rank = F.row_number().over(Window.partitionBy(*day).orderBy("expiry"))
    two = per_expiry.withColumn("__k", rank).filter("__k <= 2")
    first = lambda k, c: F.max(F.when(F.col("__k") == k, F.col(c)))
    s = two.groupBy(*day).agg(
        first(1, "expiry").alias("near_expiry"),
        first(2, "expiry").alias("next_expiry"),
        first(1, "atm_iv").alias("atm_iv_near"),
        first(2, "atm_iv").alias("atm_iv_next"),
        F.sum(F.coalesce("n_used", F.lit(0))).cast("int").alias("n_contracts_used"),
        first(1, "cv").alias("total_call_volume"),
        first(1, "pv").alias("total_put_volume"),
        first(1, "co").alias("__co"),
        first(1, "po").alias("__po"),
    )
    s = asked.join(s, day, "left").withColumn("n_contracts_used", F.coalesce("n_contracts_used", F.lit(0)))
    d1 = F.datediff("near_expiry", "snapshot_date").cast("double")
    d2 = F.datediff("next_expiry", "snapshot_date").cast("double")
    return s.select(
        F.upper("ticker").alias("ticker"),
        "snapshot_date",
        (F.col("n_contracts_used") >= 2).alias("is_optionable"),
        "near_expiry",
        "next_expiry",
        d1.alias("near_days_to_expiry"),
        d2.alias("next_days_to_expiry"),
        "atm_iv_near",
        "atm_iv_next",
        constant_maturity(F.col("atm_iv_near"), d1, F.col("atm_iv_next"), d2).alias("atm_iv_cm30"),
        F.when(F.col("total_call_volume") > 0, div("total_put_volume", "total_call_volume")).alias("put_call_volume_ratio"),
        F.when(F.col("__co") > 0, div("__po", "__co")).alias("put_call_oi_ratio"),
        "total_call_volume",
        "total_put_volume",
        "n_contracts_used",
        (F.lit(fetched_at).cast("timestamp") if fetched_at is not None else F.current_timestamp()).alias("fetched_at"),
    )


def merge_snapshots(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """One row per (ticker, day); of several the one fetched last stays (idempotent)."""
    both = stored.unionByName(fresh, allowMissingColumns=True)
    cols = [c for c in both.columns if c not in ("ticker", "snapshot_date")]
    best = both.groupBy("ticker", "snapshot_date").agg(F.max_by(F.struct(*cols), "fetched_at").alias("r"))
    return best.select("ticker", "snapshot_date", *[F.col(f"r.{c}").alias(c) for c in cols])


def has_snapshot(stored: DataFrame, tickers: DataFrame, day) -> DataFrame:
    """Which tickers already have a snapshot of the given day."""
    today = stored.filter(F.col("snapshot_date") == F.to_date(F.lit(day))).select("ticker").distinct()
    return tickers.select("ticker").join(today.withColumn("__h", F.lit(True)), "ticker", "left").select(
        "ticker", F.coalesce("__h", F.lit(False)).alias("has_snapshot")
    )


def store_snapshots(spark: SparkSession, path: str, fresh: DataFrame) -> None:
    """Merge a batch into the store; only the months it touches are read and rewritten.

    A stored table whose columns do not fit is an error and stays as it is.
    """
    month = F.date_format("snapshot_date", "yyyy-MM")
    batch = fresh.withColumn("month", month)
    old = stored(spark, path, batch.schema, ("month",))
    if old is not None:
        touched = old.join(batch.select("month").distinct(), "month", "left_semi")
        batch = merge_snapshots(touched.drop("month"), fresh).withColumn("month", month)
    overwrite_partitions(batch, path, "month")


def run_snapshot_batch(spark: SparkSession, path: str, chain: DataFrame, spot: DataFrame, watch: DataFrame) -> DataFrame:
    """Snapshot all watched tickers, store them, and report one status row per ticker."""
    wanted = watch.select(F.upper(F.trim("ticker")).alias("ticker")).distinct()
    fresh = chain_snapshots(chain, spot).join(wanted, "ticker", "left_semi")
    store_snapshots(spark, path, fresh)
    return batch_report(wanted, fresh)


def batch_report(wanted: DataFrame, fresh: DataFrame) -> DataFrame:
    s = fresh.groupBy("ticker").agg(
        F.max("snapshot_date").alias("last_snapshot"),
        F.max(F.col("is_optionable").cast("int")).alias("opt"),
        F.sum("n_contracts_used").alias("contracts"),
    )
    return wanted.join(s, "ticker", "left").select(
        "ticker",
        "last_snapshot",
        F.coalesce("contracts", F.lit(0)).cast("bigint").alias("contracts"),
        F.when(F.col("opt").isNull(), "no_chain").when(F.col("opt") == 1, "ok").otherwise("not_optionable").alias("status"),
    )
