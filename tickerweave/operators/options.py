"""Option-market features on trading days, from stored snapshots and the volatility indices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerweave.functions.core import flag, full, ordered
from tickerweave.functions.moments import rolling_rank_pct
from tickerweave.operators.asof import align_levels, asof_backward

IV_RANK_ROWS = 252
MIN_OPTION_ROWS = 20
SNAPSHOT_FEATURES = [
    "opt_is_optionable", "opt_atm_iv_near", "opt_atm_iv_cm30", "opt_iv_rank_252d", "opt_iv_change_5d",
    "opt_put_call_vol_ratio", "opt_put_call_vol_ratio_ma5", "opt_put_call_oi_ratio",
]
VIX_FEATURES = [
    "vix_level", "vix_high_regime", "vix_elevated_regime", "vix9d_level", "vix3m_level",
    "vix_term_structure_slope", "vix_term_structure_inverted",
]
OPTION_FEATURES = [*SNAPSHOT_FEATURES[:5], "opt_iv_rv_spread", *SNAPSHOT_FEATURES[5:], *VIX_FEATURES]


def iv_rank() -> Column:
    return rolling_rank_pct("atm_iv_cm30", IV_RANK_ROWS, 20)


def snapshot_history_features(snapshots: DataFrame) -> DataFrame:
    """Rank, change and smoothed ratio over the stored snapshot rows of each ticker."""
    s = snapshots.withColumn("date", F.col("snapshot_date"))
    cm, pc = F.col("atm_iv_cm30"), F.col("put_call_volume_ratio")
    return s.select(
        "ticker",
        "date",
        F.col("is_optionable").cast("double").alias("opt_is_optionable"),
        F.col("atm_iv_near").alias("opt_atm_iv_near"),
        cm.alias("opt_atm_iv_cm30"),
        iv_rank().alias("opt_iv_rank_252d"),
        (cm - F.lag(cm, 5).over(ordered())).alias("opt_iv_change_5d"),
        pc.alias("opt_put_call_vol_ratio"),
        full(5, pc, F.avg(pc), need=1).alias("opt_put_call_vol_ratio_ma5"),
        F.col("put_call_oi_ratio").alias("opt_put_call_oi_ratio"),
    )


def snapshot_features(days: DataFrame, snapshots: DataFrame, realized_vol: str | None = "realized_vol_21d") -> DataFrame:
    """Snapshot features as of each trading day; with realised volatility also the spread to it."""
    df = asof_backward(days, snapshot_history_features(snapshots), ["ticker"], values=SNAPSHOT_FEATURES)
    if realized_vol and realized_vol in days.columns:
        df = df.withColumn("opt_iv_rv_spread", F.col("opt_atm_iv_cm30") - F.col(realized_vol)).drop(realized_vol)
    return df


def vix_features(days: DataFrame, series: DataFrame, vix="^VIX", vix9d="^VIX9D", vix3m="^VIX3M") -> DataFrame:
    levels = {vix: "vix_level", vix9d: "vix9d_level", vix3m: "vix3m_level"}
    df = align_levels(days.select("ticker", "date"), series, levels)
    slope = F.col("vix9d_level") - F.col("vix3m_level")
    return df.select(
        "ticker", "date", "vix_level",
        flag(F.col("vix_level") > 30).alias("vix_high_regime"),
        flag(F.col("vix_level") > 20).alias("vix_elevated_regime"),
        "vix9d_level", "vix3m_level",
        slope.alias("vix_term_structure_slope"),
        flag(slope > 0).alias("vix_term_structure_inverted"),
    )


def option_block(days: DataFrame, snapshots: DataFrame, series: DataFrame) -> DataFrame:
    """The 16 option columns; `days` carries realized_vol_21d. Tickers below 20 rows have none."""
    n = F.count(F.lit(1)).over(Window.partitionBy("ticker"))
    days = days.withColumn("__n", n).filter(F.col("__n") >= MIN_OPTION_ROWS).drop("__n")
    left = snapshot_features(days, snapshots)
    return left.join(vix_features(days, series), ["ticker", "date"], "left").select("ticker", "date", *OPTION_FEATURES)


def options_context(snapshots: DataFrame) -> DataFrame:
    """One sentence on current option conditions per ticker; empty when nothing can be said."""
    ranked = snapshots.withColumn("date", F.col("snapshot_date"))
    ranked = ranked.select("ticker", "date", "is_optionable", "atm_iv_cm30", "put_call_volume_ratio", iv_rank().alias("rank"))
    last = ranked.groupBy("ticker").agg(
        F.max_by(F.struct("is_optionable", "atm_iv_cm30", "put_call_volume_ratio", "rank"), "date").alias("s")
    )
    iv, pc, rank = F.col("s.atm_iv_cm30"), F.col("s.put_call_volume_ratio"), F.col("s.rank")
    level = F.when(rank > 0.7, "elevated").when(rank < 0.3, "subdued").otherwise("moderate")
    lean = F.when(pc > 1.1, "bearish").when(pc < 0.9, "bullish").otherwise("balanced")
    parts = F.array_compact(
        F.array(
            F.format_string("30-day ATM implied volatility is %.1f%%", iv * 100),
            F.when(
                rank.isNotNull(),
                F.format_string("IV rank is %.0f%% (%s relative to the past year)", rank * 100, level),
            ),
            F.when(pc.isNotNull(), F.format_string("put/call volume ratio is %.2f (%s positioning)", pc, lean)),
        )
    )
    parts = F.when(iv.isNull(), F.filter(parts, lambda p: ~p.startswith("30-day"))).otherwise(parts)
    text = F.when(
        ~F.coalesce("s.is_optionable", F.lit(False)),
        F.concat("ticker", F.lit(" options market: not liquid enough for a reliable IV signal.")),
    ).when(F.size(parts) == 0, "").otherwise(F.concat("ticker", F.lit(" options market: "), F.array_join(parts, "; "), F.lit(".")))
    return last.select("ticker", text.alias("options_context"))
