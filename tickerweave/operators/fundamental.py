"""Fundamental, earnings and macro features; peer cross-sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerweave.functions.cumulative import running_totals
from tickerweave.functions.core import div, ffill, flag, ordered, pct_change, trailing, wide_frame
from tickerweave.operators.asof import align_levels, asof_backward, asof_forward, pick_level
from tickerweave.operators.sector import MACRO_SECTOR_ETF, MARKET_SYMBOL, lookup
from tickerweave.operators.technical import by_ticker

# Feature name to payload key.
STATIC_FIELDS = {
    "fund_trailing_pe": "trailingPE",
    "fund_forward_pe": "forwardPE",
    "fund_price_to_book": "priceToBook",
    "fund_ev_to_ebitda": "enterpriseToEbitda",
    "fund_profit_margin": "profitMargins",
    "fund_operating_margin": "operatingMargins",
    "fund_revenue_growth": "revenueGrowth",
    "fund_earnings_growth": "earningsGrowth",
    "fund_debt_to_equity": "debtToEquity",
    "fund_current_ratio": "currentRatio",
    "fund_institutional_pct": "institutionPercentHeld",
    "fund_short_interest_ratio": "shortPercentOfFloat",
}
PEER_COLUMNS = ["fund_trailing_pe", "fund_price_to_book", "fund_ev_to_ebitda", "fund_profit_margin"]
MIN_PRICE_ROWS = 20


def snapshot(fundamentals: DataFrame) -> DataFrame:
    """Scalar ratios of each company with the three derived ones."""
    fcf, cap = F.col("freeCashflow"), F.col("marketCap")
    keys = [c for c in ("ticker", "as_of") if c in fundamentals.columns]
    return fundamentals.select(
        *keys,
        "sector",
        *[F.col(k).alias(f) for f, k in STATIC_FIELDS.items()],
        (div("forwardPE", "trailingPE") - 1).alias("fund_pe_premium"),
        F.when(cap > 0, div(fcf, cap)).alias("fund_fcf_yield"),
        (fcf / 1e6).alias("free_cash_flow_m"),
    )


def spread_snapshot(bars: DataFrame, snap: DataFrame, mode: str = "latest") -> DataFrame:
    """Ratios on every trading day: the latest snapshot everywhere, or as of each date.

    mode="asof" needs dated snapshots and never looks ahead.
    """
    names = [c for c in snap.columns if c.startswith("fund_")]
    days = bars.select("ticker", "date")
    if mode == "asof":
        return asof_backward(days, snap.select("ticker", F.col("as_of").alias("date"), *names), ["ticker"])
    return days.join(snap.select("ticker", *names), "ticker", "left")


def earnings_features(bars: DataFrame, earnings: DataFrame, mode: str = "lag1") -> DataFrame:
    """Last surprise carried forward, and the previous one.

    mode="lag1" shifts the placed values by one trading row before the fill;
    mode="quarter" takes the surprise of the announcement before.
    """
    placed = asof_forward(earnings.select("ticker", "announced", "surprise_pct"), bars, ["ticker"], "announced")
    if mode == "quarter":
        prev = F.lag("surprise_pct", 1).over(ordered())
        placed = placed.select("ticker", "date", "surprise_pct", prev.alias("__prev"))
    df = bars.select("ticker", "date").join(placed, ["ticker", "date"], "left")
    shifted = F.col("__prev") if mode == "quarter" else F.lag("surprise_pct", 1).over(ordered())
    df = df.select("ticker", "date", "surprise_pct", shifted.alias("__p"))
    return df.select(
        "ticker", "date",
        ffill("surprise_pct").alias("fund_earnings_surprise_pct"),
        ffill("__p").alias("fund_prev_earnings_surprise_pct"),
    )


def macro_features(
    bars: DataFrame,
    series: DataFrame,
    assets: DataFrame,
    lookback: int = 21,
    vix: str = "^VIX",
    long_yield: str = "^TNX",
    short_yield: str | None = "^IRX",
) -> DataFrame:
    """Volatility index level and z-score, yield-curve slope, sector fund against the market.

    Without a short yield the slope columns give way to the long yield alone.
    """
    links = assets.select("ticker", lookup(MACRO_SECTOR_ETF, "sector").alias("symbol"))
    funds = {etf: f"__fund_{k}" for k, etf in enumerate(sorted(set(MACRO_SECTOR_ETF.values())))}
    market = funds.setdefault(MARKET_SYMBOL, "__market")
    levels = {vix: "macro_vix", long_yield: "__long"} | ({short_yield: "__short"} if short_yield else {})
    df = align_levels(bars.select("ticker", "date").join(links, "ticker", "left"), series, levels | funds)
    df = df.withColumns({"__sector": pick_level(F.col("symbol"), funds), "__market": F.col(market),
                         "__linked": F.col("symbol").isNotNull()})
    df = by_ticker(df.drop("symbol", *[c for c in funds.values() if c != "__market"]))
    v, w = F.col("macro_vix"), trailing(20)
    n = F.count(v).over(w)
    z = F.when(n >= 5, div(v - F.avg(v).over(w), F.stddev_samp(v).over(w)))
    sec, mkt = pct_change("__sector", lookback), pct_change("__market", lookback)
    out: dict[str, Column] = {
        "macro_vix_zscore_20": z,
        "macro_high_vix": flag(v > 25),
        "macro_sector_rel_perf": sec - mkt,
        "macro_sector_outperforming": F.when(F.col("__linked"), flag(sec > mkt)),
    }
    if short_yield:
        slope = F.col("__long") - F.col("__short")
        out |= {"macro_yield_curve_slope": slope, "macro_yield_curve_inverted": flag(slope < 0)}
    else:
        out |= {"macro_10yr_yield": F.col("__long")}
    return wide_frame(df, out).drop("__long", "__short", "__market", "__sector", "__linked")


def fundamental_block(bars, fundamentals, earnings, series, assets, earnings_mode: str = "lag1") -> DataFrame:
    """All fundamental columns on the trading days, last known value carried forward."""
    keys = ["ticker", "date"]
    counted = bars.select(*keys, F.count(F.lit(1)).over(Window.partitionBy("ticker")).alias("__n"))
    days = counted.filter(F.col("__n") >= MIN_PRICE_ROWS).select(*keys)
    df = spread_snapshot(days, snapshot(fundamentals))
    df = df.join(earnings_features(days, earnings, earnings_mode), keys, "left")
    df = df.join(macro_features(days, series, assets), keys, "left")
    return df.select(*keys, *[ffill(c).alias(c) for c in df.columns if c not in keys])


def _middle_values(snap: DataFrame, columns: list[str]) -> DataFrame:
    """(sector, v_<column>: struct q0, q1, q2): the middle value of each sorted column, counted from n / 2, and its neighbours."""
    values = F.array(*[F.struct(F.lit(k).alias("k"), F.col(c).cast("double").alias("x")) for k, c in enumerate(columns)])
    long = snap.filter("sector IS NOT NULL").select("sector", F.inline(values)).filter("x IS NOT NULL")
    counts = long.groupBy("sector", "k", "x").agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy("sector", "k").agg(F.sum("n").alias("rows"))
    placed = running_totals(counts, ["sector", "k"], "x", {"below": F.col("n")}).join(total, ["sector", "k"])
    place = lambda d: F.floor(F.col("rows") / 2) + d
    at = lambda d: (F.col("below") <= place(d)) & (place(d) < F.col("below") + F.col("n"))
    near = placed.filter(at(-1) | at(0) | at(1))
    pick = lambda k, d: F.max(F.when((F.col("k") == k) & at(d), F.col("x"))).alias(f"q{d + 1}")
    return near.groupBy("sector").agg(*[F.struct(*[pick(k, d) for d in (-1, 0, 1)]).alias(f"v_{c}") for k, c in enumerate(columns)])


def peer_zscores(snap: DataFrame, columns: list[str] = PEER_COLUMNS) -> DataFrame:
    """Distance of each company from the median of the other companies of its sector, in peer deviations.

    No pairs are formed. One aggregation per sector keeps count, mean and squared deviations; the three middle order
    statistics come from running totals over the sector's distinct values, so that no row or task holds a sector. Taking
    one company out of these gives the exact median and deviation of its peers.
    """
    stats = snap.groupBy("sector").agg(
        *[F.count(c).alias(f"n_{c}") for c in columns],
        *[F.avg(c).alias(f"mean_{c}") for c in columns],
        *[(F.var_pop(c) * F.count(c)).alias(f"ss_{c}") for c in columns],
    ).join(_middle_values(snap, columns), "sector", "left")
    df = snap.join(stats, "sector", "left")
    out = []
    for c in columns:
        x, n, mean, ss = F.col(c), F.col(f"n_{c}"), F.col(f"mean_{c}"), F.col(f"ss_{c}")
        q0, q1, q2 = (F.col(f"v_{c}.q{k}") for k in (0, 1, 2))
        peers = F.when(x.isNull(), n).otherwise(n - 1)
        # n even: one middle value remains; n odd: the mean of two.
        without = F.when(n % 2 == 0, F.when(x <= q0, q1).otherwise(q0)).otherwise(
            F.when(x < q1, (q1 + q2) / 2).when(x == q1, (q0 + q2) / 2).otherwise((q0 + q1) / 2)
        )
        rest_mean = div(n * mean - x, n - 1)
        rest = F.greatest(ss - (x - mean) * (x - rest_mean), F.lit(0.0))
        dev = F.sqrt(div(rest, (peers - 1).cast("double")))
        flat = rest <= ss * 1e-12
        out.append(
            F.when(x.isNotNull() & (peers >= 2) & ~flat, div(x - without, dev)).alias(f"{c}_sector_zscore")
        )
    return df.select("ticker", "sector", *columns, *out)
