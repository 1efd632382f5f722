"""Sector and market context: relative returns, beta, correlation, ETF trend, breadth."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerweave.functions.core import div, flag, log_return, ordered, pct_change, sma, wide_frame
from tickerweave.functions.ewm import Ewm, add_ewm
from tickerweave.functions.moments import rolling_beta, rolling_corr
from tickerweave.operators.asof import align_levels, pick_level
from tickerweave.operators.technical import by_ticker, trend_regime

# Sector name to exchange-traded fund, two tables with different coverage.
SECTOR_ETF = {
    "Technology": "XLK",
    "Health Care": "XLV",
    "Healthcare": "XLV",
    "Financials": "XLF",
    "Financial Services": "XLF",
    "Consumer Discretionary": "XLY",
    "Consumer Staples": "XLP",
    "Energy": "XLE",
    "Industrials": "XLI",
    "Materials": "XLB",
    "Real Estate": "XLRE",
    "Utilities": "XLU",
    "Communication Services": "XLC",
}
MACRO_SECTOR_ETF = {
    "Technology": "XLK",
    "Health Care": "XLV",
    "Financials": "XLF",
    "Consumer Discretionary": "XLY",
    "Consumer Staples": "XLP",
    "Energy": "XLE",
    "Utilities": "XLU",
    "Industrials": "XLI",
    "Materials": "XLB",
    "Real Estate": "XLRE",
    "Communication Services": "XLC",
}
MARKET_SYMBOL = "SPY"
MIN_SECTOR_ROWS = 63

SECTOR_FEATURES = [
    "sector_rel_ret_5d", "sector_rel_ret_21d", "sector_rel_ret_63d",
    "market_rel_ret_5d", "market_rel_ret_21d", "market_rel_ret_63d",
    "market_beta", "sector_corr_20d",
    "sector_rsi_14", "sector_momentum_5d", "sector_momentum_21d",
    "sector_sma50_200_cross", "sector_trend_regime", "sector_close_vs_sma50",
    "market_spy_vs_sma200", "market_above_sma200", "market_spy_momentum_21d",
]


def lookup(table: dict[str, str], key) -> Column:
    """Value of a small fixed table as an expression (NULL when the key is absent)."""
    m = F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])
    return F.try_element_at(m, key if isinstance(key, Column) else F.col(key))


def sector_links(assets: DataFrame) -> DataFrame:
    """(ticker, symbol): the sector's fund, the market fund when the sector is not in the table."""
    return assets.select(
        "ticker", F.coalesce(lookup(SECTOR_ETF, "sector"), F.lit(MARKET_SYMBOL)).alias("symbol")
    )


def with_context_closes(bars: DataFrame, assets: DataFrame, series: DataFrame) -> DataFrame:
    """ticker, date, close plus the aligned sector and market closes."""
    funds = {etf: f"__fund_{k}" for k, etf in enumerate(sorted({*SECTOR_ETF.values(), MARKET_SYMBOL}))}
    df = bars.select("ticker", "date", "close").join(sector_links(assets), "ticker", "left")
    df = align_levels(df, series, funds)
    return df.select("ticker", "date", "close", pick_level(F.col("symbol"), funds).alias("sector_close"),
                     F.col(funds[MARKET_SYMBOL]).alias("market_close"))


def relative_returns(prefix: str, other: str) -> dict[str, Column]:
    return {
        f"{prefix}_rel_ret_{k}d": pct_change("close", k) - pct_change(other, k) for k in (5, 21, 63)
    }


def sector_features(bars: DataFrame, assets: DataFrame, series: DataFrame) -> DataFrame:
    """The 17 sector and market columns keyed by (ticker, date); tickers below 63 rows have none.

    The closes are aligned first and every feature is computed on the ticker's
    own trading days.
    """
    df = by_ticker(with_context_closes(bars, assets, series))
    delta = F.col("sector_close") - F.lag("sector_close", 1).over(ordered())
    df = wide_frame(
        df,
        {
            "__rs": log_return("close"),
            "__re": log_return("sector_close"),
            "__rm": log_return("market_close"),
            "__gain": F.when(delta.isNotNull(), F.greatest(delta, F.lit(0.0))),
            "__loss": F.when(delta.isNotNull(), F.greatest(-delta, F.lit(0.0))),
            "__n": F.count(F.lit(1)).over(Window.partitionBy("ticker")),
        },
    )
    df = df.filter(F.col("__n") >= MIN_SECTOR_ROWS)
    df = add_ewm(
        df,
        [Ewm("__ag", F.col("__gain"), 1 / 14, 14), Ewm("__al", F.col("__loss"), 1 / 14, 14)],
    )
    s50, s200, m200 = sma("sector_close", 50), sma("sector_close", 200), sma("market_close", 200)
    df = wide_frame(
        df,
        {
            **relative_returns("sector", "sector_close"),
            **relative_returns("market", "market_close"),
            "market_beta": rolling_beta("__rs", "__rm", 60),
            "sector_corr_20d": rolling_corr("__rs", "__re", 20),
            "sector_rsi_14": 100 - div(F.lit(100.0), 1 + div("__ag", "__al")),
            "sector_momentum_5d": pct_change("sector_close", 5),
            "sector_momentum_21d": pct_change("sector_close", 21),
            "sector_sma50_200_cross": flag(s50 > s200),
            "sector_trend_regime": trend_regime("sector_close"),
            "sector_close_vs_sma50": div("sector_close", s50) - 1,
            "market_spy_vs_sma200": div("market_close", m200) - 1,
            "market_above_sma200": flag(F.col("market_close") > m200),
            "market_spy_momentum_21d": pct_change("market_close", 21),
        },
    )
    return df.select("ticker", "date", *SECTOR_FEATURES)
