"""The 83 technical features, five label columns and the full feature matrix.

Every block adds its columns with frames over (ticker ordered by date), so the
whole matrix needs one exchange on ticker. Bars are unique on (ticker, date):
one ticker holds at most one row per trading day, which bounds each partition
key no matter how many rows the raw feed has.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerweave.functions.core import (
    TRADING_DAYS,
    div,
    flag,
    full,
    log_return,
    ordered,
    pct_change,
    running,
    sma,
    trailing,
    wide_frame,
)
from tickerweave.functions.ewm import Ewm, add_ewm
from tickerweave.functions.moments import rolling_kurt, rolling_rank_pct, rolling_skew

# Forecast horizons in trading days.
HORIZONS = {"1d": 1, "7d": 5, "1m": 21, "6m": 126}
SMA_WINDOWS = (5, 10, 20, 50)
ANNUAL = math.sqrt(TRADING_DAYS)

BAR_COLUMNS = ["ticker", "date", "open", "high", "low", "close", "volume"]

# Feature catalogue: block -> output columns, in output order.
CATALOGUE: dict[str, list[str]] = {
    "price": ["returns_1d", "returns_3d", "returns_5d", "returns_10d", "log_returns", "overnight_gap"],
    "momentum": [
        "rsi_14", "rsi_7", "rsi_21", "rsi_overbought", "rsi_oversold",
        "macd", "macd_signal", "macd_histogram", "macd_bullish",
        "momentum_5d", "momentum_10d", "momentum_21d", "momentum_63d",
        "momentum_persistence_5_20", "momentum_persistence_10_60",
    ],
    "volatility": [
        "atr_14", "atr_pct", "realized_vol_5d", "realized_vol_10d", "realized_vol_21d",
        "realized_vol_63d", "gk_vol_20",
    ],
    "volume": [
        "volume_sma20", "volume_ratio", "obv", "obv_sma20", "obv_momentum",
        "vwap_deviation", "volume_imbalance_20",
    ],
    "averages": [
        *[f"{kind}_{w}" for w in SMA_WINDOWS for kind in ("sma", "ema", "close_vs_sma")],
        "sma_5_20_cross", "sma_20_50_cross", "ema_12_26_cross",
    ],
    "bollinger": ["bb_middle", "bb_upper", "bb_lower", "bb_width", "bb_pct", "bb_squeeze"],
    "regime": [
        "vol_regime_pct", "high_vol_regime", "low_vol_regime",
        "trend_regime", "in_uptrend", "in_downtrend",
    ],
    "microstructure": [
        "amihud_illiq_20", "hl_spread_pct", "hl_spread_ma10",
        *[f"{k}_{w}" for w in (5, 20)
          for k in ("rolling_max", "rolling_min", "rolling_range", "pct_from_high", "pct_from_low")],
    ],
    "moments": ["rolling_skew_20", "rolling_skew_60", "rolling_kurt_20", "rolling_kurt_60"],
    "candles": ["candle_body", "upper_shadow", "lower_shadow", "candle_dir"],
}
TECHNICAL_FEATURES = [c for names in CATALOGUE.values() for c in names]
LABELS = [f"target_{h}" for h in HORIZONS] + ["target"]


def add_price_features(df: DataFrame) -> DataFrame:
    prev = F.lag("close", 1).over(ordered())
    return wide_frame(
        df,
        {
            **{f"returns_{k}d": pct_change("close", k) for k in (1, 3, 5, 10)},
            "log_returns": log_return("close"),
            "overnight_gap": div(F.col("open") - prev, prev),
        },
    )


def _true_range() -> Column:
    prev = F.lag("close", 1).over(ordered())
    hi, lo = F.col("high"), F.col("low")
    # greatest() skips NULL, so the first row keeps high - low.
    return F.greatest(hi - lo, F.abs(hi - prev), F.abs(lo - prev))


def add_smoothed_series(df: DataFrame) -> DataFrame:
    """All first-level exponential means: averages for MACD and EMA, RSI legs, true range."""
    delta = F.col("close") - F.lag("close", 1).over(ordered())
    keep = df.columns
    df = wide_frame(
        df,
        {
            "__gain": F.when(delta.isNotNull(), F.greatest(delta, F.lit(0.0))),
            "__loss": F.when(delta.isNotNull(), F.greatest(-delta, F.lit(0.0))),
            "__tr": _true_range(),
        },
    )
    specs = [Ewm.span(f"ema_{s}", F.col("close"), s) for s in (*SMA_WINDOWS, 12, 26)]
    for n in (7, 14, 21):
        specs.append(Ewm(f"__avg_gain_{n}", F.col("__gain"), 1.0 / n, n))
        specs.append(Ewm(f"__avg_loss_{n}", F.col("__loss"), 1.0 / n, n))
    specs.append(Ewm("atr_14", F.col("__tr"), 1.0 / 14, 14))
    df = add_ewm(df, specs)
    rsi = {
        f"rsi_{n}": 100 - div(F.lit(100.0), 1 + div(f"__avg_gain_{n}", f"__avg_loss_{n}"))
        for n in (7, 14, 21)
    }
    df = wide_frame(df, {**rsi, "macd": F.col("ema_12") - F.col("ema_26")})
    df = add_ewm(df, [Ewm.span("macd_signal", F.col("macd"), 9)])
    ema = [f"ema_{s}" for s in (*SMA_WINDOWS, 12, 26)]
    return df.select(
        *keep, *ema, "rsi_7", "rsi_14", "rsi_21", "atr_14", div("atr_14", "close").alias("atr_pct"), "macd", "macd_signal"
    )


def add_momentum_features(df: DataFrame) -> DataFrame:
    return wide_frame(
        df,
        {
            "rsi_overbought": flag(F.col("rsi_14") > 70),
            "rsi_oversold": flag(F.col("rsi_14") < 30),
            "macd_histogram": F.col("macd") - F.col("macd_signal"),
            "macd_bullish": flag(F.col("macd") > F.col("macd_signal")),
            **{f"momentum_{k}d": pct_change("close", k) for k in (5, 10, 21, 63)},
            "momentum_persistence_5_20": div(pct_change("close", 5), pct_change("close", 20)),
            "momentum_persistence_10_60": div(pct_change("close", 10), pct_change("close", 60)),
        },
    )


def garman_klass(n: int = 20) -> Column:
    hl = F.ln(div("high", "low"))
    co = F.ln(div("close", "open"))
    daily = 0.5 * hl * hl - (2 * math.log(2) - 1) * co * co
    mean = sma(daily, n)
    return F.when(mean.isNotNull(), F.sqrt(F.greatest(mean, F.lit(0.0)) * TRADING_DAYS))


def add_volatility_features(df: DataFrame) -> DataFrame:
    lr = F.col("log_returns")
    return wide_frame(
        df,
        {
            **{f"realized_vol_{n}d": full(n, lr, F.stddev_samp(lr)) * ANNUAL for n in (5, 10, 21, 63)},
            "gk_vol_20": garman_klass(20),
        },
    )


def add_volume_features(df: DataFrame) -> DataFrame:
    close, vol = F.col("close"), F.col("volume")
    step = F.signum(close - F.lag("close", 1).over(ordered())) * vol
    typical = (F.col("high") + F.col("low") + close) / 3
    df = wide_frame(
        df,
        {
            "volume_sma20": sma("volume", 20),
            "obv": F.sum(F.coalesce(step, F.lit(0.0))).over(running()),
            "__vwap": div(F.sum(typical * vol).over(running()), F.sum(vol).over(running())),
            "volume_imbalance_20": sma(div(close - F.col("open"), close + F.col("open")) * vol, 20),
        },
    )
    df = wide_frame(
        df,
        {
            "volume_ratio": div("volume", "volume_sma20"),
            "obv_sma20": sma("obv", 20),
            "obv_momentum": pct_change("obv", 5),
            "vwap_deviation": div(close - F.col("__vwap"), "__vwap"),
        },
    )
    return df.drop("__vwap")


def add_average_features(df: DataFrame) -> DataFrame:
    df = wide_frame(df, {f"sma_{n}": sma("close", n) for n in SMA_WINDOWS})
    return wide_frame(
        df,
        {
            **{f"close_vs_sma_{n}": div("close", f"sma_{n}") - 1 for n in SMA_WINDOWS},
            "sma_5_20_cross": flag(F.col("sma_5") > F.col("sma_20")),
            "sma_20_50_cross": flag(F.col("sma_20") > F.col("sma_50")),
            "ema_12_26_cross": flag(F.col("ema_12") > F.col("ema_26")),
        },
    )


def add_bollinger_features(df: DataFrame, n: int = 20, width: float = 2.0) -> DataFrame:
    df = wide_frame(df, {"bb_middle": sma("close", n), "__sd": full(n, F.col("close"), F.stddev_samp("close"))})
    df = wide_frame(
        df,
        {
            "bb_upper": F.col("bb_middle") + width * F.col("__sd"),
            "bb_lower": F.col("bb_middle") - width * F.col("__sd"),
        },
    )
    band = F.col("bb_upper") - F.col("bb_lower")
    df = wide_frame(
        df,
        {"bb_width": div(band, "bb_middle"), "bb_pct": div(F.col("close") - F.col("bb_lower"), band)},
    )
    w = F.col("bb_width")
    squeeze = w < full(20, w, F.percentile(w, F.lit(0.2)))
    return wide_frame(df, {"bb_squeeze": flag(squeeze)}).drop("__sd")


def trend_regime(close, fast: int = 50, slow: int = 200) -> Column:
    """+1 / -1 when the fast mean is 2 % above / below the slow one, else 0 (warm-up too)."""
    gap = div(sma(close, fast) - sma(close, slow), sma(close, slow))
    return F.when(gap > 0.02, 1.0).when(gap < -0.02, -1.0).otherwise(0.0)


def add_regime_features(df: DataFrame) -> DataFrame:
    df = wide_frame(
        df,
        {
            "vol_regime_pct": rolling_rank_pct("realized_vol_21d", 252, 60),
            "trend_regime": trend_regime("close"),
        },
    )
    return wide_frame(
        df,
        {
            "high_vol_regime": flag(F.col("vol_regime_pct") > 0.75),
            "low_vol_regime": flag(F.col("vol_regime_pct") < 0.25),
            "in_uptrend": flag(F.col("trend_regime") > 0),
            "in_downtrend": flag(F.col("trend_regime") < 0),
        },
    )


def add_microstructure_features(df: DataFrame) -> DataFrame:
    close = F.col("close")
    illiq = div(F.abs(pct_change("close", 1)), close * F.col("volume")) * 1e6
    df = wide_frame(
        df,
        {
            "__illiq": illiq,
            "hl_spread_pct": div(F.col("high") - F.col("low"), close),
            **{f"rolling_max_{n}": full(n, close, F.max(close)) for n in (5, 20)},
            **{f"rolling_min_{n}": full(n, close, F.min(close)) for n in (5, 20)},
        },
    )
    out = {"amihud_illiq_20": sma("__illiq", 20), "hl_spread_ma10": sma("hl_spread_pct", 10)}
    for n in (5, 20):
        hi, lo = F.col(f"rolling_max_{n}"), F.col(f"rolling_min_{n}")
        out[f"rolling_range_{n}"] = div(hi - lo, close)
        out[f"pct_from_high_{n}"] = div(close, hi) - 1
        out[f"pct_from_low_{n}"] = div(close, lo) - 1
    return wide_frame(df, out).drop("__illiq")


def add_moment_features(df: DataFrame) -> DataFrame:
    return wide_frame(
        df,
        {
            **{f"rolling_skew_{n}": rolling_skew("log_returns", n) for n in (20, 60)},
            **{f"rolling_kurt_{n}": rolling_kurt("log_returns", n) for n in (20, 60)},
        },
    )


def add_candle_features(df: DataFrame) -> DataFrame:
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    return wide_frame(
        df,
        {
            "candle_body": div(F.abs(c - o), h - l),
            "upper_shadow": div(h - F.greatest(c, o), h - l),
            "lower_shadow": div(F.least(c, o) - l, h - l),
            "candle_dir": flag(c > o),
        },
    )


def add_labels(df: DataFrame, tail: str = "zero") -> DataFrame:
    """Up/down label per horizon. The last h rows of a ticker are 0, or NULL with tail='null'."""
    up = {
        f"target_{name}": (F.lead("close", h).over(ordered()) > F.col("close")).cast("int")
        for name, h in HORIZONS.items()
    }
    if tail == "zero":
        up = {k: F.coalesce(v, F.lit(0)) for k, v in up.items()}
    df = wide_frame(df, up)
    return df.withColumn("target", F.col("target_1d"))


def add_hurst(df: DataFrame, lags: int = 15, out: str = "hurst_30") -> DataFrame:
    """Slope of log dispersion on log lag over the last 2*lags log returns (opt-in).

    The differences at lag k inside the window are exactly the last 2*lags - k
    values of r - lag(r, k), so each dispersion is a plain rolling aggregate.
    """
    span = 2 * lags
    keep = df.columns
    r = F.col("log_returns")
    df = wide_frame(df, {f"__d{k}": r - F.lag(r, k).over(ordered()) for k in range(2, lags)})
    df = wide_frame(
        df,
        {
            "__n": F.count(r).over(trailing(span)),
            **{f"__t{k}": F.stddev_pop(f"__d{k}").over(trailing(span - k)) for k in range(2, lags)},
        },
    )
    xs = [math.log(k) for k in range(2, lags)]
    mean = sum(xs) / len(xs)
    sxx = sum((x - mean) ** 2 for x in xs)
    slope = sum(((x - mean) / sxx) * F.ln(f"__t{k}") for x, k in zip(xs, range(2, lags)))
    lowest = F.least(*[F.col(f"__t{k}") for k in range(2, lags)])
    return df.select(*keep, F.when((F.col("__n") >= span) & (lowest > 0), slope).alias(out))


def by_ticker(df: DataFrame) -> DataFrame:
    """One explicit exchange on ticker that every later frame reuses.

    The number of partitions is pinned: bars are few bytes per row but each row
    feeds dozens of frames, so size-based coalescing would leave cores idle. It
    is the session's, but at most four per core: a session set for large inputs
    asks for many, and each costs seconds of setting up the frames, even empty.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(min(n, 4 * spark.sparkContext.defaultParallelism), "ticker")


# Block -> (builder, blocks whose columns it reads).
_STEPS = {
    "price": (add_price_features, ()),
    "smoothed": (add_smoothed_series, ()),
    "momentum": (add_momentum_features, ("smoothed",)),
    "volatility": (add_volatility_features, ("price",)),
    "volume": (add_volume_features, ()),
    "averages": (add_average_features, ("smoothed",)),
    "bollinger": (add_bollinger_features, ()),
    "regime": (add_regime_features, ("price", "volatility")),
    "microstructure": (add_microstructure_features, ()),
    "moments": (add_moment_features, ("price",)),
    "candles": (add_candle_features, ()),
}
_SMOOTHED = {
    *[f"ema_{n}" for n in SMA_WINDOWS], "rsi_7", "rsi_14", "rsi_21", "atr_14", "atr_pct", "macd", "macd_signal",
}


def _home(column: str) -> str:
    if column in _SMOOTHED:
        return "smoothed"
    return next(block for block, names in CATALOGUE.items() if column in names)


def technical_features(bars: DataFrame, columns: list[str] | None = None, hurst: bool = False) -> DataFrame:
    """Bars plus the requested technical features (all 83 by default). No row is dropped.

    Only the blocks that the requested columns need enter the plan; inside a
    block Catalyst prunes the windows of columns nobody asks for.
    """
    wanted = list(TECHNICAL_FEATURES) if columns is None else [c for c in columns if c not in BAR_COLUMNS]
    blocks, todo = set(), [_home(c) for c in wanted] + (["price"] if hurst else [])
    while todo:
        block = todo.pop()
        if block not in blocks:
            blocks.add(block)
            todo.extend(_STEPS[block][1])
    df = by_ticker(bars.select(*BAR_COLUMNS))
    for block, (step, _) in _STEPS.items():
        if block in blocks:
            df = step(df)
    if hurst:
        df = add_hurst(df)
        wanted.append("hurst_30")
    return df.select(*BAR_COLUMNS, *wanted)


def drop_incomplete(df: DataFrame) -> DataFrame:
    """Infinite values become NULL, then rows with any NULL go."""
    inf = float("inf")
    fixed = [
        F.when((F.abs(c) == inf) | F.isnan(c), None).otherwise(F.col(c)).alias(c)
        if t in ("double", "float")
        else F.col(c)
        for c, t in df.dtypes
    ]
    return df.select(*fixed).dropna("any")


def impute_median(df: DataFrame, columns: list[str], part=("ticker",)) -> DataFrame:
    """Fill gaps with the column's exact median of the same ticker.

    Medians come from one grouped aggregation; a ticker whose column is empty
    has a NULL median and keeps its gaps.
    """
    med = df.groupBy(*part).agg(*[F.percentile(c, F.lit(0.5)).alias(f"__m_{c}") for c in columns])
    out = df.join(med, list(part), "left")
    return out.select(
        *[F.coalesce(F.col(c), F.col(f"__m_{c}")).alias(c) if c in columns else F.col(c) for c in df.columns]
    )


def feature_matrix(
    bars: DataFrame,
    optional_blocks: list[DataFrame] = (),
    hurst: bool = False,
    complete_only: bool = True,
    label_tail: str = "zero",
) -> DataFrame:
    """The full matrix: technical block, optional blocks on (ticker, date), labels, complete rows.

    Each optional block is imputed per ticker before the join. Columns that hold
    no value for a ticker would empty its matrix; they are left out of the
    completeness check and stay NULL.
    """
    df = add_labels(technical_features(bars, hurst=hurst), label_tail)
    strict = [c for c in df.columns]
    for block in optional_blocks:
        names = [c for c in block.columns if c not in ("ticker", "date")]
        df = df.join(impute_median(block, names), ["ticker", "date"], "left")
    if not complete_only:
        return df
    inf = float("inf")
    ok = F.lit(True)
    for c, t in df.dtypes:
        if c in strict:
            ok = ok & F.col(c).isNotNull()
            if t == "double":
                ok = ok & ~F.isnan(c) & (F.abs(c) != inf)
    return df.filter(ok)


def feature_columns(df: DataFrame) -> list[str]:
    """Everything that is neither a bar column nor a label."""
    skip = {*BAR_COLUMNS, *LABELS}
    return [c for c in df.columns if c not in skip]


def split_xy(df: DataFrame, horizon: str = "1d") -> DataFrame:
    """Keys, features and the label of one horizon (falls back to `target`)."""
    name = f"target_{horizon}"
    label = name if name in df.columns else "target"
    return df.select("ticker", "date", *feature_columns(df), F.col(label).alias("label"))


def latest_row(df: DataFrame) -> DataFrame:
    """Last row per ticker, pre-aggregated on the map side."""
    cols = [c for c in df.columns if c != "ticker"]
    best = df.groupBy("ticker").agg(F.max_by(F.struct(*cols), "date").alias("r"))
    return best.select("ticker", *[F.col(f"r.{c}").alias(c) for c in cols])
