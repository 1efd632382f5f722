"""Registered queries for the technical features, one per operator, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickerweave.functions.core import rnd, sma
from tickerweave.functions.ewm import Ewm, add_ewm
from tickerweave.operators import technical as tech
from tickerweave.plans.inputs import BARS, bars, r, with_ctes

INT_COLUMNS = {
    "rsi_overbought", "rsi_oversold", "macd_bullish", "sma_5_20_cross", "sma_20_50_cross",
    "ema_12_26_cross", "bb_squeeze", "high_vol_regime", "low_vol_regime", "in_uptrend",
    "in_downtrend", "candle_dir", *tech.LABELS,
}

# Frames and row numbers shared by all SQL blocks.
_W = "WINDOW w AS (PARTITION BY ticker ORDER BY date)"


def _frame(n: int) -> str:
    return f"(PARTITION BY ticker ORDER BY date ROWS {n - 1} PRECEDING)"


def _full(agg: str, c: str, n: int, need: int | None = None) -> str:
    return f"CASE WHEN count({c}) OVER {_frame(n)} >= {need or n} THEN {agg}({c}) OVER {_frame(n)} END"


def _pct(c: str, k: int) -> str:
    return f"({c} / nullif(lag({c}, {k}) OVER w, 0) - 1)"


def _ewm_sql(name: str, source: str, value: str, specs: list[tuple[str, float, int]]) -> str:
    """Closed form of the smoothing: every earlier row weighted by (1-a)^distance."""
    terms = ",\n".join(
        f"CASE WHEN a.n >= {need} THEN sum(CASE WHEN b.n = 1 THEN 1.0::DOUBLE ELSE {alpha!r}::DOUBLE END "
        f"* b.x * pow({1.0 - alpha!r}::DOUBLE, a.n - b.n)) END AS {out}"
        for out, alpha, need in specs
    )
    return (
        f"{name}_x AS (SELECT ticker, date, {value} AS x, count({value}) OVER "
        f"(PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS n FROM {source}),\n"
        f"{name} AS (SELECT a.ticker, a.date, {terms} FROM {name}_x a "
        f"JOIN {name}_x b ON a.ticker = b.ticker AND b.n <= a.n AND b.x IS NOT NULL AND a.x IS NOT NULL "
        f"GROUP BY a.ticker, a.date, a.n)"
    )


def _span(n: int) -> float:
    return 2.0 / (n + 1)


_BASE = f"""base AS (
  SELECT *, lag(close) OVER w AS pc, ln(close / nullif(lag(close) OVER w, 0)) AS lr,
    greatest(close - lag(close) OVER w, 0) AS gain, greatest(lag(close) OVER w - close, 0) AS loss,
    CASE WHEN lag(close) OVER w IS NULL THEN high - low
      ELSE greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) END AS tr
  FROM bars {_W})"""
# DuckDB's greatest() ignores NULL, which would turn the missing first difference into 0.
_BASE = _BASE.replace(
    "greatest(close - lag(close) OVER w, 0) AS gain, greatest(lag(close) OVER w - close, 0) AS loss",
    "CASE WHEN close - lag(close) OVER w IS NOT NULL THEN greatest(close - lag(close) OVER w, 0) END AS gain, "
    "CASE WHEN close - lag(close) OVER w IS NOT NULL THEN greatest(lag(close) OVER w - close, 0) END AS loss",
)

_SMOOTH = ",\n".join(
    [
        _BASE,
        _ewm_sql("ew", "base", "close", [(f"ema_{s}", _span(s), 1) for s in (5, 10, 20, 50, 12, 26)]),
        _ewm_sql("eg", "base", "gain", [(f"g{n}", 1.0 / n, n) for n in (7, 14, 21)]),
        _ewm_sql("el", "base", "loss", [(f"l{n}", 1.0 / n, n) for n in (7, 14, 21)]),
        _ewm_sql("et", "base", "tr", [("atr_14", 1.0 / 14, 14)]),
        "ml AS (SELECT ticker, date, ema_12 - ema_26 AS macd FROM ew)",
        _ewm_sql("es", "ml", "macd", [("macd_signal", _span(9), 1)]),
        "smooth AS (SELECT base.*, ew.* EXCLUDE (ticker, date), atr_14, macd, macd_signal, "
        + ", ".join(f"100 - 100 / (1 + g{n} / nullif(l{n}, 0)) AS rsi_{n}" for n in (7, 14, 21))
        + " FROM base JOIN ew USING (ticker, date) LEFT JOIN eg USING (ticker, date) "
        "LEFT JOIN el USING (ticker, date) JOIN et USING (ticker, date) JOIN ml USING (ticker, date) "
        "JOIN es USING (ticker, date))",
    ]
)


def _flag(cond: str) -> str:
    return f"CAST(coalesce({cond}, false) AS INTEGER)"


# SQL of every feature over `base` (or `smooth` for the smoothed ones), keyed by output name.
SQL: dict[str, str] = {
    **{f"returns_{k}d": _pct("close", k) for k in (1, 3, 5, 10)},
    "log_returns": "lr",
    "overnight_gap": "(open - pc) / nullif(pc, 0)",
    **{f"momentum_{k}d": _pct("close", k) for k in (5, 10, 21, 63)},
    "momentum_persistence_5_20": f"{_pct('close', 5)} / nullif({_pct('close', 20)}, 0)",
    "momentum_persistence_10_60": f"{_pct('close', 10)} / nullif({_pct('close', 60)}, 0)",
    **{f"realized_vol_{n}d": f"sqrt(252) * ({_full('stddev_samp', 'lr', n)})" for n in (5, 10, 21, 63)},
    "volume_sma20": _full("avg", "volume", 20),
    "volume_ratio": f"volume / nullif({_full('avg', 'volume', 20)}, 0)",
    **{f"sma_{n}": _full("avg", "close", n) for n in (5, 10, 20, 50)},
    **{f"close_vs_sma_{n}": f"close / nullif({_full('avg', 'close', n)}, 0) - 1" for n in (5, 10, 20, 50)},
    "sma_5_20_cross": _flag(f"({_full('avg', 'close', 5)}) > ({_full('avg', 'close', 20)})"),
    "sma_20_50_cross": _flag(f"({_full('avg', 'close', 20)}) > ({_full('avg', 'close', 50)})"),
    "bb_middle": _full("avg", "close", 20),
    "bb_upper": f"({_full('avg', 'close', 20)}) + 2 * ({_full('stddev_samp', 'close', 20)})",
    "bb_lower": f"({_full('avg', 'close', 20)}) - 2 * ({_full('stddev_samp', 'close', 20)})",
    "hl_spread_pct": "(high - low) / nullif(close, 0)",
    **{f"rolling_max_{n}": _full("max", "close", n) for n in (5, 20)},
    **{f"rolling_min_{n}": _full("min", "close", n) for n in (5, 20)},
    **{
        f"rolling_range_{n}": f"(({_full('max', 'close', n)}) - ({_full('min', 'close', n)})) / nullif(close, 0)"
        for n in (5, 20)
    },
    **{f"pct_from_high_{n}": f"close / nullif({_full('max', 'close', n)}, 0) - 1" for n in (5, 20)},
    **{f"pct_from_low_{n}": f"close / nullif({_full('min', 'close', n)}, 0) - 1" for n in (5, 20)},
    **{f"rolling_skew_{n}": _full("skewness", "lr", n) for n in (20, 60)},
    **{f"rolling_kurt_{n}": _full("kurtosis", "lr", n) for n in (20, 60)},
    "candle_body": "abs(close - open) / nullif(high - low, 0)",
    "upper_shadow": "(high - greatest(close, open)) / nullif(high - low, 0)",
    "lower_shadow": "(least(close, open) - low) / nullif(high - low, 0)",
    "candle_dir": _flag("close > open"),
    **{
        f"target_{k}": _flag(f"lead(close, {h}) OVER w > close")
        for k, h in {"1d": 1, "7d": 5, "1m": 21, "6m": 126}.items()
    },
    "target": _flag("lead(close, 1) OVER w > close"),
    # smoothed
    **{f"ema_{n}": f"ema_{n}" for n in (5, 10, 20, 50)},
    "ema_12_26_cross": _flag("ema_12 > ema_26"),
    **{f"rsi_{n}": f"rsi_{n}" for n in (7, 14, 21)},
    "rsi_overbought": _flag("rsi_14 > 70"),
    "rsi_oversold": _flag("rsi_14 < 30"),
    "macd": "macd",
    "macd_signal": "macd_signal",
    "macd_histogram": "macd - macd_signal",
    "macd_bullish": _flag("macd > macd_signal"),
    "atr_14": "atr_14",
    "atr_pct": "atr_14 / nullif(close, 0)",
}
_NEEDS_SMOOTH = {
    *[f"ema_{n}" for n in (5, 10, 20, 50)], "ema_12_26_cross", "rsi_7", "rsi_14", "rsi_21",
    "rsi_overbought", "rsi_oversold", "macd", "macd_signal", "macd_histogram", "macd_bullish",
    "atr_14", "atr_pct",
}

# Features with an intermediate stage: (stage select list, final expression over the stage).
_RV = f"sqrt(252) * ({_full('stddev_samp', 'lr', 21)})"
_MID, _SD = _full("avg", "close", 20), _full("stddev_samp", "close", 20)
_TREND = (
    f"(({_full('avg', 'close', 50)}) - ({_full('avg', 'close', 200)})) / nullif({_full('avg', 'close', 200)}, 0)"
)
_STAGE = f"""stage AS (
  SELECT *, {_RV} AS rv, {_MID} AS mid, ({_MID}) + 2 * ({_SD}) AS up, ({_MID}) - 2 * ({_SD}) AS dn,
    0.5 * pow(ln(high / nullif(low, 0)), 2) - (2 * ln(2) - 1) * pow(ln(close / nullif(open, 0)), 2) AS gk,
    abs(close / nullif(pc, 0) - 1) / nullif(close * volume, 0) * 1e6 AS illiq,
    (high - low) / nullif(close, 0) AS spread, {_TREND} AS gap,
    sum(coalesce(sign(close - pc) * volume, 0)) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS obv,
    sum((high + low + close) / 3 * volume) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING)
      / nullif(sum(volume) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING), 0) AS vwap,
    (close - open) / nullif(close + open, 0) * volume AS imb,
    row_number() OVER (PARTITION BY ticker ORDER BY date) AS rn
  FROM base),
stage2 AS (SELECT *, (up - dn) / nullif(mid, 0) AS width FROM stage),
vrank AS (
  SELECT a.ticker, a.date,
    CASE WHEN count(b.rv) >= 60 THEN
      (count(*) FILTER (WHERE b.rv < a.rv) + (count(*) FILTER (WHERE b.rv = a.rv) + 1) / 2.0::DOUBLE) / count(b.rv)
    END AS vr
  FROM stage a JOIN stage b ON a.ticker = b.ticker AND b.rn BETWEEN a.rn - 251 AND a.rn
  WHERE a.rv IS NOT NULL GROUP BY a.ticker, a.date),
staged AS (SELECT stage2.*, vr FROM stage2 LEFT JOIN vrank USING (ticker, date))"""
STAGED_SQL = {
    "gk_vol_20": f"sqrt(greatest({_full('avg', 'gk', 20)}, 0) * 252)".replace(
        "greatest(", "greatest("
    ),
    "obv": "obv",
    "obv_sma20": _full("avg", "obv", 20),
    "obv_momentum": _pct("obv", 5),
    "vwap_deviation": "(close - vwap) / nullif(vwap, 0)",
    "volume_imbalance_20": _full("avg", "imb", 20),
    "bb_width": "width",
    "bb_pct": "(close - dn) / nullif(up - dn, 0)",
    "bb_squeeze": _flag(f"width < {_full('quantile_cont', 'width', 20)}".replace(
        "quantile_cont(width)", "quantile_cont(width, 0.2)")),
    "vol_regime_pct": "vr",
    "high_vol_regime": _flag("vr > 0.75"),
    "low_vol_regime": _flag("vr < 0.25"),
    "trend_regime": "CASE WHEN gap > 0.02 THEN 1.0::DOUBLE WHEN gap < -0.02 THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END",
    "in_uptrend": _flag("gap > 0.02"),
    "in_downtrend": _flag("gap < -0.02"),
    "amihud_illiq_20": _full("avg", "illiq", 20),
    "hl_spread_ma10": _full("avg", "spread", 10),
}
# greatest() would hide the warm-up NULL of the Garman-Klass mean.
STAGED_SQL["gk_vol_20"] = (
    f"CASE WHEN count(gk) OVER {_frame(20)} >= 20 THEN "
    f"sqrt(greatest(avg(gk) OVER {_frame(20)}, 0) * 252) END"
)


def _places(name: str) -> int:
    """Recurrences and deviations on the scale of the price are compared to 3 decimals, the rest to 6."""
    price_like = ("ema_", "macd", "atr_14", "bb_upper", "bb_lower")
    return 3 if name.startswith(price_like) else 6


def _out(name: str, expr: str) -> str:
    return f"{expr} AS {name}" if name in INT_COLUMNS else f"{r(expr, _places(name))} AS {name}"


def feature_sql(names: list[str]) -> str:
    """SQL that yields ticker, date and the named features."""
    smooth = [n for n in names if n in _NEEDS_SMOOTH]
    staged = [n for n in names if n in STAGED_SQL]
    plain = [n for n in names if n not in smooth and n not in staged]
    parts, froms = [BARS, _SMOOTH if smooth else _BASE], []
    if staged:
        parts.append(_STAGE)
        sel = ", ".join(_out(n, STAGED_SQL[n]) for n in staged)
        parts.append(f"f_staged AS (SELECT ticker, date, {sel} FROM staged {_W})")
        froms.append("f_staged")
    if smooth:
        sel = ", ".join(_out(n, SQL[n]) for n in smooth)
        parts.append(f"f_smooth AS (SELECT ticker, date, {sel} FROM smooth {_W})")
        froms.append("f_smooth")
    if plain:
        sel = ", ".join(_out(n, SQL[n]) for n in plain)
        parts.append(f"f_plain AS (SELECT ticker, date, {sel} FROM base {_W})")
        froms.append("f_plain")
    joined = froms[0] + "".join(f" JOIN {f} USING (ticker, date)" for f in froms[1:])
    return with_ctes(*parts, select=f"SELECT ticker, date, {', '.join(names)} FROM {joined}")


def _cols(names):
    return ["ticker", "date", *[F.col(n) if n in INT_COLUMNS else rnd(n, _places(n)).alias(n) for n in names]]


def _features(names):
    return lambda spark, sf: tech.technical_features(bars(spark, sf), names).select(*_cols(names))


def _labels(spark, sf):
    return tech.add_labels(bars(spark, sf)).select("ticker", "date", *tech.LABELS)


def _hurst(spark, sf):
    df = tech.add_price_features(bars(spark, sf))
    return tech.add_hurst(df).select("ticker", "date", rnd("hurst_30").alias("hurst_30"))


def _hurst_sql() -> str:
    lags = range(2, 15)
    d = ", ".join(f"lr - lag(lr, {k}) OVER w AS d{k}" for k in lags)
    t = ", ".join(f"stddev_pop(d{k}) OVER {_frame(30 - k)} AS t{k}" for k in lags)
    low = ", ".join(f"t{k}" for k in lags)
    pairs = " UNION ALL ".join(
        f"SELECT ticker, date, ln({k}) AS x, CASE WHEN t{k} > 0 THEN ln(t{k}) END AS y, n, least({low}) AS lo FROM t"
        for k in lags
    )
    return with_ctes(
        BARS,
        _BASE,
        f"d AS (SELECT *, {d} FROM base {_W})",
        f"t AS (SELECT ticker, date, count(lr) OVER {_frame(30)} AS n, {t} FROM d)",
        f"p AS ({pairs})",
        select=f"""SELECT ticker, date, {r('CASE WHEN max(n) >= 30 AND max(lo) > 0 THEN regr_slope(y, x) END')}
          AS hurst_30 FROM p GROUP BY ticker, date""",
    )


def _ewm_single(spark, sf):
    df = add_ewm(
        bars(spark, sf),
        [Ewm.span("ewm_span10", F.col("close"), 10), Ewm("ewm_alpha", F.col("volume"), 0.2, 5)],
    )
    return df.select("ticker", "date", rnd("ewm_span10", 3).alias("ewm_span10"), rnd("ewm_alpha").alias("ewm_alpha"))


def _ewm_single_sql():
    return with_ctes(
        BARS,
        _ewm_sql("a1", "bars", "close", [("ewm_span10", _span(10), 1)]),
        _ewm_sql("a2", "bars", "volume", [("ewm_alpha", 0.2, 5)]),
        select=f"SELECT ticker, date, {r('ewm_span10', 3)} AS ewm_span10, {r('ewm_alpha')} AS ewm_alpha "
        "FROM a1 JOIN a2 USING (ticker, date)",
    )


def _matrix(spark, sf):
    df = tech.feature_matrix(bars(spark, sf))
    return df.select(*_cols([*tech.TECHNICAL_FEATURES, *tech.LABELS]))


def _matrix_sql():
    names = [*tech.TECHNICAL_FEATURES, *tech.LABELS]
    inner = feature_sql(names)
    ok = " AND ".join(f"{n} IS NOT NULL" for n in tech.TECHNICAL_FEATURES)
    return f"SELECT * FROM ({inner}) WHERE {ok}"


def _imputed(spark, sf):
    names = ["returns_10d", "realized_vol_63d", "sma_50"]
    df = tech.technical_features(bars(spark, sf), names).select("ticker", "date", *names)
    df = tech.impute_median(df, names)
    return df.select(*_cols(names))


def _imputed_sql():
    names = ["returns_10d", "realized_vol_63d", "sma_50"]
    fill = ", ".join(
        _out(n, f"coalesce({SQL_RAW[n]}, median({SQL_RAW[n]}) OVER (PARTITION BY ticker))") for n in names
    )
    sel = ", ".join(f"{SQL[n]} AS {n}" for n in names)
    return with_ctes(
        BARS, _BASE, f"f AS (SELECT ticker, date, {sel} FROM base {_W})", select=f"SELECT ticker, date, {fill} FROM f"
    )


SQL_RAW = {n: n for n in SQL}


def _latest(spark, sf):
    """Latest feature row of every ticker: the scoring input."""
    names = ["close", "returns_1d", "log_returns", "realized_vol_21d", "sma_20", "rsi_14", "macd"]
    return tech.latest_row(tech.technical_features(bars(spark, sf), names).select("ticker", "date", *names)).select(*_cols(names))


def _latest_sql():
    names = ["returns_1d", "log_returns", "realized_vol_21d", "sma_20", "rsi_14", "macd"]
    sel = ", ".join(_out(n, SQL[n]) for n in names)
    return with_ctes(
        BARS,
        _SMOOTH,
        f"f AS (SELECT ticker, date, {r('close')} AS close, {sel} FROM smooth {_W})",
        select="SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) = 1",
    )


# Operator -> feature columns it produces.
_BY_OPERATOR = {
    "w01_returns_momentum": ["returns_1d", "returns_3d", "returns_5d", "returns_10d",
                             "momentum_5d", "momentum_10d", "momentum_21d", "momentum_63d"],
    "w02_log_return_gap": ["log_returns", "overnight_gap"],
    "w04_rsi": ["rsi_7", "rsi_14", "rsi_21", "rsi_overbought", "rsi_oversold"],
    "w05_macd": ["macd", "macd_signal", "macd_histogram", "macd_bullish"],
    "w06_bollinger": tech.CATALOGUE["bollinger"],
    "w07_atr": ["atr_14", "atr_pct"],
    "w08_realized_vol": ["realized_vol_5d", "realized_vol_10d", "realized_vol_21d", "realized_vol_63d"],
    "w09_garman_klass": ["gk_vol_20"],
    "w11_amihud": ["amihud_illiq_20"],
    "w12_vwap_deviation": ["vwap_deviation"],
    "w13_obv": ["obv", "obv_sma20", "obv_momentum"],
    "w14_averages": ["volume_sma20", "volume_ratio",
                     *[f"{k}_{n}" for n in (5, 10, 20, 50) for k in ("sma", "close_vs_sma", "ema")]],
    "w15_crossovers": ["sma_5_20_cross", "sma_20_50_cross", "ema_12_26_cross"],
    "w16_vol_regime_rank": ["vol_regime_pct", "high_vol_regime", "low_vol_regime"],
    "w17_trend_regime": ["trend_regime", "in_uptrend", "in_downtrend"],
    "w18_volume_imbalance": ["volume_imbalance_20"],
    "w19_rolling_moments": tech.CATALOGUE["moments"],
    "w20_momentum_persistence": ["momentum_persistence_5_20", "momentum_persistence_10_60"],
    "w21_range_spread": [c for c in tech.CATALOGUE["microstructure"] if c != "amihud_illiq_20"],
    "w22_candles": tech.CATALOGUE["candles"],
}

# --- series with missing closes -----------------------------------------------------------

_GAPS = """gaps AS (SELECT * REPLACE (CASE WHEN CAST(volume AS BIGINT) % 4 = 1 THEN NULL ELSE close END AS close) FROM bars)"""


def _gappy(spark, sf):
    """Bars whose close is missing on days with 1, 5, 9, ... trades."""
    gone = F.col("volume").cast("long") % 4 == 1
    return bars(spark, sf).withColumn("close", F.when(~gone, F.col("close")))


def _ewm_gap_sql(name: str, source: str, value: str, alpha: float, need: int = 1) -> str:
    """The smoothing as a recursion over rows; g counts the rows since the last value."""
    w = "(PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING)"
    keep = f"pow({1.0 - alpha!r}::DOUBLE, a.g)"
    return f"""{name}_n AS (SELECT ticker, date, {value} AS x, row_number() OVER {w} AS rn, count({value}) OVER {w} AS n FROM {source}),
{name}_r AS (SELECT ticker, date, rn, n, x AS y, 1 AS g FROM {name}_n WHERE rn = 1
  UNION ALL SELECT b.ticker, b.date, b.rn, b.n,
    CASE WHEN b.x IS NULL THEN a.y WHEN a.y IS NULL THEN b.x ELSE ({keep} * a.y + {alpha!r}::DOUBLE * b.x) / ({keep} + {alpha!r}::DOUBLE) END,
    CASE WHEN b.x IS NULL THEN a.g + 1 ELSE 1 END
  FROM {name}_r a JOIN {name}_n b ON a.ticker = b.ticker AND b.rn = a.rn + 1),
{name} AS (SELECT ticker, date, CASE WHEN n >= {need} THEN y END AS v FROM {name}_r)"""


def _gap_sql(*ctes: str, select: str) -> str:
    return with_ctes(BARS, _GAPS, _BASE.replace("FROM bars", "FROM gaps"), *ctes, select=select).replace("WITH", "WITH RECURSIVE", 1)


def _returns_gaps(spark, sf):
    cols = [f"returns_{k}d" for k in (1, 3, 5, 10)]
    return tech.add_price_features(_gappy(spark, sf)).select("ticker", "date", *[rnd(c).alias(c) for c in cols], rnd("log_returns").alias("log_returns"))


def _returns_gaps_sql():
    last = "last_value(close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND {} )"
    cols = ", ".join(f"{r(last.format('CURRENT ROW') + ' / nullif(' + last.format(f'{k} PRECEDING') + ', 0) - 1')} AS returns_{k}d" for k in (1, 3, 5, 10))
    return _gap_sql(select=f"SELECT ticker, date, {cols}, {r('lr')} AS log_returns FROM base")


def _ewm_gaps(spark, sf):
    df = add_ewm(_gappy(spark, sf), [Ewm.span("ewm_span10", F.col("close"), 10), Ewm("ewm_alpha", F.col("close"), 0.2, 5)])
    return df.select("ticker", "date", rnd("ewm_span10", 3).alias("ewm_span10"), rnd("ewm_alpha", 3).alias("ewm_alpha"))


def _smoothed_gaps(column: str):
    return lambda spark, sf: tech.add_smoothed_series(_gappy(spark, sf)).select("ticker", "date", rnd(column, 2).alias(column))


_GAP_ORACLES = {
    "w01_returns_gaps": _returns_gaps_sql(),
    "w03_ewm_gaps": _gap_sql(
        _ewm_gap_sql("a1", "gaps", "close", _span(10)), _ewm_gap_sql("a2", "gaps", "close", 0.2, 5),
        select=f"SELECT ticker, date, {r('a1.v', 3)} AS ewm_span10, {r('a2.v', 3)} AS ewm_alpha FROM a1 JOIN a2 USING (ticker, date)"),
    "w04_rsi_gaps": _gap_sql(
        _ewm_gap_sql("g", "base", "gain", 1 / 14, 14), _ewm_gap_sql("l", "base", "loss", 1 / 14, 14),
        select=f"SELECT ticker, date, {r('100 - 100 / (1 + g.v / nullif(l.v, 0))', 2)} AS rsi_14 FROM g JOIN l USING (ticker, date)"),
    "w07_atr_gaps": _gap_sql(
        _ewm_gap_sql("t", "base", "tr", 1 / 14, 14), select=f"SELECT ticker, date, {r('v', 2)} AS atr_14 FROM t"),
}

QUERIES = {
    "w01_returns_gaps": _returns_gaps,
    "w03_ewm_gaps": _ewm_gaps,
    "w04_rsi_gaps": _smoothed_gaps("rsi_14"),
    "w07_atr_gaps": _smoothed_gaps("atr_14"),
    **{k: _features(v) for k, v in _BY_OPERATOR.items()},
    "w03_ewm": _ewm_single,
    "w10_hurst": _hurst,
    "w23_labels": _labels,
    "w37_feature_matrix": _matrix,
    "a03_median_imputation": _imputed,
    "p16_latest_features": _latest,
}
ORACLES = {
    **_GAP_ORACLES,
    **{k: feature_sql(v) for k, v in _BY_OPERATOR.items()},
    "w03_ewm": _ewm_single_sql(),
    "w10_hurst": _hurst_sql(),
    "w23_labels": feature_sql(tech.LABELS),
    "w37_feature_matrix": _matrix_sql(),
    "a03_median_imputation": _imputed_sql(),
    "p16_latest_features": _latest_sql(),
}
