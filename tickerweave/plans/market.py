"""Registered queries for as-of joins, sector, fundamental, macro and option features."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickerweave.functions.core import ffill, rnd
from tickerweave.operators import asof, fundamental, options, sector, technical
from tickerweave.plans import inputs as i
from tickerweave.plans.inputs import r, with_ctes
from tickerweave.plans.technical import _ewm_sql, _frame, _full, _pct
from tickerweave.sources import fundamentals as fsrc
from tickerweave.sources import options as osrc


def _round_all(df, keys, ints=()):
    return df.select(
        *keys, *[F.col(c) if c in ints else rnd(c).alias(c) for c in df.columns if c not in keys]
    )


def _rs(names, ints=()):
    return ", ".join(n if n in ints else f"{r(n)} AS {n}" for n in names)


# --- as-of --------------------------------------------------------------------------


def _asof(spark, sf):
    s = i.series(spark, sf).filter("symbol = '^VIX'").select("date", F.col("close").alias("vix"))
    b = i.bars(spark, sf).select("ticker", "date")
    cal = b.select("date").distinct().withColumn("k", F.lit("^VIX"))
    level = asof.asof_backward(cal, s.withColumn("k", F.lit("^VIX")), ["k"], values=["vix"])
    return b.join(level.drop("k"), "date", "left").select("ticker", "date", rnd("vix").alias("vix"))


_ASOF_SQL = with_ctes(
    i.BARS, i.SERIES, "v AS (SELECT date, close AS vix FROM series WHERE symbol = '^VIX')",
    select=f"SELECT ticker, bars.date, {r('vix')} AS vix FROM bars ASOF LEFT JOIN v ON bars.date >= v.date",
)


def _asof_ticks(spark, sf):
    """Each purchase with the value of the user's last click, swept per user and day."""
    e = i.read(spark, sf, "events")
    left = e.filter("event_type = 'purchase'").select("user_id", "ts", "event_id")
    right = e.filter("event_type = 'click'").select("user_id", "ts", F.col("value").alias("click_value"))
    return asof.asof_backward(left, right, ["user_id"], on="ts", values=["click_value"], bucket="day")


_ASOF_TICKS_SQL = """WITH p AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'purchase'),
c AS (SELECT user_id, ts, value AS click_value FROM events WHERE event_type = 'click')
SELECT p.user_id, p.ts, p.event_id, c.click_value FROM p ASOF LEFT JOIN c ON p.user_id = c.user_id AND p.ts >= c.ts"""


def _ffill(spark, sf):
    """Sparse values on the trading days: gaps take the last known value."""
    b = i.bars(spark, sf)
    s = i.series(spark, sf).filter("symbol = '^VIX'").select("date", F.col("close").alias("vix"))
    df = b.join(s, "date", "left").select("ticker", "date", ffill("vix").alias("vix"))
    return df.select("ticker", "date", rnd("vix").alias("vix"))


_FFILL_SQL = with_ctes(
    i.BARS, i.SERIES, "v AS (SELECT date, close AS vix FROM series WHERE symbol = '^VIX')",
    select=f"""SELECT ticker, date, {r('''last_value(vix IGNORE NULLS) OVER
    (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING)''')} AS vix FROM bars LEFT JOIN v USING (date)""",
)


def _asof_forward(spark, sf):
    e = fsrc.normalise_earnings(i.earnings_feed(spark, sf)).select("ticker", "announced", "surprise_pct")
    return _round_all(asof.asof_forward(e, i.bars(spark, sf), ["ticker"], "announced"), ["ticker", "date"])


_PLACED = """placed AS (
  SELECT e.ticker, min(b.date) AS date, any_value(surprise_pct) AS surprise_pct, announced
  FROM earnings e JOIN bars b ON b.ticker = e.ticker AND b.date >= e.announced GROUP BY e.ticker, announced),
placed1 AS (SELECT ticker, date, arg_max(surprise_pct, announced) AS surprise_pct FROM placed GROUP BY ALL)"""


# --- sources ------------------------------------------------------------------------


def _payload_keys(spark, sf):
    """Numeric fields out of the JSON text of events."""
    e = i.read(spark, sf, "events").select("event_id", "props")
    return fsrc.harvest(e, "props", ["k", "missing"]).drop("props")


def _earnings(spark, sf):
    return _round_all(fsrc.normalise_earnings(i.earnings_feed(spark, sf)), ["ticker", "announced"])


def _series(spark, sf):
    return i.series(spark, sf).filter(F.col("symbol").isin("^VIX", "^TNX", "SPY"))


# --- sector -------------------------------------------------------------------------

_CTX = f"""links AS (SELECT ticker, CASE sector WHEN 'Technology' THEN 'XLK' WHEN 'Health Care' THEN 'XLV'
    WHEN 'Energy' THEN 'XLE' WHEN 'Financial Services' THEN 'XLF' ELSE 'SPY' END AS symbol FROM assets),
bl AS (SELECT bars.ticker, date, close, symbol FROM bars JOIN links USING (ticker)),
ctx1 AS (SELECT bl.ticker, bl.date, bl.close, s.close AS sector_close FROM bl
  ASOF LEFT JOIN series s ON bl.symbol = s.symbol AND bl.date >= s.date),
spy AS (SELECT date, close FROM series WHERE symbol = 'SPY'),
ctx AS (SELECT ctx1.*, spy.close AS market_close FROM ctx1 ASOF LEFT JOIN spy ON ctx1.date >= spy.date),
cr AS (SELECT *, ln(close / nullif(lag(close) OVER w, 0)) AS rs, ln(sector_close / nullif(lag(sector_close) OVER w, 0)) AS re,
  ln(market_close / nullif(lag(market_close) OVER w, 0)) AS rm,
  CASE WHEN lag(sector_close) OVER w IS NOT NULL THEN greatest(sector_close - lag(sector_close) OVER w, 0) END AS gain,
  CASE WHEN lag(sector_close) OVER w IS NOT NULL THEN greatest(lag(sector_close) OVER w - sector_close, 0) END AS loss,
  count(*) OVER (PARTITION BY ticker) AS n
  FROM ctx WINDOW w AS (PARTITION BY ticker ORDER BY date)),
{_ewm_sql('sg', 'cr', 'gain', [('ag', 1 / 14, 14)])},
{_ewm_sql('sl', 'cr', 'loss', [('al', 1 / 14, 14)])}"""

_S50, _S200 = _full("avg", "sector_close", 50), _full("avg", "sector_close", 200)
_M200 = _full("avg", "market_close", 200)


def _cov(agg: str, a: str, b: str, n: int) -> str:
    both = f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN 1 END"
    return f"CASE WHEN count({both}) OVER {_frame(n)} >= {n} THEN {agg}({a}, {b}) OVER {_frame(n)} END"


_SECTOR_SQL_COLS = {
    **{f"sector_rel_ret_{k}d": f"{_pct('close', k)} - {_pct('sector_close', k)}" for k in (5, 21, 63)},
    **{f"market_rel_ret_{k}d": f"{_pct('close', k)} - {_pct('market_close', k)}" for k in (5, 21, 63)},
    "market_beta": f"({_cov('covar_samp', 'rs', 'rm', 60)}) / nullif({_full('var_samp', 'rm', 60)}, 0)",
    "sector_corr_20d": f"({_cov('covar_samp', 'rs', 're', 20)}) / nullif((stddev_samp(rs) OVER {_frame(20)}) * (stddev_samp(re) OVER {_frame(20)}), 0)",
    "sector_rsi_14": "100 - 100 / (1 + ag / nullif(al, 0))",
    "sector_momentum_5d": _pct("sector_close", 5),
    "sector_momentum_21d": _pct("sector_close", 21),
    "sector_sma50_200_cross": f"CAST(coalesce(({_S50}) > ({_S200}), false) AS INTEGER)",
    "sector_trend_regime": f"""CASE WHEN (({_S50}) - ({_S200})) / nullif({_S200}, 0) > 0.02 THEN 1.0::DOUBLE
        WHEN (({_S50}) - ({_S200})) / nullif({_S200}, 0) < -0.02 THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END""",
    "sector_close_vs_sma50": f"sector_close / nullif({_S50}, 0) - 1",
    "market_spy_vs_sma200": f"market_close / nullif({_M200}, 0) - 1",
    "market_above_sma200": f"CAST(coalesce(market_close > ({_M200}), false) AS INTEGER)",
    "market_spy_momentum_21d": _pct("market_close", 21),
}
_SECTOR_INTS = {"sector_sma50_200_cross", "market_above_sma200"}


def _sector_sql(names):
    cols = ", ".join(
        f"{_SECTOR_SQL_COLS[n]} AS {n}" if n in _SECTOR_INTS else f"{r(_SECTOR_SQL_COLS[n])} AS {n}" for n in names
    )
    return with_ctes(
        i.BARS, i.SERIES, i.ASSETS, _CTX,
        select=f"""SELECT ticker, date, {cols} FROM cr LEFT JOIN sg USING (ticker, date) LEFT JOIN sl USING (ticker, date)
        WHERE cr.n >= 63 WINDOW w AS (PARTITION BY ticker ORDER BY date)""",
    )


def _sector(names):
    def run(spark, sf):
        df = sector.sector_features(i.bars(spark, sf), i.assets(spark, sf), i.series(spark, sf))
        return _round_all(df.select("ticker", "date", *names), ["ticker", "date"], _SECTOR_INTS)

    return run


def _links(spark, sf):
    a = i.assets(spark, sf)
    return a.select(
        "ticker", "sector",
        F.coalesce(sector.lookup(sector.SECTOR_ETF, "sector"), F.lit("SPY")).alias("etf"),
        sector.lookup(sector.MACRO_SECTOR_ETF, "sector").alias("macro_etf"),
    )


_LINKS_SQL = with_ctes(
    i.ASSETS,
    select="""SELECT ticker, sector, CASE sector WHEN 'Technology' THEN 'XLK' WHEN 'Health Care' THEN 'XLV'
    WHEN 'Energy' THEN 'XLE' WHEN 'Financial Services' THEN 'XLF' ELSE 'SPY' END AS etf,
    CASE sector WHEN 'Technology' THEN 'XLK' WHEN 'Health Care' THEN 'XLV' WHEN 'Energy' THEN 'XLE' END AS macro_etf
    FROM assets""",
)

# --- macro, earnings, fundamentals ----------------------------------------------------

_MACRO_INTS = {"macro_high_vix", "macro_yield_curve_inverted", "macro_sector_outperforming"}


def _macro(spark, sf):
    df = fundamental.macro_features(i.bars(spark, sf), i.series(spark, sf), i.assets(spark, sf))
    return _round_all(df, ["ticker", "date"], _MACRO_INTS)


def _macro_ctes() -> str:
    sym = {"vix": "^VIX", "tnx": "^TNX", "irx": "^IRX", "spy": "SPY"}
    parts = [
        """mlinks AS (SELECT ticker, CASE sector WHEN 'Technology' THEN 'XLK' WHEN 'Health Care' THEN 'XLV'
           WHEN 'Energy' THEN 'XLE' END AS symbol FROM assets)""",
        "m0 AS (SELECT bars.ticker, date, symbol FROM bars JOIN mlinks USING (ticker))",
        """m1 AS (SELECT m0.*, s.close AS sec FROM m0 ASOF LEFT JOIN series s
           ON m0.symbol = s.symbol AND m0.date >= s.date)""",
    ]
    prev = "m1"
    for k, s in sym.items():
        parts.append(f"s_{k} AS (SELECT date, close FROM series WHERE symbol = '{s}')")
        parts.append(f"m_{k} AS (SELECT {prev}.*, s_{k}.close AS {k} FROM {prev} ASOF LEFT JOIN s_{k} ON {prev}.date >= s_{k}.date)")
        prev = f"m_{k}"
    z = f"""CASE WHEN count(vix) OVER {_frame(20)} >= 5 THEN (vix - avg(vix) OVER {_frame(20)})
        / nullif(stddev_samp(vix) OVER {_frame(20)}, 0) END"""
    sec, mkt = _pct("sec", 21), _pct("spy", 21)
    parts.append(
        f"""macro AS (SELECT ticker, date, vix AS macro_vix, {z} AS macro_vix_zscore_20,
        CAST(coalesce(vix > 25, false) AS INTEGER) AS macro_high_vix,
        {sec} - {mkt} AS macro_sector_rel_perf,
        CASE WHEN symbol IS NOT NULL THEN CAST(coalesce({sec} > {mkt}, false) AS INTEGER) END AS macro_sector_outperforming,
        tnx - irx AS macro_yield_curve_slope,
        CAST(coalesce(tnx - irx < 0, false) AS INTEGER) AS macro_yield_curve_inverted
        FROM {prev} WINDOW w AS (PARTITION BY ticker ORDER BY date))"""
    )
    return ",\n".join(parts)


_MACRO_COLS = ["macro_vix", "macro_vix_zscore_20", "macro_high_vix", "macro_sector_rel_perf",
               "macro_sector_outperforming", "macro_yield_curve_slope", "macro_yield_curve_inverted"]
_MACRO_SQL = with_ctes(
    i.BARS, i.SERIES, i.ASSETS, _macro_ctes(),
    select=f"SELECT ticker, date, {_rs(_MACRO_COLS, _MACRO_INTS)} FROM macro",
)


def _earnings_features(mode):
    def run(spark, sf):
        e = fsrc.normalise_earnings(i.earnings_feed(spark, sf))
        return _round_all(fundamental.earnings_features(i.bars(spark, sf), e, mode), ["ticker", "date"])

    return run


def _earnings_features_sql(mode):
    prev = "lag(s) OVER w" if mode == "lag1" else "p"
    fill = "last_value({} IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING)"
    return with_ctes(
        i.BARS, i.EARNINGS, _PLACED,
        "pl AS (SELECT *, lag(surprise_pct) OVER (PARTITION BY ticker ORDER BY date) AS pq FROM placed1)",
        "d AS (SELECT b.ticker, b.date, surprise_pct AS s, pq AS p FROM bars b LEFT JOIN pl USING (ticker, date))",
        f"d2 AS (SELECT ticker, date, s, {prev} AS pv FROM d WINDOW w AS (PARTITION BY ticker ORDER BY date))",
        select=f"""SELECT ticker, date, {r(fill.format('s'))} AS fund_earnings_surprise_pct,
        {r(fill.format('pv'))} AS fund_prev_earnings_surprise_pct FROM d2""",
    )


_FUND = ["fund_trailing_pe", "fund_forward_pe", "fund_price_to_book", "fund_ev_to_ebitda", "fund_profit_margin",
         "fund_pe_premium", "fund_fcf_yield"]


def _fundamentals(spark, sf):
    return fundamental.snapshot(fsrc.read_fundamentals(i.company_payloads(spark, sf)))


def _spread(spark, sf):
    snap = _fundamentals(spark, sf).select("ticker", *_FUND, F.col("free_cash_flow_m").alias("fund_fcf_m"))
    return _round_all(fundamental.spread_snapshot(i.bars_brand(spark, sf), snap), ["ticker", "date"])


_SNAP = """snap AS (SELECT ticker, sector, trailingPE AS fund_trailing_pe, forwardPE AS fund_forward_pe,
  priceToBook AS fund_price_to_book, enterpriseToEbitda AS fund_ev_to_ebitda, profitMargins AS fund_profit_margin,
  forwardPE / nullif(trailingPE, 0) - 1 AS fund_pe_premium,
  CASE WHEN marketCap > 0 THEN freeCashflow / marketCap END AS fund_fcf_yield, freeCashflow / 1e6::DOUBLE AS fund_fcf_m
  FROM companies)"""


def _peers(spark, sf):
    return _round_all(fundamental.peer_zscores(_fundamentals(spark, sf)), ["ticker", "sector"])


def _peers_sql():
    cols = fundamental.PEER_COLUMNS
    z = ", ".join(
        f"""{r(f'''any_value(t.{c} ORDER BY t.{c}) FILTER (WHERE TRUE)''')} AS {c},
        {r(f'''CASE WHEN count(p.{c}) >= 2 THEN (any_value(t.{c}) - median(p.{c}))
            / nullif(CASE WHEN stddev_samp(p.{c}) > 1e-9 THEN stddev_samp(p.{c}) END, 0) END''')} AS {c}_sector_zscore"""
        for c in cols
    )
    z = z.replace(" ORDER BY", " ORDER BY").replace("FILTER (WHERE TRUE)", "")
    return with_ctes(
        i.COMPANIES, _SNAP,
        select=f"""SELECT t.ticker, t.sector, {z} FROM snap t LEFT JOIN snap p
        ON p.sector = t.sector AND p.ticker <> t.ticker GROUP BY t.ticker, t.sector""",
    )


# --- options ------------------------------------------------------------------------

_QUALITY = """(coalesce(volume, 0) >= 1 OR coalesce(open_interest, 0) >= 10)
  AND coalesce((ask - bid) / nullif((bid + ask) / 2, 0), 1.0) <= 0.50 AND iv > 0"""
_ATM = f"""near AS (SELECT c.*, abs(strike - spot) AS d,
    row_number() OVER (PARTITION BY ticker, snapshot_date, expiry, side ORDER BY abs(strike - spot), strike, iv) AS rk
  FROM chain c JOIN spot USING (ticker, snapshot_date) WHERE {_QUALITY}),
atm AS (SELECT ticker, snapshot_date, expiry, sum(iv / (d + 1)) / sum(1 / (d + 1)) AS atm_iv,
    CAST(count(*) AS INTEGER) AS n_used FROM near WHERE rk <= 2 GROUP BY ALL)"""
_SNAPS = """per_exp AS (SELECT ticker, snapshot_date, expiry,
    sum(CASE WHEN side = 'call' THEN volume ELSE 0 END) AS cv, sum(CASE WHEN side = 'put' THEN volume ELSE 0 END) AS pv,
    sum(CASE WHEN side = 'call' THEN open_interest ELSE 0 END) AS co, sum(CASE WHEN side = 'put' THEN open_interest ELSE 0 END) AS po
  FROM chain WHERE expiry > snapshot_date GROUP BY ALL),
ranked AS (SELECT per_exp.*, atm_iv, n_used, row_number() OVER (PARTITION BY ticker, snapshot_date ORDER BY expiry) AS k
  FROM per_exp LEFT JOIN atm USING (ticker, snapshot_date, expiry)),
two AS (SELECT ticker, snapshot_date, max(CASE WHEN k = 1 THEN expiry END) AS near_expiry, max(CASE WHEN k = 2 THEN expiry END) AS next_expiry,
    max(CASE WHEN k = 1 THEN atm_iv END) AS a1, max(CASE WHEN k = 2 THEN atm_iv END) AS a2,
    max(CASE WHEN k = 1 THEN cv END) AS cv, max(CASE WHEN k = 1 THEN pv END) AS pv,
    max(CASE WHEN k = 1 THEN co END) AS co, max(CASE WHEN k = 1 THEN po END) AS po,
    CAST(sum(CASE WHEN k <= 2 THEN coalesce(n_used, 0) ELSE 0 END) AS INTEGER) AS n_used
  FROM ranked GROUP BY ALL),
days AS (SELECT *, CAST(date_diff('day', snapshot_date, near_expiry) AS DOUBLE) AS d1,
    CAST(date_diff('day', snapshot_date, next_expiry) AS DOUBLE) AS d2 FROM two),
snaps AS (SELECT upper(ticker) AS ticker, snapshot_date, n_used >= 2 AS is_optionable, near_expiry, next_expiry,
    d1 AS near_days_to_expiry, d2 AS next_days_to_expiry, round(a1, 9) AS atm_iv_near, round(a2, 9) AS atm_iv_next,
    round(CASE WHEN a1 IS NULL THEN a2 WHEN a2 IS NULL OR d2 IS NULL OR d2 <= d1 THEN a1 WHEN 30 <= d1 THEN a1 WHEN 30 >= d2 THEN a2
      ELSE sqrt((a1 * a1 * d1 + (a2 * a2 * d2 - a1 * a1 * d1) * (30 - d1) / (d2 - d1)) / 30) END, 9) AS atm_iv_cm30,
    CASE WHEN cv > 0 THEN pv / cv END AS put_call_volume_ratio, CASE WHEN co > 0 THEN po / co END AS put_call_oi_ratio,
    cv AS total_call_volume, pv AS total_put_volume, n_used AS n_contracts_used FROM days)"""


def _snapshots(spark, sf):
    """Snapshots with volatilities cut to 9 decimals: ranks compare them for equality."""
    s = osrc.chain_snapshots(i.option_chain(spark, sf), i.option_spot(spark, sf))
    return s.withColumns({c: F.round(c, 9) for c in ("atm_iv_near", "atm_iv_next", "atm_iv_cm30")})


_SNAP_COLS = ["near_days_to_expiry", "next_days_to_expiry", "atm_iv_near", "atm_iv_next", "put_call_volume_ratio",
              "put_call_oi_ratio", "total_call_volume", "total_put_volume"]


def _snap_totals(spark, sf):
    df = _snapshots(spark, sf).select(
        "ticker", "snapshot_date", "near_expiry", "next_expiry", F.col("is_optionable").cast("int").alias("is_optionable"),
        "n_contracts_used", *_SNAP_COLS,
    )
    return _round_all(df, ["ticker", "snapshot_date"], {"near_expiry", "next_expiry", "is_optionable", "n_contracts_used"})


def _usable(spark, sf):
    df = osrc.usable_contracts(i.option_chain(spark, sf))
    return df.groupBy("ticker", "snapshot_date", "side").agg(
        F.count(F.lit(1)).alias("n"), rnd(F.sum("iv")).alias("iv_sum"), rnd(F.max("strike")).alias("max_strike")
    )


def _chain_union(spark, sf):
    c = i.option_chain(spark, sf)
    calls, puts = c.filter("side = 'call'").drop("side"), c.filter("side = 'put'").drop("side")
    return osrc.both_sides(calls, puts).groupBy("ticker", "side").agg(
        F.count(F.lit(1)).alias("n"), rnd(F.sum("volume")).alias("volume")
    )


def _atm(spark, sf):
    df = osrc.atm_iv(i.option_chain(spark, sf), i.option_spot(spark, sf))
    return df.select("ticker", "snapshot_date", "expiry", rnd("atm_iv").alias("atm_iv"), "n_used")


def _cm30(spark, sf):
    """Constant-maturity volatility at 10, 30 and 45 days over the same two expiries."""
    s = _snapshots(spark, sf)
    a = (F.col("atm_iv_near"), F.col("near_days_to_expiry"), F.col("atm_iv_next"), F.col("next_days_to_expiry"))
    return s.select(
        "ticker", "snapshot_date",
        *[rnd(osrc.constant_maturity(*a, target=t)).alias(f"iv_{t}d") for t in (10, 30, 45)],
    )


def _cm_sql(t):
    return f"""CASE WHEN a1 IS NULL THEN a2 WHEN a2 IS NULL OR d2 IS NULL OR d2 <= d1 THEN a1 WHEN {t} <= d1 THEN a1
      WHEN {t} >= d2 THEN a2 ELSE sqrt((a1 * a1 * d1 + (a2 * a2 * d2 - a1 * a1 * d1) * ({t} - d1) / (d2 - d1)) / {t}) END"""


def _upsert(spark, sf):
    """Two deliveries of the same days; the later delivery wins."""
    s = _snapshots(spark, sf).select("ticker", "snapshot_date", "n_contracts_used", "fetched_at")
    first = s.withColumn("fetched_at", F.col("snapshot_date").cast("timestamp"))
    again = first.filter("n_contracts_used >= 4").select(
        "ticker", "snapshot_date", (F.col("n_contracts_used") + 100).alias("n_contracts_used"),
        (F.col("fetched_at") + F.expr("INTERVAL 1 HOUR")).alias("fetched_at"),
    )
    merged = osrc.merge_snapshots(osrc.merge_snapshots(first, again), again)
    has = osrc.has_snapshot(merged.filter("n_contracts_used >= 100"), merged.select("ticker").distinct(), "1996-03-01")
    return merged.join(has, "ticker").select(
        "ticker", "snapshot_date", "n_contracts_used", F.col("has_snapshot").cast("int").alias("has_snapshot")
    )


_UPSERT_SQL = with_ctes(
    i.CHAIN, i.SPOT, _ATM, _SNAPS,
    "m AS (SELECT ticker, snapshot_date, CASE WHEN n_contracts_used >= 4 THEN n_contracts_used + 100 ELSE n_contracts_used END AS n FROM snaps)",
    select="""SELECT ticker, snapshot_date, n AS n_contracts_used, CAST(ticker IN (SELECT ticker FROM m
    WHERE snapshot_date = DATE '1996-03-01' AND n >= 100) AS INTEGER) AS has_snapshot FROM m""",
)


def _batch(spark, sf):
    fresh = _snapshots(spark, sf)
    watch = i.read(spark, sf, "part").select(F.upper(F.trim("p_brand")).alias("ticker")).distinct()
    watch = watch.unionByName(i.read(spark, sf, "region").select(F.upper("r_name").alias("ticker")))
    return osrc.batch_report(watch, fresh)


_BATCH_SQL = with_ctes(
    i.CHAIN, i.SPOT, _ATM, _SNAPS,
    "watch AS (SELECT DISTINCT upper(trim(p_brand)) AS ticker FROM part UNION SELECT upper(r_name) FROM region)",
    """agg AS (SELECT ticker, max(snapshot_date) AS last_snapshot, bool_or(is_optionable) AS opt,
    sum(n_contracts_used) AS contracts FROM snaps GROUP BY ticker)""",
    select="""SELECT ticker, last_snapshot, CAST(coalesce(contracts, 0) AS BIGINT) AS contracts,
    CASE WHEN opt IS NULL THEN 'no_chain' WHEN opt THEN 'ok' ELSE 'not_optionable' END AS status
    FROM watch LEFT JOIN agg USING (ticker)""",
)


def _brand_days(spark, sf):
    b = i.bars_brand(spark, sf).withColumn("ticker", F.upper("ticker"))
    return technical.technical_features(b, ["realized_vol_21d"]).select("ticker", "date", "realized_vol_21d")


def _snapshot_features(spark, sf):
    df = options.snapshot_features(_brand_days(spark, sf), _snapshots(spark, sf))
    return _round_all(df, ["ticker", "date"])


_DAYS_SQL = f"""brand_lr AS (SELECT upper(ticker) AS ticker, date,
    ln(close / nullif(lag(close) OVER (PARTITION BY ticker ORDER BY date), 0)) AS lr FROM bars_brand),
bdays AS (SELECT ticker, date, sqrt(252) * ({_full('stddev_samp', 'lr', 21)}) AS rv FROM brand_lr),
numbered AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY snapshot_date) AS rn FROM snaps),
ivr AS (SELECT a.ticker, a.snapshot_date, CASE WHEN a.atm_iv_cm30 IS NOT NULL AND count(b.atm_iv_cm30) >= 20 THEN
    (count(*) FILTER (WHERE b.atm_iv_cm30 < a.atm_iv_cm30) + (count(*) FILTER (WHERE b.atm_iv_cm30 = a.atm_iv_cm30) + 1) / 2.0::DOUBLE)
    / count(b.atm_iv_cm30) END AS ivr
  FROM numbered a JOIN numbered b ON a.ticker = b.ticker AND b.rn BETWEEN a.rn - 251 AND a.rn
  GROUP BY a.ticker, a.snapshot_date, a.atm_iv_cm30),
hist AS (SELECT ticker, snapshot_date AS date, CAST(is_optionable AS DOUBLE) AS opt_is_optionable,
    atm_iv_near AS opt_atm_iv_near, atm_iv_cm30 AS opt_atm_iv_cm30, ivr AS opt_iv_rank_252d,
    atm_iv_cm30 - lag(atm_iv_cm30, 5) OVER w AS opt_iv_change_5d, put_call_volume_ratio AS opt_put_call_vol_ratio,
    CASE WHEN count(put_call_volume_ratio) OVER w5 >= 1 THEN avg(put_call_volume_ratio) OVER w5 END AS opt_put_call_vol_ratio_ma5,
    put_call_oi_ratio AS opt_put_call_oi_ratio
  FROM snaps JOIN ivr USING (ticker, snapshot_date)
  WINDOW w AS (PARTITION BY ticker ORDER BY snapshot_date),
    w5 AS (PARTITION BY ticker ORDER BY snapshot_date ROWS 4 PRECEDING)),
snapf AS (SELECT bdays.ticker, bdays.date, hist.* EXCLUDE (ticker, date), opt_atm_iv_cm30 - rv AS opt_iv_rv_spread
  FROM bdays ASOF LEFT JOIN hist ON bdays.ticker = hist.ticker AND bdays.date >= hist.date)"""
_SNAPF = [*options.SNAPSHOT_FEATURES, "opt_iv_rv_spread"]
_VIX_INTS = {"vix_high_regime", "vix_elevated_regime", "vix_term_structure_inverted"}


def _vix(spark, sf):
    df = options.vix_features(i.bars(spark, sf), i.series(spark, sf))
    return _round_all(df, ["ticker", "date"], _VIX_INTS)


def _vix_cte(days: str) -> str:
    parts, prev = [], days
    for k, s in {"vix_level": "^VIX", "vix9d_level": "^VIX9D", "vix3m_level": "^VIX3M"}.items():
        parts.append(f"x_{k} AS (SELECT date, close FROM series WHERE symbol = '{s}')")
        parts.append(f"y_{k} AS (SELECT {prev}.*, x_{k}.close AS {k} FROM {prev} ASOF LEFT JOIN x_{k} ON {prev}.date >= x_{k}.date)")
        prev = f"y_{k}"
    parts.append(
        f"""vixf AS (SELECT ticker, date, vix_level, CAST(coalesce(vix_level > 30, false) AS INTEGER) AS vix_high_regime,
        CAST(coalesce(vix_level > 20, false) AS INTEGER) AS vix_elevated_regime, vix9d_level, vix3m_level,
        vix9d_level - vix3m_level AS vix_term_structure_slope,
        CAST(coalesce(vix9d_level > vix3m_level, false) AS INTEGER) AS vix_term_structure_inverted FROM {prev})"""
    )
    return ",\n".join(parts)


def _option_block(spark, sf):
    df = options.option_block(_brand_days(spark, sf), _snapshots(spark, sf), i.series(spark, sf))
    return _round_all(df, ["ticker", "date"], _VIX_INTS)


def _context(spark, sf):
    return options.options_context(_snapshots(spark, sf))


_CONTEXT_SQL = with_ctes(
    i.CHAIN, i.SPOT, _ATM, _SNAPS,
    "numbered AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY snapshot_date DESC) AS rn FROM snaps)",
    """last AS (SELECT * FROM numbered WHERE rn = 1)""",
    """rk AS (SELECT l.ticker, CASE WHEN l.atm_iv_cm30 IS NOT NULL AND count(b.atm_iv_cm30) >= 20 THEN
      (count(*) FILTER (WHERE b.atm_iv_cm30 < l.atm_iv_cm30) + (count(*) FILTER (WHERE b.atm_iv_cm30 = l.atm_iv_cm30) + 1) / 2.0::DOUBLE)
      / count(b.atm_iv_cm30) END AS rank FROM last l JOIN numbered b ON l.ticker = b.ticker AND b.rn <= 252
      GROUP BY l.ticker, l.atm_iv_cm30)""",
    """parts AS (SELECT ticker, is_optionable, concat_ws('; ',
      CASE WHEN atm_iv_cm30 IS NOT NULL THEN printf('30-day ATM implied volatility is %.1f%%', atm_iv_cm30 * 100) END,
      CASE WHEN rank IS NOT NULL THEN printf('IV rank is %.0f%% (%s relative to the past year)', rank * 100,
        CASE WHEN rank > 0.7 THEN 'elevated' WHEN rank < 0.3 THEN 'subdued' ELSE 'moderate' END) END,
      CASE WHEN put_call_volume_ratio IS NOT NULL THEN printf('put/call volume ratio is %.2f (%s positioning)', put_call_volume_ratio,
        CASE WHEN put_call_volume_ratio > 1.1 THEN 'bearish' WHEN put_call_volume_ratio < 0.9 THEN 'bullish' ELSE 'balanced' END) END) AS t
      FROM last JOIN rk USING (ticker))""",
    select="""SELECT ticker, CASE WHEN NOT is_optionable THEN ticker || ' options market: not liquid enough for a reliable IV signal.'
      WHEN t = '' THEN '' ELSE ticker || ' options market: ' || t || '.' END AS options_context FROM parts""",
)

_CHAIN_CTES = (i.CHAIN, i.SPOT, _ATM, _SNAPS)

QUERIES = {
    "j01_asof_backward": _asof,
    "j01_asof_backward_ticks": _asof_ticks,
    "j02_forward_fill": _ffill,
    "j03_asof_forward": _asof_forward,
    "j05_sector_etf_lookup": _links,
    "s08_index_series": _series,
    "s09_payload_harvest": _payload_keys,
    "s10_earnings_feed": _earnings,
    "w24_relative_returns": _sector(["sector_rel_ret_5d", "sector_rel_ret_21d", "sector_rel_ret_63d",
                                     "market_rel_ret_5d", "market_rel_ret_21d", "market_rel_ret_63d"]),
    "w25_rolling_beta": _sector(["market_beta"]),
    "w26_rolling_correlation": _sector(["sector_corr_20d"]),
    "w27_sector_trend": _sector(["sector_rsi_14", "sector_momentum_5d", "sector_momentum_21d",
                                 "sector_sma50_200_cross", "sector_trend_regime", "sector_close_vs_sma50"]),
    "w28_market_breadth": _sector(["market_spy_vs_sma200", "market_above_sma200", "market_spy_momentum_21d"]),
    "w29_sector_block": _sector(sector.SECTOR_FEATURES),
    "w30_macro": _macro,
    "w31_earnings_surprise": _earnings_features("lag1"),
    "w31_earnings_surprise_quarter": _earnings_features("quarter"),
    "w32_fundamentals_daily": _spread,
    "j10_a04_peer_zscores": _peers,
    "p06_contract_quality": _usable,
    "u01_chain_union": _chain_union,
    "a15_option_totals": _snap_totals,
    "a16_k03_atm_iv": _atm,
    "w35_constant_maturity": _cm30,
    "s05_snapshot_upsert": _upsert,
    "s14_snapshot_batch": _batch,
    "w33_snapshot_features": _snapshot_features,
    "w34_vix_features": _vix,
    "w36_option_block": _option_block,
    "f12_options_context": _context,
}
ORACLES = {
    "j01_asof_backward": _ASOF_SQL,
    "j01_asof_backward_ticks": _ASOF_TICKS_SQL,
    "j02_forward_fill": _FFILL_SQL,
    "j03_asof_forward": with_ctes(
        i.BARS, i.EARNINGS, _PLACED, select=f"SELECT ticker, date, {r('surprise_pct')} AS surprise_pct FROM placed1"
    ),
    "j05_sector_etf_lookup": _LINKS_SQL,
    "s08_index_series": with_ctes(
        i.BARS, i.SERIES, select="SELECT * FROM series WHERE symbol IN ('^VIX', '^TNX', 'SPY')"
    ),
    "s09_payload_harvest": """SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k,
        CAST(NULL AS DOUBLE) AS missing FROM events""",
    "s10_earnings_feed": with_ctes(
        i.EARNINGS,
        select=f"SELECT ticker, announced, {_rs(['actual_eps', 'estimated_eps', 'surprise_pct'])} FROM earnings",
    ),
    "w24_relative_returns": _sector_sql([f"{p}_rel_ret_{k}d" for p in ("sector", "market") for k in (5, 21, 63)]),
    "w25_rolling_beta": _sector_sql(["market_beta"]),
    "w26_rolling_correlation": _sector_sql(["sector_corr_20d"]),
    "w27_sector_trend": _sector_sql(["sector_rsi_14", "sector_momentum_5d", "sector_momentum_21d",
                                     "sector_sma50_200_cross", "sector_trend_regime", "sector_close_vs_sma50"]),
    "w28_market_breadth": _sector_sql(["market_spy_vs_sma200", "market_above_sma200", "market_spy_momentum_21d"]),
    "w29_sector_block": _sector_sql(sector.SECTOR_FEATURES),
    "w30_macro": _MACRO_SQL,
    "w31_earnings_surprise": _earnings_features_sql("lag1"),
    "w31_earnings_surprise_quarter": _earnings_features_sql("quarter"),
    "w32_fundamentals_daily": with_ctes(
        i.BARS_BRAND, i.COMPANIES, _SNAP,
        select=f"SELECT ticker, date, {_rs([*_FUND, 'fund_fcf_m'])} FROM bars_brand LEFT JOIN snap USING (ticker)",
    ),
    "j10_a04_peer_zscores": _peers_sql(),
    "p06_contract_quality": with_ctes(
        i.CHAIN,
        select=f"""SELECT ticker, snapshot_date, side, count(*) AS n, {r('sum(iv)')} AS iv_sum,
        {r('max(strike)')} AS max_strike FROM chain WHERE {_QUALITY} GROUP BY ALL""",
    ),
    "u01_chain_union": with_ctes(
        i.CHAIN, select=f"SELECT ticker, side, count(*) AS n, {r('sum(volume)')} AS volume FROM chain GROUP BY ALL"
    ),
    "a15_option_totals": with_ctes(
        *_CHAIN_CTES,
        select=f"""SELECT ticker, snapshot_date, near_expiry, next_expiry, CAST(is_optionable AS INTEGER) AS is_optionable,
        n_contracts_used, {_rs(_SNAP_COLS)} FROM snaps""",
    ),
    "a16_k03_atm_iv": with_ctes(
        i.CHAIN, i.SPOT, _ATM, select=f"SELECT ticker, snapshot_date, expiry, {r('atm_iv')} AS atm_iv, n_used FROM atm"
    ),
    "w35_constant_maturity": with_ctes(
        *_CHAIN_CTES,
        select="SELECT upper(ticker) AS ticker, snapshot_date, "
        + ", ".join(f"{r(_cm_sql(t))} AS iv_{t}d" for t in (10, 30, 45))
        + " FROM days",
    ),
    "s05_snapshot_upsert": _UPSERT_SQL,
    "s14_snapshot_batch": _BATCH_SQL,
    "w33_snapshot_features": with_ctes(
        i.BARS_BRAND, *_CHAIN_CTES, _DAYS_SQL, select=f"SELECT ticker, date, {_rs(_SNAPF)} FROM snapf"
    ),
    "w34_vix_features": with_ctes(
        i.BARS, i.SERIES, _vix_cte("bars"),
        select=f"SELECT ticker, date, {_rs(options.VIX_FEATURES, _VIX_INTS)} FROM vixf",
    ),
    "w36_option_block": with_ctes(
        i.BARS_BRAND, i.SERIES, *_CHAIN_CTES, _DAYS_SQL, _vix_cte("bdays"),
        select=f"""SELECT ticker, date, {_rs(options.OPTION_FEATURES, _VIX_INTS)} FROM snapf JOIN vixf USING (ticker, date)""",
    ),
    "f12_options_context": _CONTEXT_SQL,
}
