"""Aligned returns, covariance, weights, risk and value at risk for many portfolios at once.

Everything is keyed by portfolio_id. A price matrix is kept as one row per
portfolio and date with the returns in an array (assets in ticker order), and
pair statistics are accumulated as vectors of pair products inside the
aggregation: map-side partial sums of p(p+1)/2 numbers per portfolio, never one
row per pair and date.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerweave.functions.core import TRADING_DAYS, div

# Fixed values.
LOOKBACK_DAYS = 252
MIN_DAYS = 60
SHRINK_ABOVE = 10
HALFLIFE_DAYS = 63
RETURN_SCALE = 0.5
VAR_CONFIDENCE = 0.95
MAX_POSITION = 0.50
MAX_SECTOR = 1.0
HOLD_BAND = 0.03

PID = "portfolio_id"


def clean_positions(raw: DataFrame) -> DataFrame:
    """Trimmed upper-case tickers, blank ones dropped, shares numeric (0 and text become NULL)."""
    t = F.upper(F.trim("ticker"))
    shares = F.col("shares").try_cast("double")
    return (
        raw.withColumn("ticker", t)
        .filter(F.coalesce(t, F.lit("")) != "")
        .withColumn("shares", F.when(shares != 0, shares))
    )


def valid_symbol(ticker) -> Column:
    """Letters and digits once dots and dashes are removed."""
    return F.regexp_replace(ticker, "[.-]", "").rlike("^[\\p{L}\\p{N}]+$")


def split_positions(positions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with reason): bad symbols and tickers that occur twice in a portfolio."""
    n = positions.groupBy(PID, "ticker").agg(F.count(F.lit(1)).alias("__n"))
    marked = positions.join(n, [PID, "ticker"])
    reason = F.when(~valid_symbol(F.col("ticker")), "bad_symbol").when(F.col("__n") > 1, "duplicate_ticker")
    marked = marked.withColumn("reason", reason).drop("__n")
    return marked.filter("reason IS NULL").drop("reason"), marked.filter("reason IS NOT NULL")


def aligned_prices(positions: DataFrame, bars: DataFrame) -> DataFrame:
    """Price matrix in long form: every date any holding traded, gaps filled forward, complete dates only.

    Holdings without bars are left out; `n_assets` counts the rest. Once filled,
    a date is complete exactly when every holding has started, so completeness
    is one date per portfolio, not a count per date.
    """
    held = positions.select(PID, "ticker").distinct()
    px = held.join(bars.select("ticker", "date", "close"), "ticker")
    first = px.groupBy(PID, "ticker").agg(F.min(F.when(F.col("close").isNotNull(), F.col("date"))).alias("first"))
    start = first.groupBy(PID).agg(
        F.count(F.lit(1)).alias("n_assets"), F.count("first").alias("started"), F.max("first").alias("start")
    ).filter("n_assets = started")
    dates = px.select(PID, "date").distinct()
    grid = dates.join(first.select(PID, "ticker"), PID).join(px, [PID, "ticker", "date"], "left")
    w = Window.partitionBy(PID, "ticker").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    filled = grid.select(PID, "ticker", "date", F.last("close", ignorenulls=True).over(w).alias("close"))
    full = filled.join(start, PID).filter(F.col("date") >= F.col("start"))
    return full.select(PID, "date", "ticker", "close", "n_assets")


def usable_portfolios(prices: DataFrame) -> DataFrame:
    """Portfolios with at least 2 assets and 60 common dates."""
    # Complete dates carry one row per asset.
    s = prices.groupBy(PID).agg(F.max("n_assets").alias("n_assets"), F.count(F.lit(1)).alias("rows"))
    s = s.select(PID, "n_assets", (F.col("rows") / F.col("n_assets")).cast("bigint").alias("n_dates"))
    return s.withColumn(
        "status", F.when(F.col("n_assets") < 2, "too_few_assets").when(F.col("n_dates") < MIN_DAYS, "too_few_dates").otherwise("ok")
    )


def portfolio_status(positions: DataFrame, bars: DataFrame, prices: DataFrame) -> DataFrame:
    """One row per portfolio with positions: "ok" or the first reason why it cannot be analysed.

    no_prices: no holding has bars; too_few_dates also covers portfolios without any complete date.
    """
    held = positions.select(PID, "ticker").distinct().join(bars.select("ticker").distinct(), "ticker", "left_semi")
    some = held.select(PID).distinct().withColumn("__priced", F.lit(True))
    s = positions.select(PID).distinct().join(usable_portfolios(prices), PID, "left").join(some, PID, "left")
    none = F.when(F.col("__priced"), "too_few_dates").otherwise("no_prices")
    zero = F.lit(0).cast("bigint")
    return s.select(PID, F.coalesce("n_assets", zero).alias("n_assets"), F.coalesce("n_dates", zero).alias("n_dates"), F.coalesce("status", none).alias("status"))


def return_vectors(prices: DataFrame) -> DataFrame:
    """One row per portfolio and date: assets in ticker order and their log returns; newest = day_rank 1.

    A date on which any asset has no finite return is dropped for the whole portfolio.
    """
    w = Window.partitionBy(PID, "ticker").orderBy("date")
    lr = F.ln(F.when(F.col("close") > 0, div("close", F.lag("close", 1).over(w))))
    v = prices.select(PID, "ticker", "date", "n_assets", lr.alias("r")).groupBy(PID, "date").agg(
        F.sort_array(F.collect_list(F.struct("ticker", "r"))).alias("s"),
        F.count("r").alias("__k"),
        F.max("n_assets").alias("__n"),
    ).filter("__k = __n")
    rank = F.row_number().over(Window.partitionBy(PID).orderBy(F.col("date").desc()))
    return v.select(PID, "date", F.col("s.ticker").alias("tickers"), F.col("s.r").alias("r"), rank.alias("day_rank"))


def log_returns(vectors: DataFrame) -> DataFrame:
    """The vectors in long form (portfolio, date, ticker, r)."""
    z = F.explode(F.arrays_zip("tickers", "r")).alias("z")
    return vectors.select(PID, "date", z).select(PID, "date", F.col("z.tickers").alias("ticker"), F.col("z.r").alias("r"))


def _pairs(a: Column, f) -> Column:
    """Upper triangle, row by row: f(a[i], a[j]) for i <= j."""
    return F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.size(a) - 1),
            lambda i: F.transform(F.slice(a, i + 1, F.size(a) - i), lambda y: f(F.get(a, i), y)),
        )
    )


def covariance(vectors: DataFrame, method: str = "auto", lookback: int = LOOKBACK_DAYS, halflife: int = HALFLIFE_DAYS) -> DataFrame:
    """Annualised covariance per portfolio as (t1, t2, cov, method, lookback_days), both triangles.

    method: "sample", "ewma", "ledoit_wolf", or "auto" (shrinkage above 10
    assets, sample otherwise; "ewma" also gives way to shrinkage).
    """
    v = vectors.filter(F.col("day_rank") <= lookback)
    n_assets = F.size("tickers")
    shrink = F.lit(method == "ledoit_wolf") | (F.lit(method in ("auto", "ewma")) & (n_assets > SHRINK_ABOVE))
    lam = math.exp(-math.log(2) / halflife)
    weight = F.pow(F.lit(lam), F.col("day_rank") - 1) if method == "ewma" else F.lit(1.0)
    v = v.withColumn("__w", F.when(shrink, F.lit(1.0)).otherwise(weight))
    mean = v.groupBy(PID).agg(
        vector_to_array(Summarizer.mean(array_to_vector("r"), F.col("__w"))).alias("__m"),
        F.count(F.lit(1)).alias("__n"),
    ).filter(F.col("__n") >= MIN_DAYS)
    c = v.join(mean, PID).withColumn("__x", F.zip_with("r", "__m", lambda x, m: x - m))
    prod = array_to_vector(_pairs(F.col("__x"), lambda x, y: x * y))
    s = c.groupBy(PID).agg(
        F.max("tickers").alias("tickers"),
        F.max("__n").alias("n"),
        vector_to_array(Summarizer.mean(prod, F.col("__w"))).alias("s"),
        vector_to_array(Summarizer.normL2(prod)).alias("l2"),
    )
    n, p = F.col("n").cast("double"), F.size("tickers").cast("double")
    zipped = F.arrays_zip(
        _pairs(F.col("tickers"), lambda a, b: F.struct(a.alias("t1"), b.alias("t2"))).alias("pair"), F.col("s"), F.col("l2")
    )
    # Sums over the full matrix from its upper triangle: off-diagonal terms count twice.
    twice = lambda z: F.when(z["pair"]["t1"] == z["pair"]["t2"], 1.0).otherwise(2.0)
    diag = lambda z: F.when(z["pair"]["t1"] == z["pair"]["t2"], z["s"]).otherwise(0.0)
    total = lambda f: F.aggregate("z", F.lit(0.0), lambda acc, z: acc + f(z))
    s = s.select(PID, "tickers", "n", zipped.alias("z"))
    s = s.select(
        "*",
        (total(diag) / p).alias("mu"),
        total(lambda z: twice(z) * z["s"] * z["s"]).alias("s2"),
        total(lambda z: twice(z) * z["l2"] * z["l2"] / n).alias("b2"),
        (total(diag)).alias("tr"),
    )
    beta = (F.col("b2") - F.col("s2")) / (p * n)
    delta = (F.col("s2") - 2 * F.col("mu") * F.col("tr") + p * F.col("mu") * F.col("mu")) / p
    s = s.withColumn("shrinkage", F.coalesce(div(F.least(beta, delta), delta), F.lit(0.0)))
    s = s.withColumn("shrink", F.lit(method == "ledoit_wolf") | (F.lit(method in ("auto", "ewma")) & (p > SHRINK_ABOVE)))
    long = s.select(PID, "n", "mu", "shrinkage", "shrink", F.explode("z").alias("z"))
    same = F.col("z.pair.t1") == F.col("z.pair.t2")
    base = F.col("z.s") if method == "ewma" else F.col("z.s") * n / (n - 1)
    daily = F.when(
        F.col("shrink"),
        (1 - F.col("shrinkage")) * F.col("z.s") + F.when(same, F.col("shrinkage") * F.col("mu")).otherwise(0.0),
    ).otherwise(base)
    name = F.when(F.col("shrink"), "ledoit_wolf").otherwise("ewma" if method == "ewma" else "sample")
    upper = long.select(
        PID,
        F.col("z.pair.t1").alias("t1"),
        F.col("z.pair.t2").alias("t2"),
        (daily * TRADING_DAYS).alias("cov"),
        name.alias("method"),
        F.col("n").alias("lookback_days"),
        F.when(F.col("shrink"), F.col("shrinkage")).alias("shrinkage"),
    )
    both = F.when(F.col("t1") == F.col("t2"), F.array(F.struct("t1", "t2"))).otherwise(
        F.array(F.struct("t1", "t2"), F.struct(F.col("t2").alias("t1"), F.col("t1").alias("t2")))
    )
    return upper.select(PID, F.explode(both).alias("k"), "cov", "method", "lookback_days", "shrinkage").select(
        PID, "k.t1", "k.t2", "cov", "method", "lookback_days", "shrinkage"
    )


def volatilities(cov: DataFrame) -> DataFrame:
    return cov.filter("t1 = t2").select(PID, F.col("t1").alias("ticker"), F.sqrt(F.greatest("cov", F.lit(0.0))).alias("volatility"))


def correlation(cov: DataFrame) -> DataFrame:
    """Correlation per pair: 1 on the diagonal, 0 where an asset has no volatility."""
    v = volatilities(cov)
    a = v.select(PID, F.col("ticker").alias("t1"), F.col("volatility").alias("v1"))
    b = v.select(PID, F.col("ticker").alias("t2"), F.col("volatility").alias("v2"))
    c = cov.join(a, [PID, "t1"]).join(b, [PID, "t2"])
    corr = F.when(F.col("t1") == F.col("t2"), 1.0).otherwise(
        F.coalesce(div("cov", F.col("v1") * F.col("v2")), F.lit(0.0))
    )
    return c.select(PID, "t1", "t2", corr.alias("correlation"))


def current_weights(positions: DataFrame, prices: DataFrame) -> DataFrame:
    """Normalised weights of the priced holdings: given weight, else market value, else shares at the last price.

    A portfolio whose values sum to nothing is weighted equally.
    """
    last = prices.groupBy(PID, "ticker").agg(F.max_by("close", "date").alias("last_price"))
    p = last.join(positions, [PID, "ticker"], "left")
    value = F.coalesce("weight", "market_value", F.col("shares") * F.col("last_price"), F.lit(0.0))
    p = p.select(PID, "ticker", value.alias("v"))
    w = Window.partitionBy(PID)
    total = F.sum("v").over(w)
    return p.select(
        PID, "ticker", F.when(total <= 0, 1.0 / F.count(F.lit(1)).over(w)).otherwise(div("v", total)).alias("weight")
    )


def expected_returns(weights: DataFrame, probabilities: DataFrame, scale: float = RETURN_SCALE) -> DataFrame:
    """Return proxy from the probability of a rise; a missing one counts as 0.5."""
    df = weights.join(probabilities, "ticker", "left")
    p = F.coalesce("p_bullish", F.lit(0.5))
    return df.select(PID, "ticker", "weight", ((p - 0.5) * 2 * scale).alias("mu"))


def portfolio_return(weighted: DataFrame) -> DataFrame:
    return weighted.groupBy(PID).agg(F.sum(F.col("weight") * F.col("mu")).alias("expected_return"))


def _row_risk(weights: DataFrame, cov: DataFrame) -> DataFrame:
    """(portfolio, ticker, weight, marginal): the covariance row of each asset against the weights."""
    w2 = weights.select(PID, F.col("ticker").alias("t2"), F.col("weight").alias("w2"))
    m = cov.join(w2, [PID, "t2"]).groupBy(PID, F.col("t1").alias("ticker")).agg(F.sum(F.col("w2") * F.col("cov")).alias("marginal"))
    return weights.select(PID, "ticker", "weight").join(m, [PID, "ticker"])


def portfolio_volatility(weights: DataFrame, cov: DataFrame) -> DataFrame:
    r = _row_risk(weights, cov).groupBy(PID).agg(F.sum(F.col("weight") * F.col("marginal")).alias("var"))
    return r.select(PID, F.sqrt(F.greatest("var", F.lit(0.0))).alias("volatility"))


def risk_attribution(weights: DataFrame, cov: DataFrame) -> DataFrame:
    """Marginal and absolute contribution and share of variance per asset, with the rank by share."""
    r = _row_risk(weights, cov)
    part = F.col("weight") * F.col("marginal")
    total = F.sum(part).over(Window.partitionBy(PID))
    ok = total > 0
    r = r.select(
        PID, "ticker", "weight",
        F.when(ok, F.col("marginal")).otherwise(0.0).alias("marginal_contribution"),
        F.when(ok, part).otherwise(0.0).alias("contribution_to_variance"),
        F.when(ok, div(part, total)).otherwise(0.0).alias("pct_of_total_risk"),
    )
    rank = F.row_number().over(Window.partitionBy(PID).orderBy(F.col("pct_of_total_risk").desc(), "ticker"))
    return r.withColumn("risk_rank", rank)


def value_at_risk(
    weights: DataFrame, cov: DataFrame, returns: DataFrame, values: DataFrame | None = None,
    confidence: float = VAR_CONFIDENCE, horizon: int = 1,
) -> DataFrame:
    """Parametric and historical loss quantiles, as shares and (with a portfolio value) as amounts."""
    z = NormalDist().inv_cdf(1 - confidence)
    vol = portfolio_volatility(weights, cov)
    parametric = -z * F.col("volatility") / math.sqrt(TRADING_DAYS) * math.sqrt(horizon)
    daily = returns.join(weights, [PID, "ticker"]).groupBy(PID, "date").agg(F.sum(F.col("weight") * F.col("r")).alias("pr"))
    if horizon > 1:
        w = Window.partitionBy(PID).orderBy("date")
        roll = w.rowsBetween(-(horizon - 1), 0)
        n = F.count(F.lit(1)).over(Window.partitionBy(PID))
        summed = F.when(n > horizon, F.when(F.count(F.lit(1)).over(roll) >= horizon, F.sum("pr").over(roll))).otherwise(F.col("pr"))
        daily = daily.select(PID, summed.alias("pr")).filter("pr IS NOT NULL")
    hist = daily.groupBy(PID).agg(
        (-F.percentile("pr", F.lit(1 - confidence))).alias("h"), F.count(F.lit(1)).alias("n_windows")
    )
    df = vol.join(hist, PID, "left")
    df = df.join(values, PID, "left") if values is not None else df.withColumn("portfolio_value", F.lit(None).cast("double"))
    hist_pct = F.coalesce("h", parametric)
    amount = lambda c: F.when(F.coalesce("portfolio_value", F.lit(0.0)) != 0, c * F.col("portfolio_value"))
    return df.select(
        PID,
        "volatility",
        parametric.alias("parametric_var_pct"),
        amount(parametric).alias("parametric_var_value"),
        hist_pct.alias("historical_var_pct"),
        amount(hist_pct).alias("historical_var_value"),
        F.coalesce("n_windows", F.lit(0)).alias("n_windows"),
    )


def sector_exposure(weights: DataFrame, assets: DataFrame) -> DataFrame:
    df = weights.join(assets, "ticker", "left")
    return df.groupBy(PID, F.coalesce("sector", F.lit("Unknown")).alias("sector")).agg(F.sum("weight").alias("exposure"))


def feasibility(weights: DataFrame, assets: DataFrame, max_position: float = MAX_POSITION, max_sector: float = MAX_SECTOR) -> DataFrame:
    """Whether position and sector caps can add up to a full allocation."""
    df = weights.join(assets, "ticker", "left").groupBy(PID).agg(
        F.count(F.lit(1)).alias("n_assets"), F.countDistinct(F.coalesce("sector", F.lit("Unknown"))).alias("n_sectors")
    )
    bad_pos = F.lit(max_position) * F.col("n_assets") < 1 - 1e-6
    bad_sec = F.lit(max_sector < 1.0) & (F.lit(max_sector) * F.col("n_sectors") < 1 - 1e-6)
    status = F.when(bad_pos, "position_cap_infeasible").when(bad_sec, "sector_cap_infeasible").otherwise("ok")
    return df.withColumn("status", status)


def risk_band(vol) -> Column:
    return F.when(vol < 0.15, "Low").when(vol < 0.30, "Moderate").otherwise("High")


def sharpe_band(sharpe) -> Column:
    return (
        F.when(sharpe >= 2.0, "Excellent")
        .when(sharpe >= 1.0, "Good")
        .when(sharpe >= 0.5, "Average")
        .when(sharpe >= 0, "Below average")
        .otherwise("Poor")
    )


def rebalancing_actions(current: DataFrame, optimal: DataFrame, values: DataFrame) -> DataFrame:
    """Buy, trim or hold per asset; a gap of at most 3 points is left alone."""
    o = optimal.select(PID, "ticker", F.col("weight").alias("optimal_weight"))
    df = current.join(o, [PID, "ticker"], "left").join(values, PID, "left")
    cur, opt = F.col("weight"), F.coalesce("optimal_weight", F.lit(0.0))
    gap = opt - cur
    action = F.when(gap > HOLD_BAND, "Buy more").when(gap < -HOLD_BAND, "Trim").otherwise("Hold")
    money = F.when(F.coalesce("portfolio_value", F.lit(0.0)) != 0, F.col("portfolio_value"))
    return df.select(
        PID, "ticker", cur.alias("current_weight"), opt.alias("optimal_weight"), action.alias("action"),
        (cur * money).alias("current_value"), (opt * money).alias("optimal_value"),
    )
