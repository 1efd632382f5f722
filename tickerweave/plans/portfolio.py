"""Registered queries for portfolio analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickerweave.functions.core import rnd
from tickerweave.operators import allocation, portfolio as pf
from tickerweave.operators.report import portfolio_report
from tickerweave.plans import inputs as i
from tickerweave.plans.inputs import r, with_ctes
from tickerweave.session import reuse

_Z95 = "1.6448536269514722"


def _prices(spark, sf):
    return pf.aligned_prices(i.positions(spark, sf), i.bars(spark, sf))


def _vectors(spark, sf):
    return pf.return_vectors(_prices(spark, sf))


def _returns(spark, sf):
    return pf.log_returns(_vectors(spark, sf))


def _cov(spark, sf, method="sample"):
    return pf.covariance(_vectors(spark, sf), method)


class _Parts:
    """Prices and return vectors of one query, computed once, and what is derived from them."""

    def __init__(self, spark, sf):
        self.positions, self.probabilities = i.positions(spark, sf), i.probabilities(spark, sf)
        self.prices = reuse(pf.aligned_prices(self.positions, i.bars(spark, sf)))
        self.vectors = reuse(pf.return_vectors(self.prices))
        self.weights = reuse(pf.current_weights(self.positions, self.prices))
        self.cov = reuse(pf.covariance(self.vectors, "sample"))
        self.mu = pf.expected_returns(self.weights, self.probabilities)


def _weights(spark, sf):
    return pf.current_weights(i.positions(spark, sf), _prices(spark, sf))


def _mu(spark, sf):
    return pf.expected_returns(_weights(spark, sf), i.probabilities(spark, sf))


_GRID = """held AS (SELECT DISTINCT portfolio_id, ticker FROM positions WHERE ticker IN (SELECT ticker FROM bars)),
px AS (SELECT portfolio_id, ticker, date, close FROM held JOIN bars USING (ticker)),
dates AS (SELECT DISTINCT portfolio_id, date FROM px),
grid AS (SELECT d.portfolio_id, h.ticker, d.date, px.close FROM dates d JOIN held h USING (portfolio_id)
  LEFT JOIN px ON px.portfolio_id = d.portfolio_id AND px.ticker = h.ticker AND px.date = d.date),
filled AS (SELECT portfolio_id, ticker, date, last_value(close IGNORE NULLS) OVER
  (PARTITION BY portfolio_id, ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS close FROM grid),
prices AS (SELECT * FROM filled QUALIFY count(close) OVER (PARTITION BY portfolio_id, date)
  = count(*) OVER (PARTITION BY portfolio_id, date)),
lr AS (SELECT portfolio_id, ticker, date, ln(close / lag(close) OVER (PARTITION BY portfolio_id, ticker ORDER BY date)) AS r FROM prices),
rets AS (SELECT * FROM lr QUALIFY count(r) OVER (PARTITION BY portfolio_id, date) = count(*) OVER (PARTITION BY portfolio_id, date)),
ranked AS (SELECT *, dense_rank() OVER (PARTITION BY portfolio_id ORDER BY date DESC) AS dr FROM rets),
recent AS (SELECT * FROM ranked WHERE dr <= 252),
pairs AS (SELECT a.portfolio_id, a.ticker AS t1, b.ticker AS t2, a.r AS x, b.r AS y, a.dr FROM recent a JOIN recent b
  ON a.portfolio_id = b.portfolio_id AND a.date = b.date),
cov AS (SELECT portfolio_id, t1, t2, covar_samp(x, y) * 252 AS cov, count(*) AS n FROM pairs GROUP BY ALL),
vols AS (SELECT portfolio_id, t1 AS ticker, sqrt(greatest(cov, 0)) AS volatility FROM cov WHERE t1 = t2)"""
_WEIGHTS = """lastp AS (SELECT portfolio_id, ticker, arg_max(close, date) AS lp FROM prices GROUP BY ALL),
vals AS (SELECT l.portfolio_id, l.ticker, CASE WHEN l.ticker = '5-LOW' THEN n / 100 * lp ELSE coalesce(v, 0) END AS v
  FROM lastp l JOIN positions USING (portfolio_id, ticker)),
weights AS (SELECT portfolio_id, ticker, CASE WHEN sum(v) OVER p <= 0 THEN 1.0::DOUBLE / count(*) OVER p ELSE v / sum(v) OVER p END AS weight
  FROM vals WINDOW p AS (PARTITION BY portfolio_id)),
mus AS (SELECT portfolio_id, ticker, weight, (coalesce(p, 0.5) - 0.5) * 2 * 0.5 AS mu FROM weights LEFT JOIN probs USING (ticker)),
marg AS (SELECT cov.portfolio_id, t1 AS ticker, sum(w2.weight * cov) AS m FROM cov JOIN weights w2
  ON w2.portfolio_id = cov.portfolio_id AND w2.ticker = t2 GROUP BY ALL),
contrib AS (SELECT w.portfolio_id, w.ticker, weight, m, weight * m AS c, sum(weight * m) OVER (PARTITION BY w.portfolio_id) AS total
  FROM weights w JOIN marg USING (portfolio_id, ticker))"""
_ALL = (i.BARS, i.POSITIONS, i.PROBS, i.ASSETS, _GRID, _WEIGHTS)
_VALUES = "pvals AS (SELECT portfolio_id, CASE WHEN portfolio_id = 0 THEN 0 ELSE sum(v) END AS pv FROM positions GROUP BY portfolio_id)"


def _portfolio_values(spark, sf):
    p = i.positions(spark, sf)
    c = i.read(spark, sf, "customer")
    v = c.groupBy(F.col("c_nationkey").alias("portfolio_id")).agg(F.sum(F.greatest("c_acctbal", F.lit(0.0))).alias("v"))
    return v.select("portfolio_id", F.when(F.col("portfolio_id") == 0, 0.0).otherwise(F.col("v")).alias("portfolio_value"))


def _ewma_sql():
    lam = "exp(-ln(2) / 63)"
    return with_ctes(
        i.BARS, i.POSITIONS, _GRID,
        f"wp AS (SELECT *, pow({lam}, dr - 1) AS w FROM pairs)",
        """ew AS (SELECT portfolio_id, t1, t2, 252 * (sum(w * x * y) / sum(w) - sum(w * x) / sum(w) * sum(w * y) / sum(w)) AS cov
           FROM wp GROUP BY ALL)""",
        select=f"SELECT portfolio_id, t1, t2, {r('cov')} AS cov FROM ew",
    )


def _lw(spark, sf):
    """25 brands as one asset universe: shrinkage applies above ten assets."""
    b = i.bars_brand(spark, sf)
    held = b.select("ticker").distinct().select(F.lit(0).alias("portfolio_id"), "ticker")
    vec = pf.return_vectors(pf.aligned_prices(held, b))
    c = pf.covariance(vec, "auto")
    return c.select("t1", "t2", rnd("cov").alias("cov"), "method", "lookback_days", rnd("shrinkage").alias("shrinkage"))


_LW_SQL = with_ctes(
    i.BARS_BRAND,
    "positions AS (SELECT DISTINCT 0 AS portfolio_id, ticker FROM bars_brand)",
    _GRID.replace("FROM bars)", "FROM bars_brand)").replace("JOIN bars USING", "JOIN bars_brand USING"),
    "c1 AS (SELECT ticker, date, r - avg(r) OVER (PARTITION BY ticker) AS x FROM recent)",
    "nn AS (SELECT count(DISTINCT date) AS n, count(DISTINCT ticker) AS p FROM c1)",
    "s AS (SELECT a.ticker AS t1, b.ticker AS t2, avg(a.x * b.x) AS s, avg(a.x * a.x * b.x * b.x) AS q FROM c1 a JOIN c1 b USING (date) GROUP BY ALL)",
    """k AS (SELECT sum(CASE WHEN t1 = t2 THEN s END) / max(p) AS mu, (sum(q) - sum(s * s)) / (max(p) * max(n)) AS beta,
      (sum(s * s) - 2 * sum(CASE WHEN t1 = t2 THEN s END) / max(p) * sum(CASE WHEN t1 = t2 THEN s END)
       + max(p) * pow(sum(CASE WHEN t1 = t2 THEN s END) / max(p), 2)) / max(p) AS delta, max(n) AS n FROM s, nn)""",
    select=f"""SELECT t1, t2, {r('252 * ((1 - least(beta, delta) / delta) * s + CASE WHEN t1 = t2 THEN least(beta, delta) / delta * mu ELSE 0 END)')} AS cov,
      'ledoit_wolf' AS method, n AS lookback_days, {r('least(beta, delta) / delta')} AS shrinkage FROM s, k""",
)


def _lattice(spark, sf):
    p = _Parts(spark, sf)
    prob = allocation.problems(p.mu, p.cov, i.assets(spark, sf))
    b = allocation.lattice_search(prob, steps=10, max_position=0.5)
    return b.select(
        "portfolio_id", F.array_join("tickers", ",").alias("tickers"),
        F.array_join(F.col("g").cast("array<string>"), ",").alias("tenths"), rnd("sharpe").alias("sharpe"),
    )


_LATTICE_SQL = with_ctes(
    *_ALL,
    "a AS (SELECT portfolio_id, ticker, mu, row_number() OVER (PARTITION BY portfolio_id ORDER BY ticker) AS k FROM mus)",
    "rng AS (SELECT UNNEST(range(0, 6)) AS v)",
    """grid_w AS (SELECT row_number() OVER () AS gid, a.v AS g1, b.v AS g2, c.v AS g3, d.v AS g4, 10 - a.v - b.v - c.v - d.v AS g5
      FROM rng a, rng b, rng c, rng d WHERE a.v + b.v + c.v + d.v BETWEEN 5 AND 10)""",
    "gl AS (SELECT gid, UNNEST([1, 2, 3, 4, 5]) AS k, UNNEST([g1, g2, g3, g4, g5]) / 10.0::DOUBLE AS w FROM grid_w)",
    "lw AS (SELECT portfolio_id, gid, ticker, w, mu FROM a JOIN gl USING (k))",
    """ret AS (SELECT portfolio_id, gid, sum(w * mu) AS ret, count(*) AS n FROM lw GROUP BY portfolio_id, gid HAVING abs(sum(w) - 1) < 1e-9)""",
    """var AS (SELECT x.portfolio_id, x.gid, sum(x.w * y.w * cov) AS var FROM lw x JOIN lw y USING (portfolio_id, gid)
      JOIN cov ON cov.portfolio_id = x.portfolio_id AND t1 = x.ticker AND t2 = y.ticker GROUP BY ALL)""",
    """sc AS (SELECT portfolio_id, gid, n, round(ret / sqrt(greatest(var, 1e-12)), 9) AS sharpe FROM ret JOIN var USING (portfolio_id, gid))""",
    """best AS (SELECT * FROM sc JOIN grid_w USING (gid) QUALIFY row_number() OVER (PARTITION BY portfolio_id
      ORDER BY sharpe DESC, g1 DESC, g2 DESC, g3 DESC, g4 DESC) = 1)""",
    select=f"""SELECT portfolio_id, (SELECT string_agg(ticker, ',' ORDER BY ticker) FROM a WHERE a.portfolio_id = best.portfolio_id) AS tickers,
      array_to_string([g1, g2, g3, g4, g5][1:n], ',') AS tenths, {r('sharpe')} AS sharpe FROM best""",
)


def _optimize(spark, sf):
    p = _Parts(spark, sf)
    prob = allocation.problems(p.mu, p.cov, i.assets(spark, sf))
    res = allocation.optimize(prob)
    w = allocation.optimal_weights(res)
    return w.join(res.select("portfolio_id", "kind", "sharpe_ratio", "converged"), "portfolio_id").select(
        "portfolio_id", "ticker", rnd("weight", 4).alias("weight"), rnd("sharpe_ratio", 4).alias("sharpe_ratio"),
        F.col("converged").cast("int").alias("converged"),
    )


def _frontier(spark, sf):
    p = _Parts(spark, sf)
    prob = allocation.problems(p.mu, p.cov, i.assets(spark, sf))
    f = allocation.efficient_frontier(prob)
    return f.select("portfolio_id", rnd("expected_return", 4).alias("expected_return"), rnd("volatility", 4).alias("volatility"))


def _raw_positions(spark, sf):
    """Messy holdings: padded lower-case symbols, blanks and duplicates from part names."""
    p = i.read(spark, sf, "part")
    blank = F.when(F.col("p_size") == 1, "  ").otherwise(F.concat(F.lit(" "), F.lower("p_brand")))
    sym = F.when(F.col("p_size") > 40, F.regexp_replace(blank, "#", "-")).otherwise(blank)
    return p.groupBy(F.col("p_type").alias("portfolio_id"), sym.alias("ticker"), (F.col("p_size") > 45).alias("late")).agg(
        F.max(F.when(F.col("p_size") > 2, F.col("p_size").cast("string")).otherwise("n/a")).alias("shares")
    )


def _clean(spark, sf):
    ok, bad = pf.split_positions(pf.clean_positions(_raw_positions(spark, sf)))
    both = ok.withColumn("reason", F.lit("")).unionByName(bad)
    return both.select("portfolio_id", "ticker", rnd("shares").alias("shares"), "reason")


_CLEAN_SQL = f"""WITH raw AS (SELECT p_type AS portfolio_id, CASE WHEN p_size > 40 THEN replace(b, '#', '-') ELSE b END AS ticker,
    p_size > 45 AS late, max(CASE WHEN p_size > 2 THEN CAST(p_size AS VARCHAR) ELSE 'n/a' END) AS shares
  FROM (SELECT *, CASE WHEN p_size = 1 THEN '  ' ELSE ' ' || lower(p_brand) END AS b FROM part) GROUP BY ALL),
c AS (SELECT portfolio_id, upper(trim(ticker)) AS ticker, TRY_CAST(shares AS DOUBLE) AS shares FROM raw WHERE trim(ticker) <> '')
SELECT portfolio_id, ticker, {r('nullif(shares, 0)')} AS shares,
  CASE WHEN NOT regexp_full_match(replace(replace(ticker, '.', ''), '-', ''), '[A-Za-z0-9]+') THEN 'bad_symbol'
    WHEN count(*) OVER (PARTITION BY portfolio_id, ticker) > 1 THEN 'duplicate_ticker' ELSE '' END AS reason FROM c"""


def _bands(spark, sf):
    p = _Parts(spark, sf)
    vol = pf.portfolio_volatility(p.weights, p.cov)
    ret = pf.portfolio_return(p.mu)
    per_asset = pf.volatilities(p.cov).groupBy("portfolio_id").agg(F.min("volatility").alias("lowest"))
    df = vol.join(ret, "portfolio_id").join(per_asset, "portfolio_id")
    sharpe = F.col("expected_return") / F.col("volatility")
    return df.select(
        "portfolio_id", pf.risk_band(F.col("volatility") / 30).alias("risk_band"),
        pf.sharpe_band(sharpe * 100).alias("sharpe_band"), rnd("lowest").alias("lowest_volatility"),
    )


def _actions(spark, sf):
    cur = _weights(spark, sf)
    n = cur.groupBy("portfolio_id").agg(F.count(F.lit(1)).alias("n"))
    equal = cur.join(n, "portfolio_id").select("portfolio_id", "ticker", (1.0 / F.col("n")).alias("weight"))
    a = pf.rebalancing_actions(cur, equal, _portfolio_values(spark, sf))
    return a.select("portfolio_id", "ticker", rnd("current_weight").alias("current_weight"), rnd("optimal_weight").alias("optimal_weight"),
                    "action", rnd("current_value", 2).alias("current_value"), rnd("optimal_value", 2).alias("optimal_value"))


def _var(horizon):
    def run(spark, sf):
        p = _Parts(spark, sf)
        v = pf.value_at_risk(p.weights, p.cov, pf.log_returns(p.vectors), _portfolio_values(spark, sf), horizon=horizon)
        return v.select("portfolio_id", *[rnd(c, 4).alias(c) for c in ("volatility", "parametric_var_pct", "historical_var_pct")],
                        F.round("parametric_var_value", 2).alias("parametric_var_value"),
                        F.round("historical_var_value", 2).alias("historical_var_value"), "n_windows")

    return run


def _var_sql(h):
    roll = f"(PARTITION BY portfolio_id ORDER BY date ROWS {h - 1} PRECEDING)"
    return with_ctes(
        *_ALL, _VALUES,
        "pr AS (SELECT portfolio_id, date, sum(weight * r) AS pr FROM rets JOIN weights USING (portfolio_id, ticker) GROUP BY ALL)",
        f"ph AS (SELECT portfolio_id, CASE WHEN count(*) OVER {roll} >= {h} THEN sum(pr) OVER {roll} END AS pr FROM pr)",
        "hist AS (SELECT portfolio_id, -quantile_cont(pr, 0.05) AS h, count(pr) AS n FROM ph WHERE pr IS NOT NULL GROUP BY portfolio_id)",
        "v AS (SELECT portfolio_id, sqrt(greatest(max(total), 0)) AS vol FROM contrib GROUP BY portfolio_id)",
        f"p AS (SELECT portfolio_id, vol, {_Z95} * vol / sqrt(252) * sqrt({h}) AS pp, h, n, pv FROM v JOIN hist USING (portfolio_id) JOIN pvals USING (portfolio_id))",
        select=f"""SELECT portfolio_id, {r('vol', 4)} AS volatility, {r('pp', 4)} AS parametric_var_pct, {r('h', 4)} AS historical_var_pct,
        CASE WHEN pv <> 0 THEN round(pp * pv, 2) END AS parametric_var_value, CASE WHEN pv <> 0 THEN round(h * pv, 2) END AS historical_var_value,
        n AS n_windows FROM p""",
    )


QUERIES = {
    "s13_position_cleanup": _clean,
    "j06_price_matrix": lambda s, sf: _prices(s, sf).select("portfolio_id", "ticker", "date", rnd("close").alias("close"), "n_assets"),
    "j06_usable_portfolios": lambda s, sf: pf.portfolio_status(i.positions(s, sf), i.bars(s, sf), _prices(s, sf)),
    "a05_log_returns": lambda s, sf: _returns(s, sf).select("portfolio_id", "ticker", "date", rnd("r").alias("r")),
    "a06_j11_sample_covariance": lambda s, sf: _cov(s, sf).select("portfolio_id", "t1", "t2", rnd("cov").alias("cov"), "lookback_days"),
    "a07_ewma_covariance": lambda s, sf: _cov(s, sf, "ewma").select("portfolio_id", "t1", "t2", rnd("cov").alias("cov")),
    "a08_ledoit_wolf": _lw,
    "a09_correlation": lambda s, sf: pf.correlation(_cov(s, sf)).select("portfolio_id", "t1", "t2", rnd("correlation").alias("correlation")),
    "a10_current_weights": lambda s, sf: _weights(s, sf).select("portfolio_id", "ticker", rnd("weight").alias("weight")),
    "a11_j13_expected_return": lambda s, sf: pf.portfolio_return(_mu(s, sf)).select("portfolio_id", rnd("expected_return").alias("expected_return")),
    "a12_portfolio_volatility": lambda s, sf: (lambda p: pf.portfolio_volatility(p.weights, p.cov))(_Parts(s, sf)).select("portfolio_id", rnd("volatility").alias("volatility")),
    "a13_k11_risk_attribution": lambda s, sf: (lambda p: pf.risk_attribution(p.weights, p.cov))(_Parts(s, sf)).select(
        "portfolio_id", "ticker", *[rnd(c).alias(c) for c in ("weight", "marginal_contribution", "contribution_to_variance", "pct_of_total_risk")], "risk_rank"),
    "a14_value_at_risk_1d": _var(1),
    "a14_value_at_risk_10d": _var(10),
    "a17_sector_exposure": lambda s, sf: pf.sector_exposure(_weights(s, sf), i.assets(s, sf)).select("portfolio_id", "sector", rnd("exposure").alias("exposure")),
    "o04_feasibility": lambda s, sf: pf.feasibility(_weights(s, sf), i.assets(s, sf), 0.22, 0.3),
    "p12_bands": _bands,
    "p12_rebalancing": _actions,
    "o03_lattice_search": _lattice,
    "o01_max_sharpe": _optimize,
    "o02_efficient_frontier": _frontier,
    "o05_portfolio_report": lambda s, sf: portfolio_report(
        i.positions(s, sf), i.bars(s, sf), i.probabilities(s, sf), i.assets(s, sf), _portfolio_values(s, sf)),
}
ORACLES = {
    "s13_position_cleanup": _CLEAN_SQL,
    "j06_price_matrix": with_ctes(
        i.BARS, i.POSITIONS, _GRID,
        select=f"SELECT portfolio_id, ticker, date, {r('close')} AS close, count(*) OVER (PARTITION BY portfolio_id, date) AS n_assets FROM prices"),
    "j06_usable_portfolios": with_ctes(
        i.BARS, i.POSITIONS, _GRID,
        """st AS (SELECT portfolio_id, count(DISTINCT ticker) AS n_assets, count(DISTINCT date) AS n_dates, CASE WHEN count(DISTINCT ticker) < 2
        THEN 'too_few_assets' WHEN count(DISTINCT date) < 60 THEN 'too_few_dates' ELSE 'ok' END AS status FROM prices GROUP BY portfolio_id)""",
        select="""SELECT portfolio_id, coalesce(n_assets, 0) AS n_assets, coalesce(n_dates, 0) AS n_dates,
        coalesce(status, CASE WHEN portfolio_id IN (SELECT portfolio_id FROM held) THEN 'too_few_dates' ELSE 'no_prices' END) AS status
        FROM (SELECT DISTINCT portfolio_id FROM positions) LEFT JOIN st USING (portfolio_id)"""),
    "a05_log_returns": with_ctes(i.BARS, i.POSITIONS, _GRID, select=f"SELECT portfolio_id, ticker, date, {r('r')} AS r FROM rets"),
    "a06_j11_sample_covariance": with_ctes(
        i.BARS, i.POSITIONS, _GRID, select=f"SELECT portfolio_id, t1, t2, {r('cov')} AS cov, n AS lookback_days FROM cov"),
    "a07_ewma_covariance": _ewma_sql(),
    "a08_ledoit_wolf": _LW_SQL,
    "a09_correlation": with_ctes(
        i.BARS, i.POSITIONS, _GRID,
        select=f"""SELECT cov.portfolio_id, t1, t2, {r('CASE WHEN t1 = t2 THEN 1.0::DOUBLE ELSE coalesce(cov / nullif(a.volatility * b.volatility, 0), 0) END')}
        AS correlation FROM cov JOIN vols a ON a.portfolio_id = cov.portfolio_id AND a.ticker = t1
        JOIN vols b ON b.portfolio_id = cov.portfolio_id AND b.ticker = t2"""),
    "a10_current_weights": with_ctes(*_ALL, select=f"SELECT portfolio_id, ticker, {r('weight')} AS weight FROM weights"),
    "a11_j13_expected_return": with_ctes(*_ALL, select=f"SELECT portfolio_id, {r('sum(weight * mu)')} AS expected_return FROM mus GROUP BY portfolio_id"),
    "a12_portfolio_volatility": with_ctes(*_ALL, select=f"SELECT portfolio_id, {r('sqrt(greatest(max(total), 0))')} AS volatility FROM contrib GROUP BY portfolio_id"),
    "a13_k11_risk_attribution": with_ctes(
        *_ALL,
        select=f"""SELECT portfolio_id, ticker, {r('weight')} AS weight, {r('m')} AS marginal_contribution, {r('c')} AS contribution_to_variance,
        {r('c / total')} AS pct_of_total_risk, CAST(row_number() OVER (PARTITION BY portfolio_id ORDER BY c / total DESC, ticker) AS INTEGER) AS risk_rank FROM contrib"""),
    "a14_value_at_risk_1d": _var_sql(1),
    "a14_value_at_risk_10d": _var_sql(10),
    "a17_sector_exposure": with_ctes(
        *_ALL, select=f"SELECT portfolio_id, coalesce(sector, 'Unknown') AS sector, {r('sum(weight)')} AS exposure FROM weights LEFT JOIN assets USING (ticker) GROUP BY ALL"),
    "o04_feasibility": with_ctes(
        *_ALL,
        select="""SELECT portfolio_id, count(*) AS n_assets, count(DISTINCT coalesce(sector, 'Unknown')) AS n_sectors,
        CASE WHEN 0.22 * count(*) < 1 - 1e-6 THEN 'position_cap_infeasible'
        WHEN 0.3 * count(DISTINCT coalesce(sector, 'Unknown')) < 1 - 1e-6 THEN 'sector_cap_infeasible' ELSE 'ok' END AS status
        FROM weights LEFT JOIN assets USING (ticker) GROUP BY portfolio_id"""),
    "p12_bands": with_ctes(
        *_ALL,
        "v AS (SELECT portfolio_id, sqrt(greatest(max(total), 0)) AS vol FROM contrib GROUP BY portfolio_id)",
        "m AS (SELECT portfolio_id, sum(weight * mu) AS er FROM mus GROUP BY portfolio_id)",
        "l AS (SELECT portfolio_id, min(volatility) AS lo FROM vols GROUP BY portfolio_id)",
        select=f"""SELECT portfolio_id, CASE WHEN vol / 30 < 0.15 THEN 'Low' WHEN vol / 30 < 0.30 THEN 'Moderate' ELSE 'High' END AS risk_band,
        CASE WHEN er / vol * 100 >= 2 THEN 'Excellent' WHEN er / vol * 100 >= 1 THEN 'Good' WHEN er / vol * 100 >= 0.5 THEN 'Average'
        WHEN er / vol * 100 >= 0 THEN 'Below average' ELSE 'Poor' END AS sharpe_band, {r('lo')} AS lowest_volatility
        FROM v JOIN m USING (portfolio_id) JOIN l USING (portfolio_id)"""),
    "p12_rebalancing": with_ctes(
        *_ALL, _VALUES,
        "e AS (SELECT portfolio_id, ticker, weight, 1.0::DOUBLE / count(*) OVER (PARTITION BY portfolio_id) AS o FROM weights)",
        select=f"""SELECT portfolio_id, ticker, {r('weight')} AS current_weight, {r('o')} AS optimal_weight, CASE WHEN o - weight > 0.03 THEN 'Buy more'
        WHEN o - weight < -0.03 THEN 'Trim' ELSE 'Hold' END AS action, {r('CASE WHEN pv <> 0 THEN weight * pv END', 2)} AS current_value,
        {r('CASE WHEN pv <> 0 THEN o * pv END', 2)} AS optimal_value FROM e JOIN pvals USING (portfolio_id)"""),
    "o03_lattice_search": _LATTICE_SQL,
}
