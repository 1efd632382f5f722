"""One nested row per portfolio: everything the portfolio operators compute."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerweave.operators import allocation
from tickerweave.operators import portfolio as pf
from tickerweave.session import reuse

PID = pf.PID


def _as_map(df: DataFrame, key: str, value: str, out: str, places: int = 4) -> DataFrame:
    return df.groupBy(PID).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(key), F.round(value, places))))).alias(out)
    )


def _risk_list(df: DataFrame, out: str) -> DataFrame:
    s = F.struct(
        "risk_rank", "ticker", F.round("weight", 4).alias("weight"),
        F.round("marginal_contribution", 4).alias("marginal_contribution"),
        F.round("contribution_to_variance", 4).alias("contribution_to_variance"),
        F.round("pct_of_total_risk", 4).alias("pct_of_total_risk"),
    )
    return df.groupBy(PID).agg(F.sort_array(F.collect_list(s)).alias(out))


def portfolio_report(
    positions: DataFrame, bars: DataFrame, probabilities: DataFrame, assets: DataFrame, values: DataFrame | None = None,
    max_position: float = pf.MAX_POSITION, max_sector: float = pf.MAX_SECTOR, turnover: float | None = None,
) -> DataFrame:
    """Weights, expected returns, correlation, allocation, frontier, risk and exposure: one row per portfolio.

    status is "ok" or why a portfolio was not analysed, see portfolio_status and feasibility; whatever could not be
    computed is NULL. A frontier without a feasible target is NULL as well, and warnings name that and holdings without
    prices. constraints_applied holds the caps in force.
    """
    # Read by several parts below, so computed once.
    prices = reuse(pf.aligned_prices(positions, bars))
    status = reuse(pf.portfolio_status(positions, bars, prices))
    prices = prices.join(status.filter("status = 'ok'").select(PID), PID, "left_semi")
    vectors = reuse(pf.return_vectors(prices))
    returns = pf.log_returns(vectors)
    cov = reuse(pf.covariance(vectors, "auto"))
    weights = reuse(pf.current_weights(positions, prices))
    caps = reuse(pf.feasibility(weights, assets, max_position, max_sector).select(PID, F.col("status").alias("__caps")))
    feasible = caps.filter("__caps = 'ok'").select(PID)
    mu = pf.expected_returns(weights, probabilities).join(feasible, PID, "left_semi")
    problem = allocation.problems(mu, cov, assets)
    problem = reuse(problem)
    best = reuse(allocation.optimize(problem, max_position, max_sector, turnover=turnover))
    optimal = allocation.optimal_weights(best)
    frontier = allocation.efficient_frontier(problem, max_position)
    corr = pf.correlation(cov).groupBy(PID, F.col("t1")).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("t2", F.round("correlation", 4))))).alias("row")
    )
    dropped = positions.join(bars.select("ticker").distinct(), "ticker", "left_anti")
    parts = [
        cov.groupBy(PID).agg(F.max("method").alias("covariance_method"), F.max("lookback_days").alias("lookback_days")),
        _as_map(weights, "ticker", "weight", "current_weights"),
        _as_map(optimal, "ticker", "weight", "optimal_weights"),
        _as_map(mu, "ticker", "mu", "expected_returns"),
        corr.groupBy(PID).agg(F.sort_array(F.collect_list(F.struct("t1", F.map_entries("row").alias("row")))).alias("correlation")),
        best.select(
            PID, F.round("expected_return", 4).alias("expected_return"),
            F.round("expected_volatility", 4).alias("expected_volatility"),
            F.round("sharpe_ratio", 4).alias("sharpe_ratio"), "converged",
        ),
        frontier.groupBy(PID).agg(
            F.sort_array(F.collect_list(F.struct(F.round("volatility", 4).alias("volatility"), F.round("expected_return", 4).alias("expected_return")))).alias("efficient_frontier")
        ),
        _risk_list(pf.risk_attribution(weights, cov), "current_risk"),
        _risk_list(pf.risk_attribution(optimal, cov), "optimal_risk"),
        pf.portfolio_return(mu).select(PID, F.round("expected_return", 4).alias("current_expected_return")),
        pf.value_at_risk(weights, cov, returns, values).select(
            PID, F.struct(*[F.round(c, 4).alias(c) for c in ("volatility", "parametric_var_pct", "parametric_var_value", "historical_var_pct", "historical_var_value")], "n_windows").alias("var")
        ),
        _as_map(pf.sector_exposure(weights, assets), "sector", "exposure", "sector_exposure"),
    ]
    out = status.join(caps, PID, "left").select(PID, F.coalesce(F.when(F.col("status") == "ok", F.col("__caps")), F.col("status")).alias("status"))
    for p in parts:
        out = out.join(p, PID, "left")
    gone = dropped.groupBy(PID).agg(F.sort_array(F.collect_set("ticker")).alias("dropped_tickers"))
    ok = F.col("status") == "ok"
    applied = F.struct(F.lit(max_position).alias("max_position"), F.lit(max_sector).alias("max_sector"), F.lit(turnover).cast("double").alias("turnover"))
    warnings = F.array_compact(F.array(
        F.when(F.col("dropped_tickers").isNotNull(), F.lit("holdings_without_prices")),
        F.when(ok & F.col("efficient_frontier").isNull(), F.lit("no_feasible_frontier")),
        F.when(ok & ~F.coalesce("converged", F.lit(False)), F.lit("optimizer_did_not_converge")),
    ))
    return out.join(gone, PID, "left").withColumns({"warnings": warnings, "constraints_applied": F.when(ok, applied)})
