"""Constrained mean-variance allocation: one small convex problem per portfolio and return target.

Spark builds the covariance and fans out one row per (portfolio, target); each
row is solved on its own by a small numpy routine, so the work spreads over all
cores and no portfolio waits for another.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerweave.operators.portfolio import MAX_POSITION, MAX_SECTOR, PID

FRONTIER_POINTS = 15
SWEEP_POINTS = 21


def solve_qp(p, q, a, lo, hi, iters: int = 20000, tol: float = 1e-10):
    """min x'Px/2 + q'x with lo <= Ax <= hi: operator splitting, then the active set solved exactly.

    Returns (x, worst constraint violation).
    """
    n, m = len(q), len(lo)
    scale = max(np.abs(p).max(), np.abs(q).max(), 1e-12)
    p, q = p / scale, q / scale
    eq = hi - lo < 1e-12
    rho = np.where(eq, 100.0, 0.1)
    kkt = np.linalg.inv(p + 1e-8 * np.eye(n) + (a.T * rho) @ a)
    x, z, y = np.zeros(n), np.clip(np.zeros(m), lo, hi), np.zeros(m)
    for k in range(iters):
        xt = kkt @ (1e-8 * x - q + a.T @ (rho * z - y))
        zt = a @ xt
        x = 1.6 * xt - 0.6 * x
        zr = 1.6 * zt - 0.6 * z
        z = np.clip(zr + y / rho, lo, hi)
        y = y + rho * (zr - z)
        if k % 25 == 0:
            ax = a @ x
            if np.abs(ax - z).max() < tol and np.abs(p @ x + q + a.T @ y).max() < tol:
                break
    gap = lambda v: max(np.max(lo - a @ v), np.max(a @ v - hi), 0.0)
    cost = lambda v: v @ p @ v / 2 + q @ v
    low, high = (y < -1e-7) & ~eq, (y > 1e-7) & ~eq
    act = eq | low | high
    if act.any():
        b = np.where(low, lo, hi)[act]
        aa = a[act]
        k = aa.shape[0]
        full = np.block([[p, aa.T], [aa, np.zeros((k, k))]])
        exact = np.linalg.lstsq(full, np.concatenate([-q, b]), rcond=None)[0][:n]
        if gap(exact) <= 1e-9 and (gap(x) > 1e-9 or cost(exact) <= cost(x) + 1e-12):
            x = exact
    return x, gap(x)


def _constraints(n, lower, cap, groups, sector_cap, current, turnover, mu=None, target=None):
    """Rows of lo <= Av <= hi; with a turnover limit v holds weights, buys and sells."""
    wide = turnover is not None and current is not None
    cols = 3 * n if wide else n
    rows, lo, hi = [], [], []

    def add(coef, l, h):
        row = np.zeros(cols)
        row[: len(coef)] = coef
        rows.append(row)
        lo.append(l)
        hi.append(h)

    add(np.ones(n), 1.0, 1.0)
    for k in range(n):
        add(np.eye(n)[k], lower, cap)
    if groups is not None and sector_cap < 1.0:
        for g in sorted(set(groups)):
            add(np.array([1.0 if s == g else 0.0 for s in groups]), -np.inf, sector_cap)
    if target is not None:
        add(mu, target, target)
    if wide:
        for k in range(n):
            e = np.zeros(3 * n)
            e[k], e[n + k], e[2 * n + k] = 1.0, -1.0, 1.0
            add(e, current[k], current[k])
            for off in (n, 2 * n):
                e = np.zeros(3 * n)
                e[off + k] = 1.0
                add(e, 0.0, np.inf)
        e = np.zeros(3 * n)
        e[n:] = 1.0
        add(e, -np.inf, turnover)
    big = lambda v: np.clip(np.array(v, float), -1e3, 1e3)
    return np.array(rows), big(lo), big(hi), cols


def _min_variance(cov, mu, spec, target=None):
    n = len(mu)
    a, lo, hi, cols = _constraints(n, *spec, mu=mu, target=target)
    p = np.zeros((cols, cols))
    p[:n, :n] = 2 * cov
    x, gap = solve_qp(p, np.zeros(cols), a, lo, hi)
    return x[:n], gap


def _max_return(cov, mu, spec):
    n = len(mu)
    a, lo, hi, cols = _constraints(n, *spec)
    q = np.zeros(cols)
    q[:n] = -mu
    # A trace of curvature picks one vertex when returns tie.
    p = np.zeros((cols, cols))
    p[:n, :n] = 1e-6 * max(np.abs(mu).max(), 1e-9) * np.eye(n)
    x, gap = solve_qp(p, q, a, lo, hi)
    return x[:n], gap


def problems(weights_mu: DataFrame, cov: DataFrame, assets: DataFrame | None = None) -> DataFrame:
    """One row per portfolio: assets in ticker order with weights, returns, sectors and the covariance matrix."""
    df = weights_mu
    if assets is not None:
        df = df.join(assets, "ticker", "left")
    else:
        df = df.withColumn("sector", F.lit("Unknown"))
    a = df.groupBy(PID).agg(
        F.sort_array(F.collect_list(F.struct("ticker", "weight", "mu", F.coalesce("sector", F.lit("Unknown")).alias("sector")))).alias("s")
    )
    c = cov.groupBy(PID).agg(F.sort_array(F.collect_list(F.struct("t1", "t2", "cov"))).alias("c"))
    return a.join(c, PID).select(
        PID, F.col("s.ticker").alias("tickers"), F.col("s.weight").alias("current"), F.col("s.mu").alias("mu"),
        F.col("s.sector").alias("sectors"), F.col("c.cov").alias("cov"),
    )


def _unpack(row):
    n = len(row.mu)
    return np.asarray(row.cov, float).reshape(n, n), np.asarray(row.mu, float)


def _spread(problem: DataFrame) -> DataFrame:
    """Solving dwarfs the size of a row, so rows are spread by count, not by bytes."""
    n = int(problem.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return problem.repartition(n)


def optimize(
    problem: DataFrame, max_position: float = MAX_POSITION, max_sector: float = MAX_SECTOR, long_only: bool = True,
    turnover: float | None = None, risk_free: float = 0.0,
) -> DataFrame:
    """Weights of the highest Sharpe ratio among: the current mix (when allowed), the minimum-variance
    mix, 19 mixes on the constrained frontier and the maximum-return mix. Equal weights when none is feasible.
    """
    lower = 0.0 if long_only else -1.0

    def spec(row):
        cur = np.asarray(row.current, float) if turnover is not None else None
        return (lower, max_position, list(row.sectors), max_sector, cur, turnover)

    def anchors(frames):
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                cov, mu = _unpack(row)
                w1, g1 = _min_variance(cov, mu, spec(row))
                w2, g2 = _max_return(cov, mu, spec(row))
                r1, r2 = float(w1 @ mu), float(w2 @ mu)
                cands = []
                cur = np.asarray(row.current, float)
                a, lo, hi, _ = _constraints(len(mu), lower, max_position, list(row.sectors), max_sector, None, None)
                if np.all(a @ cur >= lo - 1e-4) and np.all(a @ cur <= hi + 1e-4):
                    cands.append(("current", cur, None))
                if g1 <= 1e-4:
                    cands.append(("min_variance", w1, None))
                if g1 <= 1e-4 and g2 <= 1e-4 and abs(r1 - r2) > 1e-9:
                    cands += [("swept", None, float(t)) for t in np.linspace(r1, r2, SWEEP_POINTS)[1:-1]]
                    cands.append(("max_return", w2, None))
                if not cands:
                    cands.append(("equal_weight", np.full(len(mu), 1.0 / len(mu)), None))
                for kind, w, t in cands:
                    out.append((*row, kind, None if w is None else list(w), t))
            yield pd.DataFrame(out, columns=[*frame.columns, "kind", "w", "target"])

    def solve(frames):
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                cov, mu = _unpack(row)
                if row.w is None:
                    w, gap = _min_variance(cov, mu, spec(row), target=row.target)
                    if gap > 1e-4:
                        continue
                else:
                    w = np.asarray(row.w, float)
                vol = float(np.sqrt(max(w @ cov @ w, 1e-12)))
                score = (float(w @ mu) - risk_free) / vol
                w = np.clip(w, lower, max_position) if row.kind != "equal_weight" else w
                w = w / w.sum() if w.sum() > 0 else w
                vol = float(np.sqrt(max(w @ cov @ w, 1e-12)))
                ret = float(w @ mu)
                out.append((getattr(row, PID), row.kind, list(row.tickers), list(w), ret, vol, (ret - risk_free) / vol, score))
            yield pd.DataFrame(
                out, columns=[PID, "kind", "tickers", "w", "expected_return", "expected_volatility", "sharpe_ratio", "score"]
            )

    key = f"{PID} {problem.schema[PID].dataType.simpleString()}"
    body = "tickers array<string>, current array<double>, mu array<double>, sectors array<string>, cov array<double>"
    staged = _spread(problem).mapInPandas(anchors, f"{key}, {body}, kind string, w array<double>, target double")
    solved = _spread(staged).mapInPandas(
        solve,
        f"{key}, kind string, tickers array<string>, w array<double>, expected_return double, "
        "expected_volatility double, sharpe_ratio double, score double",
    )
    best = solved.groupBy(PID).agg(F.max_by(F.struct(*[c for c in solved.columns if c != PID]), "score").alias("b"))
    return best.select(PID, "b.*").withColumn("converged", F.col("kind") != "equal_weight")


def optimal_weights(result: DataFrame) -> DataFrame:
    z = F.explode(F.arrays_zip("tickers", "w")).alias("z")
    return result.select(PID, z).select(PID, F.col("z.tickers").alias("ticker"), F.col("z.w").alias("weight"))


def efficient_frontier(problem: DataFrame, max_position: float = MAX_POSITION, long_only: bool = True, points: int = FRONTIER_POINTS) -> DataFrame:
    """Minimum volatility for evenly spaced return targets (no sector or turnover limits); infeasible ones are left out."""
    lo, hi = F.array_min("mu"), F.array_max("mu")
    flat = F.abs(hi - lo) <= 1e-12
    targets = F.when(flat, F.array(lo)).otherwise(
        F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda k: lo + (hi - lo) * k / (points - 1))
    )
    rows = problem.select(PID, "mu", "cov", flat.alias("flat"), F.explode(targets).alias("target"))
    lower = 0.0 if long_only else -1.0

    def solve(frames):
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                cov, mu = _unpack(row)
                w, gap = _min_variance(
                    cov, mu, (lower, max_position, None, 1.0, None, None), None if row.flat else float(row.target)
                )
                if gap <= 1e-6:
                    out.append((getattr(row, PID), row.target, float(np.sqrt(max(w @ cov @ w, 0.0)))))
            yield pd.DataFrame(out, columns=[PID, "expected_return", "volatility"])

    key = f"{PID} {problem.schema[PID].dataType.simpleString()}"
    return _spread(rows).mapInPandas(solve, f"{key}, expected_return double, volatility double")


def lattice_search(problem: DataFrame, steps: int = 10, max_position: float = MAX_POSITION, max_sector: float = MAX_SECTOR) -> DataFrame:
    """Best Sharpe ratio among all weight vectors on a grid of 1/steps that meet the caps.

    Each portfolio row unfolds into its own grid; nothing is joined. The grid has C(assets + steps - 1, steps)
    points, so this is an exact check for portfolios of moderate size.
    """
    k_max = int(round(max_position * steps))
    df = problem.withColumn("n", F.size("tickers")).withColumn("g", F.array().cast("array<int>"))
    most = problem.agg(F.max(F.size("tickers"))).first()[0] or 0
    for pos in range(most):
        left = F.lit(steps) - F.aggregate("g", F.lit(0), lambda acc, v: acc + v)
        # The last asset takes what is left; positions beyond the last stay untouched.
        options = (
            F.when(F.lit(pos) >= F.col("n"), F.array(F.lit(-1)))
            .when(F.lit(pos) == F.col("n") - 1, F.when(left <= k_max, F.array(left)).otherwise(F.array().cast("array<int>")))
            .otherwise(F.sequence(F.lit(0), F.least(left, F.lit(k_max))))
        )
        df = df.withColumn("__k", F.explode(options)).withColumn(
            "g", F.when(F.col("__k") >= 0, F.array_append("g", F.col("__k"))).otherwise(F.col("g"))
        )
    w = F.transform("g", lambda v: v / F.lit(float(steps)))
    df = df.withColumn("w", w)
    if max_sector < 1.0:
        pairs = F.arrays_zip("sectors", "w")
        over = F.exists(
            "sectors",
            lambda s: F.aggregate(F.filter(pairs, lambda z: z["sectors"] == s), F.lit(0.0), lambda a, z: a + z["w"]) > max_sector + 1e-9,
        )
        df = df.filter(~over)
    n = F.col("n")
    dot = F.aggregate(F.zip_with("w", "mu", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    quad = F.aggregate(
        F.transform("cov", lambda c, i: c * F.get("w", (i / n).cast("int")) * F.get("w", i % n)),
        F.lit(0.0), lambda a, b: a + b,
    )
    df = df.select(PID, "tickers", "g", dot.alias("ret"), F.sqrt(F.greatest(quad, F.lit(1e-12))).alias("vol"))
    df = df.withColumn("sharpe", F.round(F.col("ret") / F.col("vol"), 9))
    best = df.groupBy(PID).agg(F.max_by(F.struct("tickers", "g", "ret", "vol", "sharpe"), F.struct("sharpe", "g")).alias("b"))
    return best.select(PID, "b.*")
