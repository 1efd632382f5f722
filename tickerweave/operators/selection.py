"""Feature selection on aggregates: variance, correlation pruning, binned mutual information, fold stability.

The data is only ever aggregated: one pass for means, one for the Gram vectors
of every fold and a few counts that close in on the deciles of all folds. No
row is moved or stored; what reaches the driver are a feature-by-feature matrix
per fold and counts of bounded number.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerweave.functions.ranks import at_ranks
from tickerweave.session import reuse

MAX_CORRELATION = 0.95
BOTTOM_VARIANCE = 0.05
MIN_MI_SHARE = 0.05
MI_CAP = 80


@dataclass
class FoldStats:
    n: float
    var: np.ndarray
    corr: np.ndarray
    target: np.ndarray


def _matrices(n, s, g, k):
    """Variance and correlation from sums and the upper triangle of products (last entry is the label)."""
    m = np.zeros((k + 1, k + 1))
    m[np.triu_indices(k + 1)] = g
    m = m + np.triu(m, 1).T
    cov = (m - np.outer(s, s) / n) / (n - 1)
    sd = np.sqrt(np.clip(np.diag(cov), 0, None))
    with np.errstate(divide="ignore", invalid="ignore"):
        corr = np.nan_to_num(cov / np.outer(sd, sd))
    return FoldStats(n, np.diag(cov)[:k], np.abs(corr[:k, :k]), np.abs(corr[:k, k]))


def fold_statistics(df: DataFrame, features: list[str], label: str = "label", fold: Column | None = None, folds: int = 1) -> dict[int, FoldStats]:
    """Statistics of the rows of each fold. `fold` is the first fold whose training rows contain the row
    (training sets grow, so later folds contain it too); NULL rows belong to none."""
    fold = F.lit(0) if fold is None else fold
    x = df.select(fold.cast("int").alias("f"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features],
                  F.col(label).cast("double").alias("__y")).filter("f IS NOT NULL")
    names = [*features, "__y"]
    mean = x.agg(vector_to_array(Summarizer.mean(array_to_vector(F.array(*names)))).alias("m")).first()
    if mean is None or mean["m"] is None:
        return {}
    centred = F.array(*[F.col(c) - F.lit(float(m)) for c, m in zip(names, mean["m"])])
    k = len(names)
    upper = np.triu_indices(k)

    def add_up(batches):
        sums = {}
        for b in batches:
            of, c = b.column(0).to_numpy(), b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            for f in np.unique(of).tolist():
                z = c[of == f]
                n, s, g = sums.get(f, (0, 0.0, 0.0))
                sums[f] = n + len(z), s + z.sum(axis=0), g + z.T @ z
        out = [(f, n, s.tolist(), g[upper].tolist()) for f, (n, s, g) in sums.items()]
        yield pa.RecordBatch.from_pylist([dict(zip(("f", "n", "s", "g"), r)) for r in out], pa.schema(
            {"f": pa.int32(), "n": pa.int64(), "s": pa.list_(pa.float64()), "g": pa.list_(pa.float64())}.items()))

    v = x.select("f", centred.alias("c")).mapInArrow(add_up, "f int, n long, s array<double>, g array<double>")
    rows = v.groupBy("f").agg(F.sum("n").alias("n"), *[vector_to_array(Summarizer.sum(array_to_vector(c))).alias(c) for c in ("s", "g")]).collect()
    part = {r["f"]: r for r in rows}
    out, n, s, g = {}, 0.0, 0.0, 0.0
    for f in range(folds):
        if f in part:
            n, s, g = n + part[f]["n"], s + np.array(part[f]["s"]), g + np.array(part[f]["g"])
        if n > 1:
            out[f] = _matrices(n, s, g, len(features))
    return out


def mutual_information(df: DataFrame, features: list[str], label: str, first: Column | None = None, folds: int = 1, bins: int = 10) -> DataFrame:
    """(fold, feature, mi): mutual information in nats of each feature, cut at its exact deciles, with a 0/1 label.

    `first` is the first fold whose training rows hold the row (training sets grow, so later folds hold it too); rows
    without one, or without a label, take no part. Missing values count as 0.

    The plan does not grow with the features and moves no rows: the deciles of all features and folds are closed in on
    together by counts, which also tell how many rows of each label lie up to each of them. df is read some four times; keep it (session.reuse)
    where its rows are dear to make.
    """
    first = F.lit(0) if first is None else first
    x = df.select(first.cast("int").alias("s"), F.col(label).cast("int").alias("y"),
                  *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"x{k}") for k, c in enumerate(features)])
    # No filter: pushed down it would repeat the expression of `first` many times over.
    kind = F.when(F.col("s").between(0, folds - 1), 2 * F.col("s") + (F.col("y") == 1).cast("int"))
    x = x.select(F.lit(0).alias("g"), F.coalesce(kind, F.lit(-1)).alias("c"), *[f"x{k}" for k in range(len(features))])

    def wanted(sizes):
        n = {(k, f): int(sizes[k][:2 * f + 2].sum()) for k in sizes for f in range(folds)}
        return [(k, 2 * f + 2, -(-b * n[k, f] // bins)) for k, f in n if n[k, f] for b in range(1, bins)]

    sizes, cuts = at_ranks(x, len(features), wanted, 2 * folds)
    # Rows of a fold up to each decile: all of them and those with label 1.
    upto = lambda counts, f: (counts[:2 * f + 2].sum(), counts[1:2 * f + 2:2].sum())
    cuts, rows = iter(cuts), []
    for k in sizes:
        for f in range(folds):
            total = upto(sizes[k], f)
            if total[0]:
                ends = [(0, 0), *[upto(next(cuts)[2], f) for _ in range(1, bins)], total]
                cells = np.diff(np.array(ends, float), axis=0)
                cells = np.column_stack([cells[:, 1], cells[:, 0] - cells[:, 1]])
                part = np.outer(cells.sum(axis=1), cells.sum(axis=0))
                held = cells > 0
                mi = (cells[held] / total[0] * np.log(cells[held] * total[0] / part[held])).sum()
                rows.append((f, features[k], max(float(mi), 0.0)))
    return df.sparkSession.createDataFrame(rows, "fold int, feature string, mi double")


def prune_correlated(features: list[str], corr: np.ndarray, target: np.ndarray, limit: float = MAX_CORRELATION) -> list[str]:
    """Names to drop: walking in order, of each pair above the limit the one less tied to the label goes."""
    gone: set[int] = set()
    for j in range(len(features)):
        for i in range(j):
            if j in gone:
                break
            if i in gone or corr[i, j] <= limit:
                continue
            gone.add(i if target[j] >= target[i] else j)
    return [features[k] for k in sorted(gone)]


@dataclass
class Selection:
    selected: list[str]
    low_variance: list[str] = field(default_factory=list)
    correlated: list[str] = field(default_factory=list)
    low_mi: list[str] = field(default_factory=list)
    mi: dict[str, float] = field(default_factory=dict)


def robust_select(features: list[str], stats: FoldStats, mi: dict[str, float]) -> Selection:
    """Adaptive variance floor, label-aware pruning, then everything above 5 % of the best information."""
    floor = max(float(np.percentile(stats.var, BOTTOM_VARIANCE * 100)), 1e-9)
    keep = [k for k in range(len(features)) if stats.var[k] >= floor]
    names = [features[k] for k in keep]
    drop = prune_correlated(names, stats.corr[np.ix_(keep, keep)], stats.target[keep])
    left = [c for c in names if c not in set(drop)]
    ranked = sorted(left, key=lambda c: (-mi.get(c, 0.0), c))
    best = mi.get(ranked[0], 0.0) if ranked else 0.0
    chosen = [c for c in ranked if mi.get(c, 0.0) >= best * MIN_MI_SHARE][:MI_CAP]
    return Selection(
        chosen, [c for c in features if c not in set(names)], drop, [c for c in left if c not in set(chosen)], {c: mi.get(c, 0.0) for c in left}
    )


def basic_select(df: DataFrame, features: list[str], label: str = "label", top_n: int = 60, min_variance: float = 1e-5) -> list[str]:
    """Fixed variance floor (population form), later column of each correlated pair dropped, top-n by information."""
    df = reuse(df.select(label, *features))
    s = fold_statistics(df, features, label)[0]
    pop = s.var * (s.n - 1) / s.n
    keep = [k for k in range(len(features)) if pop[k] > min_variance]
    names = [features[k] for k in keep]
    c = s.corr[np.ix_(keep, keep)]
    names = [n for j, n in enumerate(names) if not any(c[i, j] > MAX_CORRELATION for i in range(j))]
    if len(names) > top_n:
        mi = {r["feature"]: r["mi"] for r in mutual_information(df, names, label).collect()}
        names = sorted(names, key=lambda n: (-mi.get(n, 0.0), n))[:top_n]
    return names


def stability_select(split: DataFrame, features: list[str], label: str = "label", folds: int = 5, min_folds: int = 3) -> tuple[list[str], DataFrame]:
    """Features chosen in at least `min_folds` training sets, by mean information; plus one audit row per fold and feature.

    `split` carries the columns of walk_forward with at least `folds` folds. It is read some six times; keep it
    (session.reuse) where its rows are dear to make.
    """
    first = F.col("train_fold")
    stats = fold_statistics(split, features, label, first, folds)
    mi: dict[int, dict[str, float]] = {}
    for r in mutual_information(split, features, label, first, folds).collect():
        mi.setdefault(r["fold"], {})[r["feature"]] = r["mi"]
    rows = []
    for f, s in stats.items():
        sel = robust_select(features, s, mi.get(f, {}))
        for c in features:
            stage = "low_variance" if c in sel.low_variance else "correlated" if c in sel.correlated else "low_mi" if c in sel.low_mi else "selected"
            rows.append((f, c, stage, float(sel.mi.get(c, 0.0))))
    spark = split.sparkSession
    audit = spark.createDataFrame(rows, "fold int, feature string, stage string, mi double")
    need = min(min_folds, len(stats))
    hits: dict[str, list[float]] = {}
    count: dict[str, int] = {}
    for _, c, stage, m in rows:
        hits.setdefault(c, []).append(m)
        count[c] = count.get(c, 0) + (stage == "selected")
    stable = sorted([c for c in features if count.get(c, 0) >= need], key=lambda c: -float(np.mean(hits[c])))
    return stable, audit


def selection_audit(audit: DataFrame, min_folds: int = 3) -> DataFrame:
    """Per feature: folds it was chosen in, mean information, stages it was dropped at, whether it stays."""
    n = audit.agg(F.countDistinct("fold").alias("n_folds"))
    a = audit.groupBy("feature").agg(
        F.count_if(F.col("stage") == "selected").alias("folds_selected"),
        F.avg("mi").alias("mean_mi"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("stage") != "selected", F.col("stage")))), ",").alias("dropped_at"),
    )
    a = a.withColumn("__k", F.lit(1)).join(n.withColumn("__k", F.lit(1)), "__k").drop("__k")
    need = F.least(F.lit(min_folds).cast("bigint"), F.col("n_folds"))
    k = F.col("folds_selected")
    return a.select(
        "feature", "folds_selected", "mean_mi", "dropped_at", (k >= need).alias("kept"),
        consistency_label(k, F.col("n_folds"), need).alias("consistency"),
    )


def consistency_label(k: Column, n: Column, need: Column) -> Column:
    """How often a feature was selected: "all" folds, "most" (enough to be kept), "once" or "mixed"."""
    return F.when(k == n, "all").when(k >= need, "most").when(k == 1, "once").otherwise("mixed")


def top_features(importance: DataFrame, n: int, group: list[str] = (), value: str = "importance") -> DataFrame:
    w = Window.partitionBy(*group).orderBy(F.abs(value).desc(), "feature") if group else Window.orderBy(F.abs(value).desc(), "feature")
    return importance.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
