"""Attributions: exact for linear models and trees, sampled Shapley values for any model, local linear surrogates."""

from __future__ import annotations

import math
import uuid

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickerweave.operators import boosting, training
from tickerweave.operators.forest import Forest
from tickerweave.operators.blocks import checkpoint_folder
from tickerweave.operators.portfolio import _pairs


def linear_attribution(rows: DataFrame, coefficients: dict[str, float], means: DataFrame, intercept: float = 0.0) -> DataFrame:
    """(ticker, date, feature, attribution, feature_value, base_value): coefficient times distance from the mean.

    `means` is one row with the mean of each feature.
    """
    names = list(coefficients)
    m = means.select(*[F.col(c).alias(f"__m_{c}") for c in names], F.lit(1).alias("__k"))
    df = rows.select("ticker", "date", *names, F.lit(1).alias("__k")).join(m, "__k")
    base = F.lit(intercept)
    for c in names:
        base = base + coefficients[c] * F.col(f"__m_{c}")
    parts = F.array(*[
        F.struct(F.lit(c).alias("feature"), (coefficients[c] * (F.col(c) - F.col(f"__m_{c}"))).alias("attribution"), F.col(c).cast("double").alias("feature_value"))
        for c in names
    ])
    return df.select("ticker", "date", base.alias("base_value"), F.explode(parts).alias("a")).select("ticker", "date", "a.*", "base_value")


def _uniform(*keys):
    """Reproducible uniform number in (0, 1) from a hash of the keys."""
    return (F.pmod(F.xxhash64(*keys), F.lit(1_000_003)) + 0.5) / 1_000_003


def shapley_attribution(model, rows: DataFrame, features: list[str], means: DataFrame, permutations: int = 8) -> DataFrame:
    """Sampled Shapley values around the feature means: (ticker, date, feature, attribution, base_value).

    Each row unfolds into seeded feature orders; along an order the features are
    switched from the mean to the row's value one by one and the change of the
    score is credited to the switched feature. The values add up to the score
    minus the base score.
    """
    n = len(features)
    m = means.select(F.array(*[F.col(c).cast("double") for c in features]).alias("__m"), F.lit(1).alias("__k"))
    df = rows.select("ticker", "date", F.array(*[F.col(c).cast("double") for c in features]).alias("__x"), F.lit(1).alias("__k")).join(m, "__k")
    df = df.withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))))
    keyed = F.array(*[F.struct(F.xxhash64("ticker", "date", "perm", F.lit(i)).alias("h"), F.lit(i).alias("i")) for i in range(n)])
    df = df.withColumn("__order", F.transform(F.sort_array(keyed), lambda s: s["i"]))
    df = df.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(n))))
    on = F.slice("__order", F.lit(1), F.col("step"))
    mixed = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(F.array_contains(on, i), F.get("__x", i)).otherwise(F.get("__m", i)))
    df = df.select("ticker", "date", "perm", "step", F.get("__order", F.col("step") - 1).alias("i"), array_to_vector(mixed).alias("features"))
    s = training.predict(model, df).select("ticker", "date", "perm", "step", "i", "p")
    w = Window.partitionBy("ticker", "date", "perm").orderBy("step")
    s = s.withColumns({"change": F.col("p") - F.lag("p").over(w), "base": F.first("p").over(w)}).filter("step > 0")
    name = F.element_at(F.array(*[F.lit(c) for c in features]), F.col("i") + 1)
    return s.groupBy("ticker", "date", name.alias("feature")).agg(F.avg("change").alias("attribution"), F.avg("base").alias("base_value"))


# --- trees ------------------------------------------------------------------------------------


def ensemble(model) -> tuple[list[dict], float]:
    """(trees as arrays, start) of a fitted forest or boosted ensemble: feature (-1: leaf), threshold (at most: left), left,
    right, value and cover (training rows). The score is the start plus the values of the leaves reached: a probability
    for a forest, log odds for boosted trees."""
    if isinstance(model, boosting.Boosted):
        out = []
        for t in model.trees:
            cuts = np.array([model.edges[f][c] if f >= 0 and c < len(model.edges[f]) else np.inf for f, c in zip(t["feature"], t["cut"])])
            out.append({"feature": t["feature"], "threshold": cuts, "left": t["left"], "right": t["left"] + 1, "value": t["value"], "cover": t["cover"]})
        return out, model.start
    if isinstance(model, Forest):
        n = len(model.trees)
        return [{**{k: t[k] for k in ("feature", "threshold", "left", "cover")}, "right": t["left"] + 1, "value": t["value"] / n} for t in model.trees], 0.0
    forest = model.stages[-1]
    spark = SparkSession.getActiveSession()
    path = f"{checkpoint_folder(spark)}/forest-{uuid.uuid4().hex}"
    forest.save(path)
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").orderBy("treeID", "id").toPandas()
    out = []
    for _, t in nodes.groupby("treeID"):
        stats = np.stack(t["impurityStats"].to_numpy())
        inner = t["leftChild"].to_numpy() >= 0
        out.append({
            "feature": np.where(inner, [s["featureIndex"] for s in t["split"]], -1),
            "threshold": np.array([s["leftCategoriesOrThreshold"][0] if i else 0.0 for s, i in zip(t["split"], inner)]),
            "left": t["leftChild"].to_numpy(), "right": t["rightChild"].to_numpy(),
            "value": stats[:, 1] / stats.sum(axis=1) / forest.getNumTrees, "cover": stats.sum(axis=1)})
    return out, 0.0


def leaf_paths(tree: dict) -> tuple[np.ndarray, ...]:
    """(value, feature, low, high, share) of the leaves: per leaf the different features on its path, padded with -1, the
    interval that each has to lie in, and the share of the training rows that its conditions let through."""
    leaves, todo = [], [(0, {})]
    while todo:
        node, path = todo.pop()
        f = int(tree["feature"][node])
        if f < 0:
            leaves.append((tree["value"][node], path))
            continue
        cut = tree["threshold"][node]
        for child, side in ((int(tree["left"][node]), 0), (int(tree["right"][node]), 1)):
            low, high, share = path.get(f, (-np.inf, np.inf, 1.0))
            share *= tree["cover"][child] / tree["cover"][node]
            todo.append((child, {**path, f: (low, min(high, cut), share) if side == 0 else (max(low, cut), high, share)}))
    depth = max(1, max(len(p) for _, p in leaves))
    feature = np.full((len(leaves), depth), -1)
    low, high, share = np.full((len(leaves), depth), -np.inf), np.full((len(leaves), depth), np.inf), np.ones((len(leaves), depth))
    for k, (_, path) in enumerate(leaves):
        for j, (f, (a, b, z)) in enumerate(path.items()):
            feature[k, j], low[k, j], high[k, j], share[k, j] = f, a, b, z
    return np.array([v for v, _ in leaves]), feature, low, high, share


def path_attribution(paths: tuple[np.ndarray, ...], x: np.ndarray) -> np.ndarray:
    """Shapley values of one row under one tree, where a feature left out lets through its share of the training rows.

    Of a leaf, the weights of all coalitions by size are the coefficients of the product of (share + inside t) over the
    features of its path; leaving a feature out is dividing by its factor. Padded features have factor 1 + t and value 0.
    """
    value, feature, low, high, share = paths
    depth = feature.shape[1]
    at = np.where(feature >= 0, x[feature], 0.0)
    inside = (feature < 0) | ((at > low) & (at <= high))
    poly = np.zeros((len(value), depth + 1))
    poly[:, 0] = 1.0
    for j in range(depth):
        poly[:, 1:] = poly[:, 1:] * share[:, j, None] + poly[:, :-1] * inside[:, j, None]
        poly[:, 0] *= share[:, j]
    weights = [math.factorial(k) * math.factorial(depth - 1 - k) / math.factorial(depth) for k in range(depth)]
    total = np.zeros((len(value), depth))
    rest = np.zeros((len(value), depth))
    safe = np.maximum(share, 1e-300)
    for k in range(depth - 1, -1, -1):
        rest = np.where(inside, poly[:, k + 1, None] - share * rest if k < depth - 1 else poly[:, k + 1, None], poly[:, k, None] / safe)
        total += weights[k] * rest
    out = np.zeros(len(x))
    np.add.at(out, np.maximum(feature, 0), np.where(feature >= 0, value[:, None] * (inside - share) * total, 0.0))
    return out


def tree_attribution(model, rows: DataFrame, features: list[str], chunk: int = 10) -> DataFrame:
    """Exact attributions of a forest or of boosted trees: (ticker, date, feature, attribution, base_value), which add up to
    the score (see ensemble) less the base value, the mean score of the training rows.

    Every row meets the ensemble in chunks of trees; chunks are spread over the tasks and their vectors added up by row.
    """
    trees, start = ensemble(model)
    # The shares on the way to a leaf multiply to its part of the tree's rows.
    base = start + float(sum((t["value"] * t["cover"])[t["feature"] < 0].sum() / t["cover"][0] for t in trees))
    sent = rows.sparkSession.sparkContext.broadcast(trees)
    chunks = max(1, -(-len(trees) // chunk))
    df = rows.select("ticker", "date", F.array(*[F.col(c).cast("double") for c in features]).alias("x"))
    df = df.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).repartition("chunk")

    def attribute(frames):
        for f in frames:
            out = np.zeros((len(f), len(features)))
            for c, at in f.groupby("chunk").indices.items():
                for t in sent.value[c * chunk : (c + 1) * chunk]:
                    paths = leaf_paths(t)
                    for k in at:
                        out[k] += path_attribution(paths, np.asarray(f["x"].iloc[k], float))
            yield pd.DataFrame({"ticker": f["ticker"], "date": f["date"], "a": list(out)})

    parts = df.mapInPandas(attribute, "ticker string, date date, a array<double>")
    sums = parts.groupBy("ticker", "date").agg(vector_to_array(Summarizer.sum(array_to_vector("a"))).alias("a"))
    named = F.arrays_zip(F.array(*[F.lit(c) for c in features]).alias("feature"), F.col("a").alias("attribution"))
    return sums.select("ticker", "date", F.inline(named), F.lit(base).alias("base_value"))


def global_importance(attributions: DataFrame) -> DataFrame:
    return attributions.groupBy("feature").agg(F.avg(F.abs("attribution")).alias("importance"))


def top_drivers(attributions: DataFrame, n: int = 10) -> DataFrame:
    """The n largest attributions per row with their side."""
    w = Window.partitionBy("ticker", "date").orderBy(F.abs("attribution").desc(), "feature")
    side = F.when(F.col("attribution") > 0, "bullish").otherwise("bearish")
    return attributions.withColumns({"rank": F.row_number().over(w), "direction": side}).filter(F.col("rank") <= n)


def local_surrogate(model, rows: DataFrame, features: list[str], spread: DataFrame, samples: int = 200, ridge: float = 1.0, n: int = 10) -> DataFrame:
    """Weighted ridge fit of the score around each row: (ticker, date, feature, weight, rank).

    `spread` is one row with the deviation of each feature. Perturbations are
    seeded normal draws; their weights fall with the distance; the normal
    equations are summed by Spark and only a small system per row is solved.
    """
    k = len(features)
    width = 0.75 * math.sqrt(k)
    s = spread.select(F.array(*[F.col(c).cast("double") for c in features]).alias("__s"), F.lit(1).alias("__k"))
    df = rows.select("ticker", "date", F.array(*[F.col(c).cast("double") for c in features]).alias("__x"), F.lit(1).alias("__k")).join(s, "__k")
    df = df.withColumn("j", F.explode(F.sequence(F.lit(1), F.lit(samples))))
    z = [
        F.sqrt(-2 * F.ln(_uniform(F.col("ticker"), F.col("j"), F.lit(2 * i)))) * F.cos(2 * math.pi * _uniform(F.col("ticker"), F.col("j"), F.lit(2 * i + 1)))
        for i in range(k)
    ]
    df = df.withColumn("z", F.array(*z))
    x = F.zip_with(F.zip_with("z", "__s", lambda a, b: a * F.coalesce(b, F.lit(0.0))), "__x", lambda d, v: v + d)
    df = df.select("ticker", "date", "j", "z", array_to_vector(x).alias("features"))
    p = training.predict(model, df)
    d2 = F.aggregate("z", F.lit(0.0), lambda a, v: a + v * v)
    row = F.concat(F.col("z"), F.array(F.lit(1.0), F.col("p")))
    p = p.select("ticker", "date", F.exp(-d2 / (width * width)).alias("w"), array_to_vector(_pairs(row, lambda a, b: a * b)).alias("g"))
    eq = p.groupBy("ticker", "date").agg(vector_to_array(Summarizer.mean(F.col("g"), F.col("w"))).alias("g"), F.sum("w").alias("w"))

    def solve(frames):
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                m = np.zeros((k + 2, k + 2))
                m[np.triu_indices(k + 2)] = np.asarray(r.g) * r.w
                m = m + np.triu(m, 1).T
                a, b = m[: k + 1, : k + 1] + ridge * np.diag([1.0] * k + [0.0]), m[: k + 1, k + 1]
                beta = np.linalg.lstsq(a, b, rcond=None)[0][:k]
                order = sorted(range(k), key=lambda i: (-abs(beta[i]), features[i]))[:n]
                out += [(r.ticker, r.date, features[i], float(beta[i]), pos + 1) for pos, i in enumerate(order)]
            yield pd.DataFrame(out, columns=["ticker", "date", "feature", "weight", "rank"])

    return eq.mapInPandas(solve, "ticker string, date date, feature string, weight double, rank int")
