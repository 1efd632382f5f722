"""Random forests of few rows: the trees are spread over tasks, and each is grown level by level inside one.

A tree draws its rows with Poisson weights, looks at a few random features per node, and splits by the Gini index at up to
BINS - 1 cuts per feature, taken from the training rows alone. Larger sets of rows are left to MLlib (see training).
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerweave.operators.blocks import checkpoint_folder, to_blocks

BINS = 32
#: Rows of a forest that is grown in tasks: 33 MB at 83 features.
IN_TASK = 50_000
#: What MLlib stores of a node.
_NODES = """treeID int, nodeData struct<id int, prediction double, impurity double, impurityStats array<double>, rawCount bigint, gain double,
    leftChild int, rightChild int, split struct<featureIndex int, leftCategoriesOrThreshold array<double>, numCategories int>>"""
_KINDS = {"feature": np.int32, "threshold": np.float64, "left": np.int32, "value": np.float64, "cover": np.int32, "gain": np.float32}


@dataclass
class Forest:
    """Trees as arrays (feature, threshold, left, value, cover, gain): a row goes to node `left` when its value is at most the
    threshold, otherwise to the node behind it; feature is -1 in a leaf, whose value is its share of ones."""

    features: int
    trees: list

    def probability(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for t in self.trees:
            node, at = np.zeros(len(x), np.int64), np.arange(len(x))
            while len(at):
                f = t["feature"][node[at]]
                at, f = at[f >= 0], f[f >= 0]
                node[at] = t["left"][node[at]] + (x[at, f] > t["threshold"][node[at]])
            out += t["value"][node]
        return out / max(1, len(self.trees))

    def transform(self, df: DataFrame, out: str = "p", vector: str = "features") -> DataFrame:
        """df with the probability of a rise."""
        sent = df.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("double")
        def probability(x: pd.Series) -> pd.Series:
            return pd.Series(sent.value.probability(np.stack(x.to_numpy())) if len(x) else [], dtype="float64")

        return df.withColumn(out, probability(vector_to_array(vector)))

    def importance(self) -> np.ndarray:
        """Share of the splits' gains per feature, every tree with the same weight."""
        total = np.zeros(self.features)
        for t in self.trees:
            inner = t["feature"] >= 0
            gains = np.bincount(t["feature"][inner], t["gain"][inner], self.features)
            total += gains / gains.sum() if gains.sum() else gains
        return total / total.sum() if total.sum() else total

    def to_mllib(self) -> PipelineModel:
        """The same forest as a model of MLlib, which is how forests are stored."""
        spark = SparkSession.getActiveSession()
        path = f"{checkpoint_folder(spark)}/forest-{uuid.uuid4().hex}"

        def head(kind, name, params=None, **more):
            defaults = {"featuresCol": "features", "labelCol": "label", "predictionCol": "prediction", "probabilityCol": "probability",
                        "rawPredictionCol": "rawPrediction", "leafCol": "", "impurity": "gini"}
            return json.dumps({"class": f"org.apache.spark.ml.classification.{kind}", "timestamp": 0, "sparkVersion": spark.version, "uid": name,
                               "paramMap": params or {}, "defaultParamMap": defaults, **more})

        def nodes(item):
            number, t = item
            for k, f in enumerate(t["feature"].tolist()):
                n, v, left = float(t["cover"][k]), float(t["value"][k]), int(t["left"][k])
                gain = float(t["gain"][k]) / n if f >= 0 else -1.0
                yield (number, (k, float(v > 0.5), 2 * v * (1 - v), [n * (1 - v), n * v], int(n), gain, left, left + 1 if f >= 0 else -1,
                                (f, [float(t["threshold"][k])] if f >= 0 else [], -1)))

        n = len(self.trees)
        metadata = head("RandomForestClassificationModel", f"forest_{uuid.uuid4().hex[:12]}", {"numTrees": n}, numFeatures=self.features, numClasses=2, numTrees=n)
        spark.createDataFrame([(metadata,)], "value string").coalesce(1).write.text(f"{path}/metadata")
        trees = [(k, head("DecisionTreeClassificationModel", f"tree_{k}"), 1.0) for k in range(n)]
        spark.createDataFrame(trees, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
        rows = spark.sparkContext.parallelize(list(enumerate(self.trees)), min(n, spark.sparkContext.defaultParallelism)).flatMap(nodes)
        spark.createDataFrame(rows, _NODES).write.parquet(f"{path}/data")
        return PipelineModel([RandomForestClassificationModel.load(path)])


def cuts(values: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Midpoints between neighbouring values: all of them where values are few, otherwise those at the quantiles."""
    u, n = np.unique(values, return_counts=True)
    at = np.arange(len(u) - 1)
    if len(u) > bins:
        wanted = np.arange(1, bins) / bins * len(values)
        at = np.unique(np.minimum(np.searchsorted(np.cumsum(n), wanted), len(u) - 2))
    return u[at] + (u[at + 1] - u[at]) / 2


def grow_tree(bins: np.ndarray, y: np.ndarray, edges: list, rng: np.random.Generator, depth: int, least: int, columns: int) -> dict:
    """One tree on rows of bin numbers: at most `depth` levels of splits, children of at least `least` drawn rows, `columns`
    random features per node."""
    weight = rng.poisson(1.0, len(y)).astype(np.float64)
    rows = np.flatnonzero(weight)
    w, node = weight[rows], np.zeros(len(rows), np.int64)
    wy = w * y[rows]
    width, most = bins.shape[1], max((len(e) for e in edges), default=0) + 1
    feature, threshold, left, gains = [np.array([-1])], [np.zeros(1)], [np.array([-1])], [np.zeros(1)]
    cover, ones = [np.array([w.sum()])], [np.array([wy.sum()])]
    begin, end = 0, 1  # nodes of the level
    square = lambda a, n: (a * a + (n - a) * (n - a)) / np.maximum(n, 1e-300)
    for _ in range(depth):
        n, p = cover[-1], ones[-1]
        open_ = np.flatnonzero((n >= 2 * least) & (p > 0) & (p < n))
        if not len(open_) or most < 2:
            break
        slot = np.full(end, -1)
        slot[begin + open_] = np.arange(len(open_))
        here = slot[node] >= 0
        rows, w, wy, node = rows[here], w[here], wy[here], node[here]
        of = slot[node]
        picked = np.argsort(rng.random((len(open_), width)), axis=1)[:, :columns]
        k = picked.shape[1]
        place = ((of[:, None] * k + np.arange(k)) * most + bins[rows[:, None], picked[of]]).ravel()
        sums = [np.cumsum(np.bincount(place, np.repeat(v, k), len(open_) * k * most).reshape(len(open_), k, most), axis=2)[:, :, :-1] for v in (w, wy)]
        n, p = n[open_][:, None, None], p[open_][:, None, None]
        gain = square(sums[1], sums[0]) + square(p - sums[1], n - sums[0]) - square(p, n)
        gain = np.where(np.minimum(sums[0], n - sums[0]) >= least, gain, 0.0).reshape(len(open_), -1)
        best = gain.argmax(axis=1)
        good = np.flatnonzero(gain[np.arange(len(open_)), best] > 1e-9)
        if not len(good):
            break
        which, cut = np.divmod(best[good], most - 1)
        f, at = picked[good, which], open_[good]
        feature[-1][at], threshold[-1][at], gains[-1][at] = f, [edges[j][c] for j, c in zip(f, cut)], gain[good, best[good]]
        left[-1][at] = end + 2 * np.arange(len(good))
        sides = [s[good, which, cut] for s in sums]
        cover.append(np.stack([sides[0], cover[-1][at] - sides[0]], axis=1).ravel())
        ones.append(np.stack([sides[1], ones[-1][at] - sides[1]], axis=1).ravel())
        for values, v in ((feature, np.full(2 * len(good), -1)), (threshold, np.zeros(2 * len(good))), (left, np.full(2 * len(good), -1)),
                          (gains, np.zeros(2 * len(good)))):
            values.append(v)
        split = np.full(len(open_), -1)
        split[good] = np.arange(len(good))
        mine = split[of]
        here = mine >= 0
        rows, w, wy, mine = rows[here], w[here], wy[here], mine[here]
        node = end + 2 * mine + (bins[rows, f[mine]] > cut[mine])
        begin, end = end, end + 2 * len(good)
    arrays = {"feature": feature, "threshold": threshold, "left": left, "cover": cover, "gain": gains,
              "value": [a / np.maximum(n, 1) for a, n in zip(ones, cover)]}
    return {k: np.concatenate(v).astype(_KINDS[k]) for k, v in arrays.items()}


def fit(train: DataFrame, trees: int, depth: int, least: int, seed: int) -> Forest | None:
    """A forest on `features` and `label`; None where there are more rows than a task should hold. A tree depends on the
    rows and on its number, not on where they lie."""
    spark = train.sparkSession
    blocks = to_blocks(train, [F.lit(True)], 1)
    try:
        if blocks.map(lambda b: len(b["y"])).fold(0, lambda a, b: a + b) > IN_TASK:
            return None
        ways = min(trees, spark.sparkContext.defaultParallelism)

        def grow(item):
            way, parts = item
            x, y, key = (np.concatenate(c) for c in zip(*parts))
            order = np.lexsort((y, key))
            x, y = x[order], y[order]
            edges = [cuts(x[:, f]) for f in range(x.shape[1])]
            bins = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1).astype(np.uint8)
            columns = math.ceil(math.sqrt(x.shape[1]))
            return [(t, x.shape[1], grow_tree(bins, y, edges, np.random.default_rng((seed, t)), depth, least, columns)) for t in range(way, trees, ways)]

        rows = blocks.flatMap(lambda b: [(way, (b["x"], b["y"], b["key"])) for way in range(ways)])
        grown = sorted(rows.groupByKey(ways, partitionFunc=int).flatMap(grow).collect(), key=lambda g: g[0])
    finally:
        blocks.unpersist()
    if not grown:
        raise ValueError("no labelled rows to grow a forest on")
    return Forest(grown[0][1], [t for _, _, t in grown])
