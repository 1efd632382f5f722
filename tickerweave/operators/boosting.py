"""Boosted trees on histograms: all fits (folds, members, trials) grow their trees side by side, one Spark job per step.

Features are bin numbers. A job walks the rows down the trees grown so far and adds up gradient, curvature and row count per
(fit, node, feature, bin); of two children only the one with less curvature is summed, the other is its parent less that.
Leaves get second-order values. Two flavours: level by level to a depth, or best leaf first up to a number of leaves. Sums and
trees are bounded by fits, leaves, features and bins; rows never leave their tasks. A fit of at most IN_TASK rows would spend its
time on starting jobs; such fits are grown by the same steps in one task each.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import RDD, StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerweave.operators.blocks import add_up, to_blocks, use_checkpoints

BINS = 32
#: Rows of a fit that is grown in one task: 4 MB of bins at 83 features.
IN_TASK = 50_000
#: Rounds after which the rows' scores are cut off from what they were computed from.
CUT = 20


@dataclass(frozen=True)
class Flavour:
    """l2: added to the curvature of a leaf; least_curvature, least_rows: of each child; leafwise: best leaf first."""

    l2: float
    least_curvature: float
    least_rows: int
    leafwise: bool
    sampled: bool


# The regularisation the two flavours are known for. The leafwise one draws rows only when told how often
# (its default is never), so that its share of rows has no effect.
FLAVOURS = {
    "xgboost": Flavour(l2=1.0, least_curvature=1.0, least_rows=0, leafwise=False, sampled=True),
    "lightgbm": Flavour(l2=0.0, least_curvature=1e-3, least_rows=20, leafwise=True, sampled=False),
}


@dataclass
class Fit:
    """A set of training rows and what is asked of the trees."""

    rows: int
    flavour: str
    params: dict
    seed: int = 42

    @property
    def rounds(self) -> int:
        return int(self.params["n_estimators"])


@dataclass
class Boosted:
    """A fitted ensemble: cuts per feature, a start and trees as arrays (feature, cut, left, value, cover). A row goes left,
    to node `left`, when its bin is at most `cut`, otherwise to the node behind it; feature is -1 in a leaf."""

    features: int
    edges: list
    start: float = 0.0
    trees: list = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        bins = bin_numbers(x, self.edges)
        out = np.full(len(x), self.start)
        for t in self.trees:
            out += t["value"][_walk(t, bins)]
        return out

    def transform(self, df: DataFrame, out: str = "p", vector: str = "features") -> DataFrame:
        """df with the probability of a rise."""

        @F.pandas_udf("double")
        def probability(x: pd.Series) -> pd.Series:
            return pd.Series(_sigmoid(self.margin(np.stack(x.to_numpy()))) if len(x) else [], dtype="float64")

        return df.withColumn(out, probability(vector_to_array(vector)))

    def importance(self) -> np.ndarray:
        """Share of the splits' gains per feature."""
        total = np.zeros(self.features)
        for t in self.trees:
            inner = t["feature"] >= 0
            np.add.at(total, t["feature"][inner], t["gain"][inner])
        return total / total.sum() if total.sum() else total

    def save(self, path: str) -> None:
        parts = [json.dumps({"features": self.features, "edges": [list(map(float, e)) for e in self.edges], "start": self.start})]
        parts += [json.dumps({k: v.tolist() for k, v in t.items()}) for t in self.trees]
        spark = SparkSession.getActiveSession()
        rows = spark.createDataFrame([(k, p) for k, p in enumerate(parts)], "part int, json string")
        rows.coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(path: str) -> "Boosted":
        rows = SparkSession.getActiveSession().read.parquet(path).orderBy("part").collect()
        head = json.loads(rows[0]["json"])
        kinds = {"feature": np.int32, "cut": np.int32, "left": np.int32}
        trees = [{k: np.array(v, kinds.get(k, np.float64)) for k, v in json.loads(r["json"]).items()} for r in rows[1:]]
        return Boosted(head["features"], [np.array(e) for e in head["edges"]], head["start"], trees)


def _sigmoid(z):
    return 0.5 * (1.0 + np.tanh(0.5 * z))


def bin_numbers(x: np.ndarray, edges: list) -> np.ndarray:
    """How many of its feature's cuts lie below each value."""
    return np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1).astype(np.uint8)


def quantile_edges(df: DataFrame, bins: int = BINS, vector: str = "features") -> list[np.ndarray]:
    """Cuts of every feature at its approximate quantiles over all rows: bounded sketches, one aggregation, no labels."""
    x = df.select(vector_to_array(vector).alias("x"))
    width = x.select(F.size("x")).first()[0]
    shares = F.array(*[F.lit(k / bins) for k in range(1, bins)])
    row = x.agg(*[F.percentile_approx(F.col("x")[f], shares, F.lit(100 * bins)).alias(f"e{f}") for f in range(width)]).first()
    return [np.unique(np.array(row[f"e{f}"], np.float64)) for f in range(width)]


def _walk(tree: dict, bins: np.ndarray) -> np.ndarray:
    """The leaf of each row."""
    node, at = np.zeros(len(bins), np.int64), np.arange(len(bins))
    while len(at):
        f = tree["feature"][node[at]]
        at, f = at[f >= 0], f[f >= 0]
        node[at] = tree["left"][node[at]] + (bins[at, f] > tree["cut"][node[at]])
    return node


def chosen(key: np.ndarray, seed: int, share: float) -> np.ndarray:
    """A share of the rows by a hash of their key and the seed, the same in whatever task a row lies."""
    z = key.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15) % (1 << 64))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    z = z ^ (z >> np.uint64(31))
    return (z >> np.uint64(11)).astype(np.float64) < share * float(1 << 53)


def best_split(hist: np.ndarray, sums: np.ndarray, flavour: Flavour):
    """(gain, feature, cut, sums of the left side) of the best split of a node from its sums (3, features, bins); gain 0
    where no split helps. Of gains that are equal but for the order of summing the first feature and cut wins."""
    left = np.cumsum(hist, axis=2)[:, :, :-1]
    right = sums[:, None, None] - left
    value = lambda s: s[0] ** 2 / np.maximum(s[1] + flavour.l2, 1e-12)
    gain = value(left) + value(right) - value(sums)
    ok = (np.minimum(left[1], right[1]) >= flavour.least_curvature) & (np.minimum(left[2], right[2]) >= max(flavour.least_rows, 1))
    gain = np.where(ok, gain, 0.0)
    f, c = divmod(int((gain >= gain.max() * (1 - 1e-9)).argmax()), gain.shape[1]) if gain.size else (0, 0)
    return (float(gain[f, c]), f, c, left[:, f, c].copy()) if gain.size else (0.0, 0, 0, sums)


class Growth:
    """One tree on its way: nodes by number, children side by side."""

    def __init__(self, fit: Fit, turn: int, width: int):
        rng = np.random.default_rng((fit.seed, fit.rows, turn))
        share = float(fit.params.get("colsample_bytree", 1.0))
        self.columns = np.sort(rng.choice(width, max(1, int(round(share * width))), replace=False))
        self.flavour = FLAVOURS[fit.flavour]
        self.depth_limit = int(fit.params.get("max_depth") or 0) if not self.flavour.leafwise else 0
        self.leaf_limit = int(fit.params.get("num_leaves", 0)) if self.flavour.leafwise else 0
        self.feature, self.cut, self.left, self.depth, self.gain = [-1], [0], [-1], [0], [0.0]
        self.sums, self.hist, self.best, self.parent = [None], {}, {}, {}
        self.leaves, self.split, self.wanted = [0], set(), [0]

    def receive(self, hists: np.ndarray) -> None:
        """Sums of the wanted nodes; their siblings' are the parents' less those."""
        for node, hist in zip(self.wanted, hists):
            self._settle(node, hist)
            if node:
                parent = self.parent[node]
                other = 2 * self.left[parent] + 1 - node
                self._settle(other, self.hist.pop(parent) - hist)
        self.wanted = []
        self._advance()

    def _settle(self, node: int, hist: np.ndarray) -> None:
        if self.sums[node] is None:
            self.sums[node] = hist[:, 0, :].sum(axis=1)
        self.hist[node] = hist
        self.best[node] = best_split(hist, self.sums[node], self.flavour)

    def _open(self, node: int) -> None:
        """Gives the node its children, and asks for the sums of the one with less curvature."""
        gain, f, c, left = self.best[node]
        self.feature[node], self.cut[node], self.left[node], self.gain[node] = int(self.columns[f]), c, len(self.feature), gain
        for sums in (left, self.sums[node] - left):
            self.parent[len(self.feature)] = node
            for values, v in ((self.feature, -1), (self.cut, 0), (self.left, -1), (self.depth, self.depth[node] + 1), (self.sums, sums), (self.gain, 0.0)):
                values.append(v)
        small = self.left[node] + int(self.sums[self.left[node]][1] > self.sums[self.left[node] + 1][1])
        if self.leaf_limit or self.depth[small] < self.depth_limit:
            self.wanted.append(small)

    def _advance(self) -> None:
        helps = lambda n: n in self.best and self.best[n][0] > 1e-12
        if self.depth_limit:
            for node in [n for n in self.leaves if helps(n) and self.depth[n] < self.depth_limit]:
                self._open(node)
                self.split.add(node)
                self.leaves.remove(node)
                self.leaves += [self.left[node], self.left[node] + 1]
            return
        # Best leaf first: whatever is split in the end is a leaf of one of the largest gains now, so those are opened
        # ahead in one go; what turns out not to be needed is left out of the finished tree.
        while len(self.leaves) < self.leaf_limit:
            open_ = sorted((n for n in self.leaves if helps(n)), key=lambda n: (-self.best[n][0], n))
            if not open_:
                return
            if self.left[open_[0]] < 0 or self.left[open_[0]] not in self.best:
                for node in open_[: self.leaf_limit - len(self.leaves)]:
                    if self.left[node] < 0:
                        self._open(node)
                return
            node = open_[0]
            self.split.add(node)
            self.leaves.remove(node)
            self.leaves += [self.left[node], self.left[node] + 1]

    def arrays(self) -> dict:
        """The tree as grown so far, opened nodes included: what rows walk down."""
        return {"feature": np.array(self.feature), "cut": np.array(self.cut), "left": np.array(self.left)}

    def finished(self, rate: float) -> dict:
        """The tree of the nodes that were split, renumbered, with the values of its leaves."""
        order, at = [0], 0
        while at < len(order):
            node = order[at]
            if node in self.split:
                order += [self.left[node], self.left[node] + 1]
            at += 1
        place = {n: k for k, n in enumerate(order)}
        inner = [n in self.split for n in order]
        sums = np.array([self.sums[n] for n in order])
        return {
            "feature": np.array([self.feature[n] if s else -1 for n, s in zip(order, inner)], np.int32),
            "cut": np.array([self.cut[n] if s else 0 for n, s in zip(order, inner)], np.int32),
            "left": np.array([place[self.left[n]] if s else -1 for n, s in zip(order, inner)], np.int32),
            "value": np.where(inner, 0.0, -rate * sums[:, 0] / np.maximum(sums[:, 1] + self.flavour.l2, 1e-12)),
            "cover": sums[:, 2].astype(np.float64), "gain": np.array([self.gain[n] if s else 0.0 for n, s in zip(order, inner)]),
        }


def _histograms(growing: dict, fits: list[Fit], turn: int, bins: int):
    """What a job adds up: per fit in `growing` the sums (nodes, 3, features, bins) of the nodes it wants."""
    plan = [(k, g.arrays(), np.array(g.wanted), g.columns) for k, g in growing.items()]

    def sums(state):
        block, margin = state
        out = []
        for k, tree, wanted, columns in plan:
            fit, width = fits[k], len(columns)
            rows = block["sets"][:, fit.rows]
            share = float(fit.params.get("subsample", 1.0))
            if share < 1.0 and FLAVOURS[fit.flavour].sampled:
                rows = rows & chosen(block["key"], fit.seed * 1_000_003 + turn, share)
            rows = np.flatnonzero(rows)
            slot = np.full(len(tree["feature"]), -1)
            slot[wanted] = np.arange(len(wanted))
            slot = slot[_walk(tree, block["bins"][rows])]
            rows, slot = rows[slot >= 0], slot[slot >= 0]
            p = _sigmoid(margin[rows, k])
            place = ((slot[:, None] * width + np.arange(width)) * bins + block["bins"][rows][:, columns]).ravel()
            size = len(wanted) * width * bins
            parts = [np.bincount(place, np.repeat(v, width), size) for v in (p - block["y"][rows], p * (1 - p))] + [np.bincount(place, minlength=size)]
            out.append(np.stack([h.reshape(len(wanted), width, bins) for h in parts], axis=1))
        return out

    return sums


def boost(blocks: RDD, fits: list[Fit], edges: list[np.ndarray], bins: int = BINS, rungs=(), after=None) -> tuple[list[Boosted], RDD]:
    """(a model per fit, (block, margins of all fits) per block). After as many rounds as a rung says, after(rounds, state)
    returns the numbers of the fits that go on; the others keep the trees they have.

    Margins are kept from round to round and cut off from their history every CUT rounds, so a lost executor costs at most
    that many rounds of its own rows.
    """
    use_checkpoints(SparkSession.getActiveSession())
    width = len(edges)

    def begin(b):
        return [np.stack([b["sets"].sum(0), b["y"] @ b["sets"]])]

    n, ones = add_up(blocks, begin)[0]
    share = np.clip(ones / np.maximum(n, 1), 1e-6, 1 - 1e-6)
    models = [Boosted(width, edges, float(np.log(share[f.rows] / (1 - share[f.rows])))) for f in fits]
    starts = np.array([m.start for m in models])

    def binned(b):
        return {**{k: v for k, v in b.items() if k != "x"}, "bins": bin_numbers(b["x"], edges)}, np.tile(starts, (len(b["y"]), 1))

    if not rungs and max((n[f.rows] for f in fits), default=0) <= IN_TASK:
        for k, trees in _grown_in_tasks(blocks.map(binned), fits, bins).collect():
            models[k].trees = trees

        def scored(s):
            block, margin = s
            for k, m in enumerate(models):
                for t in m.trees:
                    margin[:, k] += t["value"][_walk(t, block["bins"])]
            return block, margin

        state = blocks.map(binned).map(scored).persist(StorageLevel.MEMORY_AND_DISK)
        state.count()
        return models, state

    state, old = blocks.map(binned).persist(StorageLevel.MEMORY_AND_DISK), None
    alive = set(range(len(fits)))
    for turn in range(max((f.rounds for f in fits), default=0)):
        trees = {k: Growth(fits[k], turn, width) for k in sorted(alive) if turn < fits[k].rounds}
        growing = dict(trees)
        while growing:
            for g, hists in zip(list(growing.values()), add_up(state, _histograms(growing, fits, turn, bins))):
                g.receive(hists)
            growing = {k: g for k, g in growing.items() if g.wanted}
            if old is not None:  # the first job of a round computes the margins that the round starts from
                old.unpersist()
                old = None
        done = {k: g.finished(float(fits[k].params["learning_rate"])) for k, g in trees.items()}
        for k, t in done.items():
            models[k].trees.append(t)

        def move(s, done=done):
            block, margin = s
            margin = margin.copy()
            for k, t in done.items():
                margin[:, k] += t["value"][_walk(t, block["bins"])]
            return block, margin

        old, state = state, state.map(move).persist(StorageLevel.MEMORY_AND_DISK)
        if turn % CUT == CUT - 1:
            state.checkpoint()
            state.count()
        if turn + 1 in rungs:
            alive &= set(after(turn + 1, state))
    state.count()
    if old is not None:
        old.unpersist()
    return models, state


def _grown_in_tasks(state: RDD, fits: list[Fit], bins: int) -> RDD:
    """(number of the fit, its trees): every fit's training rows, IN_TASK at most, come together in a task of their own."""

    def training_rows(s):
        block, margin = s
        for k, fit in enumerate(fits):
            at = np.flatnonzero(block["sets"][:, fit.rows])
            yield k, (block["key"][at], block["bins"][at], block["y"][at], margin[at, k])

    def grow(item):
        k, parts = item
        fit = fits[k]
        key, x, y, margin = (np.concatenate(c) for c in zip(*parts))
        order = np.lexsort((y, key))  # the same sums however the rows came in
        block = {"key": key[order], "bins": x[order], "y": y[order], "sets": np.ones((len(y), fit.rows + 1), bool)}
        margin, trees = margin[order][:, None], []
        for turn in range(fit.rounds):
            g = Growth(fit, turn, x.shape[1])
            while g.wanted:
                g.receive(_histograms({0: g}, [fit], turn, bins)((block, margin))[0])
            trees.append(g.finished(float(fit.params["learning_rate"])))
            margin[:, 0] += trees[-1]["value"][_walk(trees[-1], block["bins"])]
        return k, trees

    return state.flatMap(training_rows).groupByKey(len(fits), partitionFunc=int).map(grow)


def probabilities(state: RDD) -> RDD:
    """Blocks with the probability of every fit as p."""
    return state.map(lambda s: {**s[0], "p": _sigmoid(s[1])})


def fit_sets(df: DataFrame, sets: list, fits: list[Fit], bins: int = BINS, rungs=(), after=None):
    """boost over the rows of df; sets are the conditions of the training sets."""
    blocks = to_blocks(df, sets, len(fits))
    models, state = boost(blocks, fits, quantile_edges(df, bins), bins, rungs, after)
    blocks.unpersist()
    return models, state
