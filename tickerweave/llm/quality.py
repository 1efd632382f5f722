"""Quality classifier learned from trusted positives and unlabelled text, with a non-negative unbiased risk."""

from __future__ import annotations

import math
import zlib
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tickerweave.llm.labelled import bounded

#: Bytes whose share of a text is a feature each.
MARKS = b"!?|%#$*&,.;:\"'()<>{}[]/\\=_-@\n"
_UPPER, _DIGIT = bytes(range(65, 91)), bytes(range(48, 58))
_ASCII = bytes(range(128))
#: Words are hashed to this many places.
CONTENT = 128


def features(text: str | None) -> list[float]:
    """Shares and lengths that say how a text is written, and the shares of its words by hashed place."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    size = len(raw) + 1
    words = raw.split()
    n = len(words) + 1
    lines = raw.split(b"\n")
    follow = set(zip(words, words[1:]))
    ends = sum(1 for w in words if w[-1] in b"!|%#$*&")
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    out = [
        math.log(size), math.log(n), math.log(len(lines)),
        len(set(words)) / n, len(follow) / n, sum(map(eq, words, words[1:])) / n, ends / n,
        float(lengths.mean()), float(lengths.std()), math.log(float(lengths.max()) + 1),
        len(set(lines)) / len(lines), sum(1 for x in lines if len(x) < 20) / len(lines),
        (len(raw) - len(raw.translate(None, _UPPER))) / size,
        (len(raw) - len(raw.translate(None, _DIGIT))) / size,
        len(raw.translate(None, _ASCII)) / size,
        math.log(len(words) / (len(set(words)) + 1) + 1),
    ]
    out += [math.sqrt(raw.count(m) / size) for m in MARKS]
    places = np.fromiter(map(zlib.crc32, raw.lower().split()), np.int64, len(words)) % CONTENT
    return out + np.sqrt(np.bincount(places, minlength=CONTENT) / n).tolist()


WIDTH = len(features(""))


class Net:
    """One hidden layer over standardised features; the output is the log odds of a good text."""

    def __init__(self, mean, spread, hidden: int = 24, seed: int = 11):
        draw = np.random.default_rng(seed)
        self.mean, self.spread = mean, spread
        self.p = [draw.standard_normal((len(mean), hidden)) / math.sqrt(len(mean)), np.zeros(hidden),
                  draw.standard_normal(hidden) / math.sqrt(hidden), np.zeros(1)]

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.spread, -6, 6)

    def forward(self, x):
        h = np.tanh(x @ self.p[0] + self.p[1])
        return h, h @ self.p[2] + self.p[3][0]

    def back(self, x, h, g):
        d = np.outer(g, self.p[2]) * (1 - h * h)
        return [x.T @ d, d.sum(0), h.T @ g, np.array([g.sum()])]

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.forward(self.scaled(x))[1])


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def risk_step(net: Net, xp: np.ndarray, xu: np.ndarray, prior: float) -> tuple[float, float, list[np.ndarray]]:
    """Risk of positives, unbiased risk of negatives, and the gradient to step down by, for scaled rows."""
    (hp, zp), (hu, zu) = net.forward(xp), net.forward(xu)
    right = prior * np.logaddexp(0, -zp).mean()
    negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    up, uu = -prior * _sigmoid(zp) / len(zp), _sigmoid(zu) / len(zu)
    if negative >= 0:
        gp, gu = -prior * _sigmoid(-zp) / len(zp) + up, uu
    else:
        gp, gu = -up, -uu
    return right, negative, [a + b for a, b in zip(net.back(xp, hp, gp), net.back(xu, hu, gu), strict=True)]


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1, gamma: float = 0.01) -> float:
    """Share of positives among unlabelled rows from the scores of held-out rows of both, higher for likelier positives.

    Above any cut, the share of unlabelled rows over that of positives is at least the prior, and equal to it where
    no negatives are left. The cut taken has the smallest upper confidence bound of that ratio, so that cuts with few rows
    don't win by chance. Without rows on either side the answer is a half.
    """
    if not len(positive) or not len(unlabelled):
        return 0.5
    p, u = np.sort(positive), np.sort(unlabelled)
    cuts = np.unique(p)
    above_p = 1 - np.searchsorted(p, cuts, "left") / len(p)
    above_u = 1 - np.searchsorted(u, cuts, "left") / len(u)
    slack = math.sqrt(math.log(4 / delta) / (2 * len(p))) + math.sqrt(math.log(4 / delta) / (2 * len(u)))
    k = int(np.argmin((above_u + (1 + gamma) * slack) / above_p))
    return float(np.clip(above_u[k] / above_p[k], 0.01, 0.99))


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray, rounds: int = 3, steps: int = 1500) -> float:
    """The class prior from positives and unlabelled rows alone. Half of both teach a network, the other half give
    the score distributions; each round teaches with the estimate of the round before, which parts the classes better."""
    teach = [np.arange(len(x)) % 2 == 0 for x in (positive, unlabelled)]
    prior = 0.5
    for _ in range(rounds):
        net = fit(positive[teach[0]], unlabelled[teach[1]], prior, steps=steps)
        prior = class_prior(net.score(positive[~teach[0]]), net.score(unlabelled[~teach[1]]))
    return prior


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 4000, batch: int = 512, rate: float = 3e-3,
        decay: float = 1e-4, seed: int = 5) -> Net:
    """Minimises prior * E_p[loss(+)] + max(0, E_u[loss(-)] - prior * E_p[loss(-)]) with the logistic loss.

    Where a batch's estimate of the negative risk falls below 0, the step goes up that risk instead.
    Without positives or unlabelled rows the answer is the prior everywhere.
    """
    rows = unlabelled if len(unlabelled) else np.zeros((1, unlabelled.shape[1]))
    net = Net(rows.mean(0), rows.std(0) + 1e-3)
    if not len(positive) or not len(unlabelled):
        net.p[2][:] = 0
        net.p[3][0] = math.log(prior / (1 - prior))
        return net
    p, u = net.scaled(positive), net.scaled(unlabelled)
    draw = np.random.default_rng(seed)
    first, second = [np.zeros_like(a) for a in net.p], [np.zeros_like(a) for a in net.p]
    for t in range(1, steps + 1):
        xp, xu = p[draw.integers(0, len(p), batch)], u[draw.integers(0, len(u), 2 * batch)]
        grads = risk_step(net, xp, xu, prior)[2]
        for k, g in enumerate(grads):
            g = g + decay * net.p[k] if k in (0, 2) else g
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            step = rate * (1 - 0.9 * t / steps) * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
            net.p[k] = net.p[k] - step
    return net


def _feature_rows(texts: DataFrame) -> np.ndarray:
    """Features of a bounded set of texts, computed by the tasks."""

    def make(batches):
        for batch in batches:
            rows = [features(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64()))], names=["x"])

    rows = texts.mapInArrow(make, "x array<double>").collect()
    return np.array([r[0] for r in rows], float).reshape(-1, WIDTH)


def learn(docs: DataFrame, labels: DataFrame, may_learn: Column, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", most_positive: int = 20_000, most_unlabelled: int = 30_000) -> Net:
    """The network from rows that may be learned from: at most about most_positive texts labelled 1 and
    most_unlabelled texts of any kind, drawn evenly by a hash of the id. The class prior is estimated from these two sets;
    labels of 0 are never read. The drawn ids, bounded so, are broadcast."""
    mine = labels.filter(may_learn & (F.col(label_col) == 1))
    texts = docs.select(F.col(id_col), F.col(text_col)).filter(may_learn)
    trusted = bounded(mine.select(id_col), id_col, most_positive)
    positive = _feature_rows(texts.join(F.broadcast(trusted.distinct()), id_col).select(text_col))
    unlabelled = _feature_rows(bounded(texts, id_col, most_unlabelled).select(text_col))
    prior = estimated_prior(positive, unlabelled)
    return fit(positive, unlabelled, prior)


def score_quality(docs: DataFrame, net: Net, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """Rows of docs with score (double, 0 to 1) and predicted (1 if score >= threshold).

    Every whole text is scored where it lies; no row moves. NULL counts as the empty text, which has a score
    like any other. Repeated rows score alike, an empty table stays empty; columns of docs named score or
    predicted are replaced, all others pass through.
    """
    sent = docs.sparkSession.sparkContext.broadcast((net.mean, net.spread, net.p))
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    base = docs.select(*kept)
    at = kept.index(text_col)

    def score(batches):
        mean, spread, p = sent.value
        mine = Net(mean, spread)
        mine.p = p
        for batch in batches:
            x = np.array([features(t) for t in batch.column(at).to_pylist()], float).reshape(-1, WIDTH)
            s = mine.score(x)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                                             names=[*kept, "score", "predicted"])

    return base.mapInArrow(score, StructType(base.schema.fields + StructType.fromDDL("score double, predicted int").fields))
