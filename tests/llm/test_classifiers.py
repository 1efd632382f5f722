"""Classifiers against plain loops: the risk, the class prior, pair sums, and a label that only pairs explain."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickerweave.llm import quality, toxicity


def test_risk_and_its_step_by_loops():
    draw = np.random.default_rng(1)
    net = quality.Net(np.zeros(4), np.ones(4), hidden=3)
    xp, xu = draw.standard_normal((5, 4)), draw.standard_normal((9, 4)) - 1
    loss = lambda z: math.log1p(math.exp(-z))

    def plain(x):
        hidden = [math.tanh(sum(x[i] * net.p[0][i, j] for i in range(4)) + net.p[1][j]) for j in range(3)]
        return sum(h * w for h, w in zip(hidden, net.p[2], strict=True)) + net.p[3][0]

    def risks(prior):
        right = sum(loss(plain(x)) for x in xp) / len(xp) * prior
        wrong = sum(loss(-plain(x)) for x in xu) / len(xu) - prior * sum(loss(-plain(x)) for x in xp) / len(xp)
        return right, wrong

    signs = set()
    for prior, apart in ((0.3, 0.0), (0.9, 1.0)):
        # Far apart, the unbiased estimate of the negative risk turns negative.
        net.p[2] *= 1 + 7 * apart
        xp, xu = xp + apart * net.p[0] @ net.p[2], xu - apart * net.p[0] @ net.p[2]
        right, wrong, grads = quality.risk_step(net, xp, xu, prior)
        assert risks(prior) == pytest.approx((right, wrong), abs=1e-9)
        signs.add(wrong >= 0)
        aim = (lambda: sum(risks(prior))) if wrong >= 0 else (lambda: -risks(prior)[1])
        for k, grad in enumerate(grads):
            for at in np.ndindex(grad.shape):
                keep = net.p[k][at]
                net.p[k][at] = keep + 1e-5
                high = aim()
                net.p[k][at] = keep - 1e-5
                slope = (high - aim()) / 2e-5
                net.p[k][at] = keep
                assert slope == pytest.approx(grad[at], abs=1e-6)
    assert signs == {True, False}


@pytest.mark.parametrize("share", [0.2, 0.5, 0.85])
def test_prior_from_positives_and_unlabelled(share):
    draw = np.random.default_rng(2)
    rows = lambda n, at: draw.standard_normal((n, 4)) + at
    good = int(6000 * share)
    unlabelled = draw.permutation(np.concatenate([rows(good, 1.5), rows(6000 - good, -1.5)]))
    assert abs(quality.estimated_prior(rows(4000, 1.5), unlabelled) - share) < 0.05
    assert quality.class_prior(np.empty(0), np.ones(3)) == 0.5 == quality.class_prior(np.ones(3), np.empty(0))


def test_content_terms_are_features():
    a, b = quality.features("alpha beta gamma delta"), quality.features("gamma delta alpha omega")
    assert len(a) == quality.WIDTH == len(quality.features(None)) and a != b
    assert a == quality.features("delta gamma beta alpha") and sum(x * x for x in a[-quality.CONTENT :]) == pytest.approx(4 / 5)


def test_learning_with_labels_of_one_class(spark):
    rows = [(k, f"word{k % 7} word{k % 3} text") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for value in (0, 1):
        labels = spark.createDataFrame([(k, value, value) for k, _ in rows], "doc_id long, quality int, toxic int")
        net = quality.learn(docs, labels, F.col("doc_id") >= 0)
        scores = [r.score for r in quality.score_quality(docs, net).collect()]
        assert len(scores) == 60 and all(0 <= s <= 1 for s in scores)
        machine = toxicity.learn(docs, labels, F.col("doc_id") >= 0)
        assert {r.predicted for r in toxicity.score_toxicity(docs, machine).collect()} == {value}


def test_machine_sums_over_all_pairs():
    draw = np.random.default_rng(3)
    machine = toxicity.Machine(np.arange(12), rank=3)
    machine.w0, machine.w, machine.v = 0.4, draw.standard_normal(12), draw.standard_normal((12, 3))
    rows = [np.array([0, 3, 7, 11]), np.array([], int), np.array([5]), np.array([1, 2])]
    want = [0.4 + sum(machine.w[i] for i in r)
            + sum(float(machine.v[a] @ machine.v[b]) for k, a in enumerate(r) for b in r[k + 1 :]) for r in rows]
    sizes = np.array([len(r) for r in rows])
    got = machine.odds(np.concatenate(rows).astype(int), np.cumsum(sizes) - sizes)[0]
    assert got == pytest.approx(want)


def exclusive(n, seed):
    """Texts of filler words in which two words stand each half the time; the label is 1 where exactly one does."""
    draw = np.random.default_rng(seed)
    texts, y = [], []
    for _ in range(n):
        words = [f"w{k}" for k in draw.choice(80, 10, replace=False)]
        a, b = draw.integers(0, 2, 2)
        texts.append(" ".join(words + ["aaa"] * a + ["bbb"] * b))
        y.append(float(a ^ b))
    return texts, np.array(y)


def test_label_that_only_a_pair_explains():
    texts, y = exclusive(3000, 4)
    rows = [toxicity.text_places(t) for t in texts]
    chosen = toxicity.choose(rows, y, np.ones(len(y)), 4096)
    assert {toxicity.word_place(b"aaa"), toxicity.word_place(b"bbb")} <= set(chosen.tolist())
    machine = toxicity.fit(rows, y, np.ones(len(y)))
    fresh, want = exclusive(500, 5)
    terms = [toxicity.as_terms(toxicity.text_places(t), machine.chosen) for t in fresh]
    sizes = np.array([len(t) for t in terms])
    odds = machine.odds(np.concatenate(terms), np.cumsum(sizes) - sizes)[0]
    assert ((odds > math.log(0.7 / 0.3)) == (want == 1)).mean() > 0.95


def test_pair_deviates_by_loops():
    draw = np.random.default_rng(6)
    n, places = 400, np.arange(6)
    rows = [np.flatnonzero(draw.random(6) < 0.4) for _ in range(n)]
    y = np.array([float((0 in r) and (1 in r)) if draw.random() < 0.9 else 1.0 for r in rows])
    x = np.array([[float(k in r) for k in places] for r in rows])
    z, e = x - x.mean(0), y - y.mean()
    slope = (z * e[:, None]).sum(0) / (z * z).sum(0)
    want = np.zeros(6, bool)
    for i in range(6):
        for j in range(6):
            if i != j:
                both = sum(z[r, i] * z[r, j] * (e[r] - slope[i] * z[r, i] - slope[j] * z[r, j]) for r in range(n))
                want[i] |= both**2 / sum((e[r] * z[r, i] * z[r, j]) ** 2 for r in range(n)) > 36
    assert toxicity.moves_together(rows, y, np.ones(n), places, chunk=64).tolist() == want.tolist() and want[0] and want[1]
