"""Training, calibration, scoring and explanation on a planted signal."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickerweave.operators import boosting, explain, forest, linear, selection, technical, training
from tickerweave.operators import evaluation as ev
from tickerweave.operators.blocks import add_up, to_blocks
from tickerweave.plans import learning

FEATS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def split(spark):
    rng = np.random.default_rng(0)
    rows = []
    for t in ("A", "B"):
        x = rng.normal(size=(200, 3))
        y = (x[:, 0] + 0.3 * rng.normal(size=200) > 0).astype(float)
        rows += [(t, dt.date(2024, 1, 1) + dt.timedelta(k), *map(float, x[k]), float(y[k])) for k in range(200)]
    df = spark.createDataFrame(rows, "ticker string, date date, a double, b double, c double, label double")
    return training.assemble(ev.walk_forward(df), FEATS).cache()


def test_walk_forward_finds_the_signal(split):
    for name, p in (("logistic_regression", {"max_iter": 30}), ("random_forest", {"n_estimators": 5, "max_depth": 3})):
        m = ev.metrics(training.walk_forward_scores(split, name, p, folds=2), ["fold"]).collect()
        assert len(m) == 2 and all(r.roc_auc > 0.85 for r in m)


def test_calibrated_scores_are_probabilities(split):
    model = training.Calibrated.fit(split, "xgboost", {"n_estimators": 3, "max_depth": 2})
    s = model.score(split).agg(F.min("p"), F.max("p"), F.avg("p"), F.avg("label")).first()
    assert 0 < s[0] < s[1] < 1 and abs(s[2] - s[3]) < 0.05


def test_batch_scoring_isolates_failures(split):
    model = training.fit(split, "logistic_regression", {"max_iter": 10})
    latest = split.filter("rn = 199").select("ticker", "date", "a", "b", F.when(F.col("ticker") == "A", F.col("c")).alias("c"))
    ok, bad = training.batch_score(model, latest, FEATS)
    assert [r.ticker for r in ok.collect()] == ["A"] and [r.reason for r in bad.collect()] == ["incomplete features"]
    ok, bad = training.batch_score(model, latest.drop("b"), FEATS)
    assert ok.count() == 0 and bad.count() == 2


def test_shapley_adds_up_and_ranks_the_signal_first(split):
    model = training.fit(split, "random_forest", {"n_estimators": 5, "max_depth": 3})
    means = split.agg(*[F.avg(c).alias(c) for c in FEATS])
    rows = split.filter("rn > 190").select("ticker", "date", *FEATS)
    a = explain.shapley_attribution(model, rows, FEATS, means, 3)
    total = a.groupBy("ticker", "date").agg((F.sum("attribution") + F.first("base_value")).alias("s"))
    p = training.score(model, training.assemble(rows, FEATS)).select("ticker", "date", "p")
    assert total.join(p, ["ticker", "date"]).agg(F.max(F.abs(F.col("s") - F.col("p")))).first()[0] < 1e-9
    assert explain.global_importance(a).orderBy(F.col("importance").desc()).first().feature == "a"
    s = explain.local_surrogate(model, rows, FEATS, split.agg(*[F.stddev(c).alias(c) for c in FEATS]), 60)
    assert s.filter("rank = 1").groupBy("feature").count().orderBy(F.col("count").desc()).first().feature == "a"


def test_stability_selection_keeps_the_signal(split):
    df = split.drop("features").withColumn("copy", F.col("a") * 2 + 0.001 * F.col("b"))
    stable, audit = selection.stability_select(df, [*FEATS, "copy"], folds=3, min_folds=2)
    assert stable[0] in ("a", "copy") and not {"a", "copy"} <= set(stable)
    assert selection.selection_audit(audit, 2).filter("kept").count() == len(stable)


def test_model_files(spark, split, tmp_path):
    from pyspark.ml import PipelineModel

    model = training.fit(split, "random_forest", {"n_estimators": 2, "max_depth": 2})
    path = training.save_version(model, str(tmp_path), "A", "random_forest", "1d", "v1", spark.createDataFrame([(0.6,)], "mean_roc_auc double"))
    again = PipelineModel.load(f"{path}/model")
    a, b = (training.score(m, split).agg(F.sum("p")).first()[0] for m in (model, again))
    assert abs(a - b) < 1e-9
    assert training.importance(model, FEATS).count() == 3


def test_forests_of_few_rows_grow_in_tasks(spark, split, monkeypatch):
    params = {"n_estimators": 6, "max_depth": 7}
    model = training.fit(split, "random_forest", params)
    again = training.fit(split.repartition(9), "random_forest", params)
    assert isinstance(model, forest.Forest) and len(model.trees) == 6
    for a, b in zip(model.trees, again.trees):  # wherever the rows lie
        assert all(np.array_equal(a[k], b[k]) for k in a)
    for t in model.trees:
        leaf = t["feature"] < 0
        assert t["cover"].min() >= 5 and t["cover"][leaf].sum() == t["cover"][0]
        inner = np.flatnonzero(~leaf)
        assert (t["cover"][t["left"][inner]] + t["cover"][t["left"][inner] + 1] == t["cover"][inner]).all()
        assert (t["cover"] * t["value"])[leaf].sum() == pytest.approx(t["cover"][0] * t["value"][0])
    p, q = (training.score(m, split).orderBy("ticker", "date").select("p").toPandas()["p"].to_numpy() for m in (model, model.to_mllib()))
    assert np.abs(p - q).max() < 1e-12
    monkeypatch.setattr(forest, "IN_TASK", 100)
    assert not isinstance(training.fit(split, "random_forest", params), forest.Forest)


def test_a_tree_takes_the_best_gini_split():
    class Once:
        def poisson(self, rate, n):
            return np.ones(n, int)

        def random(self, size):
            return np.zeros(size)

    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(60, 3)).round(2), (rng.random(60) < 0.5).astype(float)
    edges = [forest.cuts(x[:, f], 100) for f in range(3)]
    bins = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    tree = forest.grow_tree(bins, y, edges, Once(), 1, 5, 3)
    gini = lambda v: 2 * len(v) * v.mean() * (1 - v.mean())
    best = min((gini(y[x[:, f] <= c]) + gini(y[x[:, f] > c]), f, c) for f in range(3) for c in edges[f] if 5 <= (x[:, f] <= c).sum() <= 55)
    assert (tree["feature"][0], tree["threshold"][0]) == best[1:] and list(tree["left"]) == [1, -1, -1]
    assert len(forest.cuts(np.repeat([1.0, 2.0, 5.0], 40))) == 2 and len(forest.cuts(x[:, 0])) == 31


def _subset_value(tree, x, known, node=0):
    """Mean value of the leaves that a row reaches when only the known features are looked at."""
    f = tree["feature"][node]
    if f < 0:
        return tree["value"][node]
    left, right = int(tree["left"][node]), int(tree["right"][node])
    if f in known:
        return _subset_value(tree, x, known, left if x[f] <= tree["threshold"][node] else right)
    c = tree["cover"]
    return (c[left] * _subset_value(tree, x, known, left) + c[right] * _subset_value(tree, x, known, right)) / c[node]


def test_tree_attributions_equal_all_subsets(spark):
    import itertools
    import math

    rng = np.random.default_rng(3)
    names = list("abcdefgh")
    x = rng.normal(size=(250, 8))
    y = ((x[:, 0] * x[:, 1] + x[:, 2] > 0) ^ (rng.random(250) < 0.1)).astype(float)
    rows = [("A", dt.date(2024, 1, 1) + dt.timedelta(k), *map(float, x[k]), float(y[k])) for k in range(250)]
    df = training.assemble(spark.createDataFrame(rows, ["ticker", "date", *names, "label"]), names).cache()
    some = df.filter("date >= '2024-09-03'").select("ticker", "date", *names)
    forest = training.fit(df, "random_forest", {"n_estimators": 12, "max_depth": 6})
    boosted = training.fit(df, "lightgbm", {"n_estimators": 11, "num_leaves": 9})
    for model in (forest, boosted):
        trees, start = explain.ensemble(model)
        got = {}
        for r in explain.tree_attribution(model, some, names, 5).collect():
            got.setdefault(r.date, {})[r.feature] = (r.attribution, r.base_value)
        scores = {r.date: r.p for r in training.score(model, training.assemble(some, names)).collect()}
        assert len(got) == some.count() > 3
        for date, a in got.items():
            row = x[(date - dt.date(2024, 1, 1)).days]
            total = sum(v for v, _ in a.values()) + a["a"][1]
            total = total if model is forest else 1 / (1 + np.exp(-total))
            assert total == pytest.approx(scores[date], abs=1e-9)
        worth = {k: start + sum(_subset_value(t, row, k) for t in trees) for n in range(9) for k in map(frozenset, itertools.combinations(range(8), n))}
        for i, name in enumerate(names):
            want = sum(math.factorial(len(k)) * math.factorial(7 - len(k)) / math.factorial(8) * (worth[k | {i}] - worth[k]) for k in worth if i not in k)
            assert a[name][0] == pytest.approx(want, abs=1e-9)


# --- boosted trees ----------------------------------------------------------------------------


def _plain_boost(x, y, rows, edges, flavour, params, seed, bins, keys, sets=0):
    """One fit by loops over nodes, features and cuts; returns margins of all rows and the trees' numbers of leaves."""
    fl = boosting.FLAVOURS[flavour]
    b = np.stack([[sum(e < v for e in edges[f]) for v in x[:, f]] for f in range(x.shape[1])], axis=1)
    share = y[rows].mean()
    m, leaves = np.full(len(y), np.log(share / (1 - share))), []
    value = lambda g, h: g * g / max(h + fl.l2, 1e-12)
    for turn in range(params["n_estimators"]):
        rng = np.random.default_rng((seed, sets, turn))
        cols = sorted(rng.choice(x.shape[1], max(1, round(params["colsample_bytree"] * x.shape[1])), replace=False))
        use = rows.copy()
        if fl.sampled and params["subsample"] < 1:
            use &= boosting.chosen(keys, seed * 1_000_003 + turn, params["subsample"])
        p = 1 / (1 + np.exp(-m))
        g, h = p - y, p * (1 - p)

        def best(at):
            top = (0.0, None)
            for f in cols:
                for c in range(bins - 1):
                    l = at & (b[:, f] <= c)
                    r = at & ~l
                    lu, ru = l & use, r & use
                    if min(lu.sum(), ru.sum()) < max(fl.least_rows, 1) or min(h[lu].sum(), h[ru].sum()) < fl.least_curvature:
                        continue
                    u = lu | ru
                    gain = value(g[lu].sum(), h[lu].sum()) + value(g[ru].sum(), h[ru].sum()) - value(g[u].sum(), h[u].sum())
                    if gain > top[0] + 1e-9:
                        top = (gain, (l, r))
            return top

        nodes = [(np.ones(len(y), bool), 0)]
        while True:
            options = [(best(at), k) for k, (at, d) in enumerate(nodes) if fl.leafwise or d < params["max_depth"]]
            options = [(o, k) for o, k in options if o[0] > 1e-12]
            if not options or (fl.leafwise and len(nodes) >= params["num_leaves"]):
                break
            (_, (l, r)), k = max(options, key=lambda t: t[0][0]) if fl.leafwise else options[0]
            d = nodes[k][1]
            nodes[k:k + 1] = [(l, d + 1), (r, d + 1)]
        leaves.append(len(nodes))
        for at, _ in nodes:
            u = at & use
            m[at] -= params["learning_rate"] * g[u].sum() / max(h[u].sum() + fl.l2, 1e-12)
    return m, leaves


@pytest.fixture(scope="module")
def noisy(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 4))
    y = ((x[:, 0] * x[:, 1] > 0) ^ (rng.random(300) < 0.15)).astype(float)
    rows = [("A", dt.date(2024, 1, 1) + dt.timedelta(k), *map(float, x[k]), float(y[k])) for k in range(300)]
    df = spark.createDataFrame(rows, "ticker string, date date, a double, b double, c double, d double, label double")
    return training.assemble(ev.walk_forward(df), ["a", "b", "c", "d"]).cache()


@pytest.mark.parametrize("in_task", [0, boosting.IN_TASK])
@pytest.mark.parametrize("flavour,params", [
    ("xgboost", {"n_estimators": 3, "max_depth": 3, "learning_rate": 0.3, "subsample": 0.8, "colsample_bytree": 0.75}),
    ("lightgbm", {"n_estimators": 3, "num_leaves": 7, "learning_rate": 0.3, "subsample": 0.8, "colsample_bytree": 1.0}),
])
def test_boosting_equals_loops_over_nodes_and_cuts(noisy, monkeypatch, flavour, params, in_task):
    from tickerweave.operators import blocks

    monkeypatch.setattr(boosting, "IN_TASK", in_task)
    monkeypatch.setattr(boosting, "CUT", 2)
    monkeypatch.setattr(blocks, "LEAST_WORK", 200)
    sets = [ev.is_train(f) for f in range(2)]
    fits = [boosting.Fit(f, flavour, params) for f in range(2)]
    data = to_blocks(noisy, sets, 2)
    edges = boosting.quantile_edges(noisy, 8)
    models, state = boosting.boost(data, fits, edges, 8)
    parts = state.collect()
    assert len(parts) > 1
    cat = lambda k: np.concatenate([p[0][k] for p in parts])
    margin = np.concatenate([p[1] for p in parts])
    raw = {int(b["key"][i]): b["x"][i] for b in data.collect() for i in range(len(b["y"]))}
    x = np.array([raw[int(k)] for k in cat("key")])
    for f in range(2):
        want, leaves = _plain_boost(x, cat("y"), cat("sets")[:, f], edges, flavour, params, 42, 8, cat("key"), f)
        assert margin[:, f] == pytest.approx(want, abs=1e-9)
        assert [int((t["feature"] < 0).sum()) for t in models[f].trees] == leaves
        assert models[f].margin(x) == pytest.approx(want, abs=1e-9)


def test_boosting_finds_an_interaction_and_bounds_its_leaves(noisy, tmp_path):
    p = {"n_estimators": 20, "learning_rate": 0.2, "num_leaves": 6, "max_depth": 3}
    for name in ("xgboost", "lightgbm"):
        m = ev.metrics(training.walk_forward_scores(noisy, name, p, folds=3), ["fold"]).collect()
        assert len(m) == 3 and np.mean([r.roc_auc for r in m]) > 0.7
        model = training.fit(noisy, name, p)
        assert max(int((t["feature"] < 0).sum()) for t in model.trees) <= (6 if name == "lightgbm" else 8)
        top = training.importance(model, ["a", "b", "c", "d"]).orderBy(F.desc("importance")).limit(2).collect()
        assert {r.feature for r in top} == {"a", "b"}
        model.save(str(tmp_path / name))
        again = boosting.Boosted.load(str(tmp_path / name))
        x = np.random.default_rng(1).normal(size=(50, 4))
        assert (again.margin(x) == model.margin(x)).all()


def test_search_over_the_models_equals_single_fits(noisy):
    best, done = training.search(noisy, "logistic_regression", trials=6, folds=2)
    assert len(done) == 6 and best in [d[0] for d in done]
    for params, found in done[:3]:
        alone = ev.metrics(training.walk_forward_scores(noisy, "logistic_regression", params, 2), ["fold"]).agg(F.avg("roc_auc")).first()[0]
        assert found == pytest.approx(alone, abs=1e-9)
    small = {"n_estimators": 4, "max_depth": 2, "num_leaves": 4}
    for name in ("xgboost", "lightgbm"):
        best, done = training.search(noisy, name, trials=4, folds=2, fixed=small, rungs=(2,))
        assert len(done) == 4
        alone = ev.metrics(training.walk_forward_scores(noisy, name, best, 2), ["fold"]).agg(F.avg("roc_auc")).first()[0]
        assert [a for p, a in done if p == best] == [pytest.approx(alone, abs=1e-9)]


def test_linear_fits_stand_at_their_optimum(split):
    sets = [F.lit(True), ev.is_train(1), F.col("label") == 1]
    data = to_blocks(split, sets, 4)
    models = linear.fit_many(data, [(0, 1.0), (0, 0.01), (1, 5.0), (2, 1.0)], 3)
    rows = data.collect()
    x, y, s = (np.concatenate([b[k] for b in rows]) for k in ("x", "y", "sets"))
    for m, (k, c) in zip(models, [(0, 1.0), (0, 0.01), (1, 5.0)]):
        u = s[:, k]
        z = (x[u] - x[u].mean(0)) / x[u].std(0)
        w = c * np.where(y[u] == 1, u.sum() / (2 * y[u].sum()), u.sum() / (2 * (1 - y[u]).sum()))
        r = w * (1 / (1 + np.exp(-(z @ m.coefficients + m.intercept))) - y[u])
        assert np.abs(z.T @ r + m.coefficients).max() < 1e-6 and abs(r.sum()) < 1e-6
    assert models[3].probability(x[:3]) == pytest.approx([1 - 1e-6] * 3)


def test_links_equal_a_plain_newton_fit(spark):
    rng = np.random.default_rng(4)
    rows = [(m, float(f), float(rng.random() < 1 / (1 + np.exp(-(3 * f - 1 - m))))) for m in range(3) for f in rng.random(80)]
    rows += [(7, 0.2, 0.0), (7, 0.9, 1.0)]  # separable: only the smoothed targets keep the link finite
    got = training.platt(spark.createDataFrame(rows, "member int, f double, y double"))
    for m in (0, 1, 2, 7):
        f, y = np.array([r[1] for r in rows if r[0] == m]), np.array([r[2] for r in rows if r[0] == m])
        t = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
        a = np.stack([f, np.ones_like(f)], axis=1)
        theta = np.zeros(2)
        for _ in range(200):
            p = 1 / (1 + np.exp(-a @ theta))
            theta -= np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]), a.T @ (p - t))
        assert got[m] == pytest.approx(tuple(theta), abs=1e-8)


def test_registered_queries_run_the_whole_job(spark, monkeypatch):
    class Called(Exception):
        pass

    def stop(*args, **kwargs):
        raise Called(args[1:], kwargs)

    def call(query):
        with pytest.raises(Called) as e:
            learning.QUERIES[query](spark, "")
        return e.value.args

    assert list(learning.FEATURES) == technical.TECHNICAL_FEATURES and len(learning.FEATURES) == 83
    small = spark.createDataFrame([("A", dt.date(2024, 1, 1), 1.0, 0, 0, 1, 0, 0, *[0.0] * 83)],
                                  ["ticker", "date", "label", "rn", "min_train", "fold_size", "embargo", "test_fold", *learning.FEATURES])
    monkeypatch.setattr(learning, "_split", lambda spark, sf: small)
    monkeypatch.setattr(learning, "_matrix", lambda spark, sf: small)
    monkeypatch.setattr(training, "fit", stop)
    names = {
        "m08_random_forest_walk_forward": "random_forest", "m12_platt_scaling": "random_forest",
        "m15_batch_scoring": "logistic_regression", "m16_shapley_attribution": "random_forest", "m17_local_surrogate": "random_forest",
    }
    for query, name in names.items():
        args, kwargs = call(query)
        assert args[0] == name and not any(args[1:]) and not kwargs, query
    monkeypatch.setattr(training, "walk_forward_trials", stop)
    for query, name in {"m07_m11_logistic_walk_forward": "logistic_regression", "m09_boosted_walk_forward": "xgboost",
                        "m10_lightgbm_walk_forward": "lightgbm"}.items():
        assert call(query) == ((name, [{}], 5), {})
    monkeypatch.setattr(training, "search", stop)
    assert call("m13_parameter_search") == (("logistic_regression",), {})
    monkeypatch.setattr(selection, "basic_select", stop)
    assert call("m02_basic_selection") == ((learning.FEATURES,), {})
    monkeypatch.setattr(training, "fit", lambda *args: None)
    monkeypatch.setattr(explain, "shapley_attribution", stop)
    args, kwargs = call("m16_shapley_attribution")
    assert len(args) == 3 and not kwargs


def test_long_histories_are_numbered_without_sorting_a_ticker_in_one_task(spark):
    from tickerweave.functions.cumulative import row_numbers

    rng = np.random.default_rng(6)
    rows = [(t, int(d), k) for t, n in (("A", 3000), ("B", 7), (None, 400)) for k, d in enumerate(rng.permutation(n) * 3)]
    df = spark.createDataFrame(rows, "ticker string, date long, k int")
    names = ["rn", "n_rows", "min_train", "fold_size", "test_fold", "embargo"]
    got, want = ({(r.ticker, r.date, r.k): [r[c] for c in names] for r in ev.walk_forward(df, long=x).collect()} for x in (True, False))
    assert got == want and len(got) == len(rows)
    assert ev.walk_forward(df, long=True).columns == ev.walk_forward(df).columns
    tied = [("A", d) for d in [None, 5, 5, 1, None, 5, 9]] + [("B", None)] * 3
    out = row_numbers(spark.createDataFrame(tied, "ticker string, date int"), ["ticker"], "date", "rn", "n").collect()
    place = {t: [r.date for r in sorted(out, key=lambda r: r.rn) if r.ticker == t] for t in "AB"}
    assert place == {"A": [None, None, 1, 5, 5, 5, 9], "B": [None] * 3}
    assert sorted((r.ticker, r.rn, r.n) for r in out) == [("A", k, 7) for k in range(7)] + [("B", k, 3) for k in range(3)]
    # The window runs inside the pieces of a ticker.
    import re

    plan = ev.walk_forward(df, long=True)._jdf.queryExecution().optimizedPlan().toString()
    ranks = [line for line in plan.splitlines() if "row_number()" in line and "Window [" in line]
    assert len(ranks) == 1 and re.search(r"\[ticker#\d+, __b#\d+\]", ranks[0])


def test_fold_statistics_equal_numpy(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 3)) + [0.0, 50.0, -3.0]
    x[:, 2] += x[:, 0]
    y, f = (x[:, 0] > 0).astype(float), rng.integers(0, 3, 300)
    df = spark.createDataFrame([(int(k), *map(float, v), float(w)) for k, v, w in zip(f, x, y)], "f int, a double, b double, c double, label double")
    stats = selection.fold_statistics(df.repartition(5), FEATS, "label", F.col("f"), 3)
    for k, s in stats.items():
        m = np.corrcoef(np.column_stack([x, y])[f <= k].T)
        assert s.n == (f <= k).sum() and s.var == pytest.approx(x[f <= k].var(axis=0, ddof=1))
        assert s.corr == pytest.approx(np.abs(m[:3, :3])) and s.target == pytest.approx(np.abs(m[:3, 3]))
    assert sorted(stats) == [0, 1, 2]


def test_partitions_of_bars_do_not_grow_with_the_session(spark):
    df = spark.range(100).withColumn("ticker", F.col("id").cast("string"))
    was = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for asked, want in ((3, 3), (5000, 4 * spark.sparkContext.defaultParallelism)):
            spark.conf.set("spark.sql.shuffle.partitions", str(asked))
            parted = technical.by_ticker(df)
            assert parted.rdd.getNumPartitions() == want and parted.count() == 100
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


@pytest.mark.parametrize("few", [0, 40, 1 << 19])
def test_ranks_are_exact_however_few_values_are_told_apart(spark, monkeypatch, few):
    from tickerweave.functions import ranks

    monkeypatch.setattr(ranks, "FEW", few)
    monkeypatch.setattr(ranks, "CELLS", 64)
    rng = np.random.default_rng(8)
    n = 3000
    odd = rng.choice([np.nan, -np.inf, np.inf, -0.0, 0.0, 1e300, -1e300, 5e-324, -5e-324], n)
    x = np.column_stack([rng.normal(size=n), rng.integers(0, 5, n), odd, np.full(n, 7.0)])
    c = rng.integers(-1, 4, n)
    rows = spark.createDataFrame([(0, int(k), *map(float, v)) for k, v in zip(c, x)], "g int, c int, x0 double, x1 double, x2 double, x3 double")
    asked = []

    def wanted(sizes):
        assert {s: v.tolist() for s, v in sizes.items()} == {s: np.bincount(c[c >= 0], minlength=4).tolist() for s in range(4)}
        asked.extend((s, k, r) for s in range(4) for k in (1, 3, 4) for r in (1, 2, int(sizes[s][:k].sum()) // 3, int(sizes[s][:k].sum())))
        return asked

    for (s, k, r), (key, below, upto) in zip(asked, ranks.at_ranks(rows.repartition(5), 4, wanted, 4)[1]):
        v = x[:, s] + 0.0
        want = np.sort(v[(c >= 0) & (c < k)])[r - 1]
        less = np.isnan(want) & ~np.isnan(v) | (v < want)
        same = np.isnan(v) if np.isnan(want) else v == want
        assert ranks.from_key(key) == pytest.approx(want, nan_ok=True, abs=0)
        assert below.tolist() == [(less & (c == q)).sum() for q in range(4)]
        assert upto.tolist() == [((less | same) & (c == q)).sum() for q in range(4)]


def test_information_equals_counts_in_deciles(spark, monkeypatch):
    from tickerweave.functions import ranks

    monkeypatch.setattr(ranks, "FEW", 50)
    rng = np.random.default_rng(9)
    n = 2000
    x = np.column_stack([rng.normal(size=n), rng.integers(0, 4, n), np.full(n, 1.0)])
    y, f = (x[:, 0] + rng.normal(size=n) > 0).astype(int), rng.integers(0, 4, n)
    rows = [(None if k == 3 else int(k), *map(float, v), None if i % 50 == 0 else float(w)) for i, (k, v, w) in enumerate(zip(f, x, y))]
    df = spark.createDataFrame(rows, "f int, a double, b double, c double, label double")
    got = {(r.fold, r.feature): r.mi for r in selection.mutual_information(df, FEATS, "label", F.col("f"), 3).collect()}
    assert len(got) == 9
    for (k, name), mi in got.items():
        held = (f <= k) & (np.arange(n) % 50 != 0)
        v, w = x[held, FEATS.index(name)], y[held]
        bins = np.minimum(9, 10 * np.searchsorted(np.sort(v), v, "left") // len(v))
        want = 0.0
        for b in np.unique(bins):
            for q in (0, 1):
                m = ((bins == b) & (w == q)).sum()
                want += m / len(v) * np.log(m * len(v) / ((bins == b).sum() * (w == q).sum())) if m else 0.0
        assert mi == pytest.approx(max(want, 0.0), abs=1e-12)


def _folds(rows, folds=5):
    return {f: sum(1 for r in rows if r.train_fold == f) for f in [None, *range(folds)]}


def test_folds_of_long_histories_move_no_rows(spark):
    """the rows of a long history went to disk several times."""
    rng = np.random.default_rng(10)
    rows = [(t, int(d), float(k)) for t, n in (("A", 3001), ("B", 7), ("C", 1), (None, 400)) for k, d in enumerate(rng.permutation(n) * 3)]
    df = spark.createDataFrame(rows, "ticker string, date long, k double")
    for kind in ("long", "double", "date", "decimal(12,3)"):
        day = F.date_add(F.lit("2020-01-01").cast("date"), F.col("date").cast("int")) if kind == "date" else F.col("date").cast(kind)
        d = df.withColumn("date", day)
        names = ["rn", "n_rows", "min_train", "fold_size", "test_fold", "train_fold"]
        got, want = ({(r.ticker, r.date): [r[c] for c in names] for r in ev.walk_forward(d, long=x).collect()} for x in (True, False))
        assert got == want and len(got) == len(rows)
    plan = ev.walk_forward(df, long=True).select("k", "train_fold", "test_fold")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "hashpartitioning" not in plan and "rangepartitioning" not in plan


def test_folds_of_equal_dates_are_of_the_right_size(spark):
    """Rows with equal dates on both sides of a fold's end: the counts hold, the row numbers agree, every job sees the same."""
    rng = np.random.default_rng(11)
    rows = [(t, None if k % 17 == 0 else int(k // w), float(rng.integers(0, 9))) for t, n, w in (("A", 1000, 70), ("B", 500, 500), ("C", 90, 1)) for k in range(n)]
    df = spark.createDataFrame([*rows, *rows], "ticker string, date int, k double").repartition(6)
    long, short = ev.walk_forward(df, long=True), ev.walk_forward(df)
    got, want = long.collect(), short.collect()
    for t in "ABC":
        a, b = ([r for r in x if r.ticker == t] for x in (got, want))
        assert _folds(a) == _folds(b) and sorted(r.rn for r in a) == list(range(len(a)))
        assert [r.date for r in sorted(a, key=lambda r: r.rn)] == [r.date for r in sorted(b, key=lambda r: r.rn)]
        by_number = {r.rn: (r.test_fold, r.train_fold) for r in b}
        assert all((r.test_fold, r.train_fold) == by_number[r.rn] for r in a)
    once, again = (sorted(long.repartition(k).groupBy("ticker", "date", "k", "train_fold").count().collect(), key=str) for k in (2, 7))
    assert once == again


def test_stability_selection_of_lines_keeps_no_rows(spark, tmp_path, monkeypatch):
    """the query wrote its rows to the checkpoint folder and sorted them by every feature."""
    rng = np.random.default_rng(12)
    n = 4000
    rows = [(int(k), int(rng.integers(1, 8)), float(rng.integers(1, 51)), float(rng.random() * 1e5), float(rng.integers(0, 11) / 100),
             float(rng.integers(0, 9) / 100), str(rng.choice(["A", "N", "R"])), str(rng.choice(["F", "O"]))) for k in range(n)]
    names = "l_orderkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string"
    spark.createDataFrame(rows, names).write.parquet(str(tmp_path / "lineitem.parquet"))

    def stop(*args):
        raise AssertionError("rows are kept")

    for module in (selection, learning):
        monkeypatch.setattr(module, "reuse", stop)
    got = {r.feature: r for r in learning.QUERIES["m06_stability_selection_lines"](spark, str(tmp_path)).collect()}
    assert set(got) == set(learning._LINES) and got["flat"].dropped_at == "low_variance"
    assert {c for c, r in got.items() if "correlated" in r.dropped_at} >= {"price"} or "correlated" in got["charge"].dropped_at
