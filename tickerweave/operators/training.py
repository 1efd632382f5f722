"""Direction models: builders, walk-forward evaluation, calibration, search, scoring, storage.

One model is fitted for all tickers together; folds are cut per ticker, so
every fold trains on the past of each ticker only. Forests grow a tree per task
(forest), or by MLlib where rows are many; boosted trees (boosting) and the
evaluation of linear models (linear) fit all folds, members and trials at once,
a few sums per pass.
"""

from __future__ import annotations

import random
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerweave.operators import boosting, forest, linear
from tickerweave.operators import evaluation as ev
from tickerweave.operators.blocks import out_of_fold, to_blocks
from tickerweave.session import reuse

SEED = 42
MODELS = ["xgboost", "lightgbm", "random_forest", "logistic_regression"]
# Default parameters of the four models.
DEFAULTS = {
    "xgboost": {"n_estimators": 300, "max_depth": 6, "learning_rate": 0.05, "subsample": 0.8, "colsample_bytree": 0.8},
    "lightgbm": {"n_estimators": 300, "num_leaves": 63, "learning_rate": 0.05, "subsample": 0.8, "colsample_bytree": 0.8},
    "random_forest": {"n_estimators": 200, "max_depth": None, "min_samples_split": 10},
    "logistic_regression": {"C": 1.0, "max_iter": 1000},
}
# Ranges of the parameter search (low, high, kind).
SEARCH_SPACE = {
    "xgboost": {
        "n_estimators": (100, 500, "int"), "max_depth": (3, 8, "int"), "learning_rate": (0.01, 0.3, "log"),
        "subsample": (0.6, 1.0, "float"), "colsample_bytree": (0.6, 1.0, "float"),
    },
    "lightgbm": {
        "n_estimators": (100, 500, "int"), "learning_rate": (0.01, 0.3, "log"), "num_leaves": (20, 127, "int"),
        "subsample": (0.6, 1.0, "float"), "colsample_bytree": (0.6, 1.0, "float"),
    },
    "random_forest": {"n_estimators": (50, 300, "int"), "max_depth": (3, 20, "int"), "min_samples_split": (5, 50, "int")},
    "logistic_regression": {"C": (0.01, 10.0, "log")},
}


def estimator(name: str, params: dict | None = None):
    """Unfitted learner on `features`, `label` and, for the linear one, `weight`."""
    p = {**DEFAULTS[name], **(params or {})}
    if name == "random_forest":
        return RandomForestClassifier(
            numTrees=int(p["n_estimators"]), maxDepth=min(int(p["max_depth"] or 30), 30),
            minInstancesPerNode=max(1, int(p["min_samples_split"]) // 2), featureSubsetStrategy="sqrt", seed=SEED,
        )
    if name == "logistic_regression":
        return LogisticRegression(
            featuresCol="scaled", weightCol="weight", maxIter=int(p["max_iter"]), standardization=False, elasticNetParam=0.0
        )
    raise ValueError(f"unknown model {name}")


def assemble(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features").transform(df)


def fit(train: DataFrame, name: str, params: dict | None = None) -> PipelineModel | boosting.Boosted | forest.Forest:
    """Fits on `features` and `label`. The linear model is standardised and weighted to balanced classes."""
    if name in boosting.FLAVOURS:
        return boosting.fit_sets(train, [F.lit(True)], _fits(name, params, 1))[0][0]
    learner = estimator(name, params)
    if name != "logistic_regression":
        grown = forest.fit(train, learner.getNumTrees(), learner.getMaxDepth(), learner.getMinInstancesPerNode(), SEED)
        # MLlib passes over the rows once per level and group of nodes, so they are spread over all cores first.
        return grown or Pipeline(stages=[learner]).fit(train.repartition("ticker", "date"))
    c = train.groupBy("label").count().collect()
    n, k = sum(r["count"] for r in c), len(c)
    weight = F.lit(1.0)
    for r in c:
        weight = F.when(F.col("label") == r["label"], n / (k * r["count"])).otherwise(weight)
    # Balanced weights sum to n, and the penalty of the averaged loss is 1 / (C * n).
    learner.setRegParam(1.0 / ({**DEFAULTS[name], **(params or {})}["C"] * n))
    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True)
    return Pipeline(stages=[scaler, learner]).fit(train.withColumn("weight", weight))


def _fits(name: str, params: dict | None, sets: int) -> list[boosting.Fit]:
    return [boosting.Fit(k, name, {**DEFAULTS[name], **(params or {})}, SEED) for k in range(sets)]


def score(model, df: DataFrame, out: str = "p") -> DataFrame:
    """Adds the probability of a rise."""
    if isinstance(model, (boosting.Boosted, forest.Forest)):
        return model.transform(df, out)
    if "weight" not in df.columns:
        df = df.withColumn("weight", F.lit(1.0))
    s = model.transform(df).withColumn(out, vector_to_array("probability")[1])
    return s.drop("rawPrediction", "probability", "prediction", "scaled", "weight")


def walk_forward_scores(split: DataFrame, name: str, params: dict | None = None, folds: int = 5) -> DataFrame:
    """(fold, y, p) of every test row; each fold is fitted on its own past. `split` has features, label and fold columns.

    Linear and boosted models fit all folds in the same passes; the forests of the folds are grown side by side.
    """
    if name != "random_forest":
        return walk_forward_trials(split, name, [params or {}], folds).drop("trial")

    def fold(f):
        model = fit(split.filter(ev.is_train(f)), name, params)
        return score(model, split.filter(ev.is_test(f))).select(F.lit(f).alias("fold"), F.col("label").alias("y"), "p")

    with ThreadPoolExecutor(folds) as pool:
        parts = list(pool.map(fold, range(folds)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def walk_forward_trials(split: DataFrame, name: str, trials: list[dict], folds: int = 5, rungs=(), after=None) -> DataFrame:
    """(trial, fold, y, p) of every test row for each set of parameters; all (trial, fold) fits share their passes."""
    sets = [ev.is_train(f) for f in range(folds)]
    if name == "logistic_regression":
        blocks = to_blocks(split, sets, folds)
        models = linear.fit_many(blocks, [(f, float({**DEFAULTS[name], **t}["C"])) for t in trials for f in range(folds)], folds)
        return out_of_fold(blocks, lambda b: np.stack([m.probability(b["x"]) for m in models], axis=1), folds)
    fits = [boosting.Fit(f, name, {**DEFAULTS[name], **t}, SEED) for t in trials for f in range(folds)]
    state = boosting.fit_sets(split, sets, fits, rungs=rungs, after=after)[1]
    return out_of_fold(boosting.probabilities(state), lambda b: b["p"], folds)


def train(split: DataFrame, name: str, params: dict | None = None, folds: int = 5, calibrate: bool = True):
    """(model on all rows, fold metrics). The linear model needs no calibration."""
    metrics = ev.metrics(walk_forward_scores(split, name, params, folds), ["fold"])
    final = Calibrated.fit(split, name, params) if calibrate and name != "logistic_regression" else fit(split, name, params)
    return final, metrics


def platt(held: DataFrame, steps: int = 100, tolerance: float = 1e-12) -> dict[int, tuple[float, float]]:
    """{member: (a, b)} of the links p = 1 / (1 + exp(-(a f + b))) from rows (member, f, y), all members at once.

    Targets are smoothed: (n1 + 1) / (n1 + 2) for ones and 1 / (n0 + 2) for zeros. Each Newton step is one aggregation of
    five sums per member; a step that raises a member's loss is halved.
    """
    held = held.select(F.col("member").cast("int").alias("m"), F.col("f").cast("double").alias("f"), F.col("y").cast("double").alias("y"))
    held = reuse(held)
    n = {r["m"]: (r["n0"], r["n1"]) for r in held.groupBy("m").agg(F.count_if(F.col("y") < 0.5).alias("n0"), F.count_if(F.col("y") >= 0.5).alias("n1")).collect()}
    theta = {m: np.array([0.0, np.log((n1 + 1) / (n0 + 1))]) for m, (n0, n1) in n.items()}
    best, step, going = {m: np.inf for m in n}, {m: np.zeros(2) for m in n}, set(n)
    for _ in range(steps):
        if not going:
            break
        pick = lambda value: F.element_at(F.create_map(*[x for m in sorted(n) for x in (F.lit(m), F.lit(float(value(m))))]), F.col("m"))
        z = pick(lambda m: theta[m][0]) * F.col("f") + pick(lambda m: theta[m][1])
        t = F.when(F.col("y") >= 0.5, pick(lambda m: (n[m][1] + 1) / (n[m][1] + 2))).otherwise(pick(lambda m: 1 / (n[m][0] + 2)))
        p = 1 / (1 + F.exp(-z))
        loss = F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))) - t * z
        f, h = F.col("f"), p * (1 - p)
        sums = held.filter(F.col("m").isin(sorted(going))).groupBy("m").agg(
            F.sum(loss).alias("l"), F.sum((p - t) * f).alias("g0"), F.sum(p - t).alias("g1"),
            F.sum(h * f * f).alias("h00"), F.sum(h * f).alias("h01"), F.sum(h).alias("h11"))
        for r in sums.collect():
            m = r["m"]
            if r["l"] > best[m] + 1e-12 * abs(best[m]):
                step[m] = step[m] / 2
                theta[m] = theta[m] - step[m]
                if np.abs(step[m]).max() <= tolerance:
                    going.discard(m)
                continue
            best[m] = r["l"]
            step[m] = -np.linalg.lstsq(np.array([[r["h00"], r["h01"]], [r["h01"], r["h11"]]]), np.array([r["g0"], r["g1"]]), rcond=None)[0]
            theta[m] = theta[m] + step[m]
            if np.abs(step[m]).max() <= tolerance * max(1.0, np.abs(theta[m]).max()):
                going.discard(m)
    held.unpersist()
    return {m: (float(t[0]), float(t[1])) for m, t in theta.items()}


class Calibrated:
    """Mean of three models, each with a logistic link fitted on the third of the rows it has not seen.

    Thirds are decided by a hash of (ticker, date), so a row always lands in the same one.
    """

    def __init__(self, members):
        self.members = members

    @staticmethod
    def fit(df: DataFrame, name: str, params: dict | None = None, k: int = 3) -> "Calibrated":
        third = F.pmod(F.xxhash64("ticker", "date"), F.lit(k))
        if name in boosting.FLAVOURS:
            models, state = boosting.fit_sets(df, [third != j for j in range(k)], _fits(name, params, k))

            def unseen(block):
                for j in range(k):
                    at = np.flatnonzero(~block["sets"][:, j])
                    yield from ((j, p, y) for p, y in zip(block["p"][at, j].tolist(), block["y"][at].tolist()))

            held = df.sparkSession.createDataFrame(boosting.probabilities(state).flatMap(unseen), "member int, f double, y double")
        else:
            df = df.withColumn("__third", third)

            def member(j):
                base = fit(df.filter(F.col("__third") != j), name, params)
                rows = score(base, df.filter(F.col("__third") == j), "f")
                return base, rows.select(F.lit(j).alias("member"), "f", F.col("label").alias("y"))

            with ThreadPoolExecutor(k) as pool:
                parts = list(pool.map(member, range(k)))
            models, held = [p[0] for p in parts], parts[0][1]
            for p in parts[1:]:
                held = held.unionByName(p[1])
        links = platt(held)
        return Calibrated([(m, *links[j]) for j, m in enumerate(models)])

    def score(self, df: DataFrame, out: str = "p") -> DataFrame:
        total = F.lit(0.0)
        names = []
        for j, (base, a, b) in enumerate(self.members):
            df = score(base, df, f"__p{j}")
            names.append(f"__p{j}")
            total = total + 1 / (1 + F.exp(-(a * F.col(f"__p{j}") + b)))
        return df.withColumn(out, total / len(self.members)).drop(*names)


def predict(model, df: DataFrame) -> DataFrame:
    return model.score(df) if isinstance(model, Calibrated) else score(model, df)


def draw(name: str, rng: random.Random) -> dict:
    out = {}
    for k, (lo, hi, kind) in SEARCH_SPACE[name].items():
        if kind == "int":
            out[k] = rng.randint(lo, hi)
        elif kind == "log":
            out[k] = lo * (hi / lo) ** rng.random()
        else:
            out[k] = lo + (hi - lo) * rng.random()
    return out


#: Rounds after which the worse half of the boosted trials stops.
RUNGS = (25, 50, 100, 200)


def search(split: DataFrame, name: str, trials: int = 30, folds: int = 3, parallel: int = 4, seed: int = SEED, fixed: dict | None = None,
           rungs: tuple = RUNGS):
    """(best parameters, [(parameters, mean AUC)]): seeded random search by the mean walk-forward AUC.

    Linear trials share every pass over the rows. Boosted trials grow their trees together; after each of `rungs` rounds
    the worse half stops; its AUC is that of the trees it has, and it cannot be the best. Forests are fitted side by side.
    """
    rng = random.Random(seed)
    candidates = [{**draw(name, rng), **(fixed or {})} for _ in range(trials)]

    def auc(scores):
        m = ev.metrics(scores, ["trial", "fold"]).groupBy("trial").agg(F.avg("roc_auc").alias("auc"))
        return {r["trial"]: float(r["auc"]) for r in m.collect()}

    if name == "random_forest":
        def run(params):
            m = ev.metrics(walk_forward_scores(split, name, params, folds), ["fold"])
            return params, float(m.agg(F.avg("roc_auc")).first()[0])

        with ThreadPoolExecutor(parallel) as pool:
            done = list(pool.map(run, candidates))
        alive = range(trials)
    else:
        alive = list(range(trials))

        def halve(rounds, state):
            found = auc(out_of_fold(boosting.probabilities(state), lambda b: b["p"], folds))
            alive.sort(key=lambda t: (-found.get(t, 0.0), t))
            del alive[max(1, (len(alive) + 1) // 2):]
            return [t * folds + f for t in alive for f in range(folds)]

        found = auc(walk_forward_trials(split, name, candidates, folds, rungs, halve))
        done = [(c, found.get(t, 0.5)) for t, c in enumerate(candidates)]
    return done[max(alive, key=lambda t: (done[t][1], -t))][0], done


def importance(model: PipelineModel, features: list[str]) -> DataFrame:
    """Importance of trees or the size of linear coefficients, one row per feature."""
    if isinstance(model, (boosting.Boosted, forest.Forest)):
        values = model.importance()
        return SparkSession.getActiveSession().createDataFrame([(f, float(v)) for f, v in zip(features, values)], "feature string, importance double")
    last = model.stages[-1]
    values = last.featureImportances.toArray() if hasattr(last, "featureImportances") else abs(last.coefficients.toArray())
    return SparkSession.getActiveSession().createDataFrame([(f, float(v)) for f, v in zip(features, values)], "feature string, importance double")


def save_version(model: PipelineModel, base: str, ticker: str, name: str, horizon: str, version: str, meta: DataFrame) -> str:
    """Writes model and metadata under one version folder; the folder name is the version id."""
    path = f"{base}/{ticker}/{name}/{horizon}/versions/{version}"
    if isinstance(model, boosting.Boosted):
        model.save(f"{path}/model")
    else:
        model = model.to_mllib() if isinstance(model, forest.Forest) else model
        model.write().overwrite().save(f"{path}/model")
    meta.coalesce(1).write.mode("overwrite").json(f"{path}/meta")
    return path


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    return [c for c in required if c not in df.columns]


def batch_score(model, latest: DataFrame, features: list[str], required: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(scores, failures): latest rows with complete features are scored, the others are reported with a reason."""
    gone = missing_columns(latest, required or features)
    if gone:
        bad = latest.select("ticker", F.lit("missing columns: " + ", ".join(gone)).alias("reason"))
        return latest.limit(0).select("ticker", "date", F.lit(0.0).alias("p_bullish")), bad
    whole = F.lit(True)
    for c in features:
        whole = whole & F.col(c).isNotNull()
    ok = assemble(latest.filter(whole), features)
    bad = latest.filter(~whole).select("ticker", F.lit("incomplete features").alias("reason"))
    return predict(model, ok).select("ticker", "date", F.round("p", 4).alias("p_bullish")), bad
