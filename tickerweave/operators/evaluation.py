"""Walk-forward folds, classification metrics and curves. Scores: (group, y 0/1, p probability)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerweave.functions.core import div
from tickerweave.functions.cumulative import row_numbers, running_totals

EPS = 2.220446049250313e-16


def walk_forward(df: DataFrame, folds: int = 5, min_train: float = 0.4, embargo: int = 0, long: bool = False) -> DataFrame:
    """Adds `rn`, `test_fold` and the row count of the ticker.

    Row r (0-based) is tested in fold f when min_train + f*size <= r < min_train
    + (f+1)*size and belongs to the training rows of every later fold; the
    remainder behind the last fold is never tested (test_fold NULL). `embargo`
    rows before a test block are kept out of its training rows. `train_fold` is
    the first fold whose training rows hold the row, embargo aside (NULL: none).
    `long`: a ticker may have more rows than a task should sort; `date` is then
    a number, date or time, which is read some five times, and one row per
    ticker goes through the driver. Rows move only for jobs that read `rn`.
    """
    first = F.floor(F.col("n_rows") * min_train).cast("int")
    size = F.greatest(F.lit(1), F.floor((F.col("n_rows") - first) / folds).cast("int"))
    if long:
        marks = F.array(*[first + f * size for f in range(folds + 1)])
        df = row_numbers(df, ["ticker"], "date", "rn", "n_rows", marks, "__passed")
    else:
        w = Window.partitionBy("ticker")
        df = df.withColumns({"rn": F.row_number().over(w.orderBy("date")) - 1, "n_rows": F.count(F.lit(1)).over(w)})
        fold = F.floor((F.col("rn") - first) / size).cast("int")
        df = df.withColumn("__passed", F.when(F.col("rn") < first, 0).otherwise(F.least(fold, F.lit(folds)) + 1))
    df = df.withColumns({"min_train": first, "fold_size": size})
    passed = F.col("__passed")
    df = df.withColumn("test_fold", F.when(passed.between(1, folds), passed - 1)).withColumn("embargo", F.lit(embargo))
    return df.withColumn("train_fold", F.when(passed < folds, passed)).drop("__passed")


def is_train(fold: int) -> Column:
    return F.col("rn") < F.col("min_train") + fold * F.col("fold_size") - F.col("embargo")


def is_test(fold: int) -> Column:
    return F.col("test_fold") == fold


def fold_summary(split: DataFrame, folds: int = 5) -> DataFrame:
    """Train and test sizes and test dates per ticker and fold, straight from the test rows."""
    t = split.filter("test_fold IS NOT NULL").groupBy("ticker", F.col("test_fold").alias("fold")).agg(
        F.max(F.col("min_train") + F.col("test_fold") * F.col("fold_size")).alias("train_size"),
        F.count(F.lit(1)).alias("test_size"),
        F.min("date").alias("test_start"),
        F.max("date").alias("test_end"),
    )
    return t


def _by_score(scores: DataFrame, group: list[str]) -> DataFrame:
    """Distinct scores with their class counts: equal scores merge before the shuffle."""
    return scores.groupBy(*group, "p").agg(
        F.sum(F.col("y").cast("long")).alias("pos"), F.sum((1 - F.col("y")).cast("long")).alias("neg")
    )


def metrics(scores: DataFrame, group: list[str], threshold: float = 0.5) -> DataFrame:
    """Accuracy, F1, ROC-AUC (average ranks for ties), MAE, RMSE, log loss and the confusion counts."""
    y, p = F.col("y"), F.col("p")
    hat = (p >= threshold).cast("int")
    clip = F.least(F.greatest(p, F.lit(EPS)), F.lit(1 - EPS))
    base = scores.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if((hat == 1) & (y == 1)).alias("tp"),
        F.count_if((hat == 1) & (y == 0)).alias("fp"),
        F.count_if((hat == 0) & (y == 1)).alias("fn"),
        F.count_if((hat == 0) & (y == 0)).alias("tn"),
        F.avg(F.abs(y - p)).alias("mae"),
        F.sqrt(F.avg((y - p) * (y - p))).alias("rmse"),
        F.avg(-F.when(y == 1, F.ln(clip)).otherwise(F.ln(1 - clip))).alias("log_loss"),
    )
    d = running_totals(_by_score(scores, group), group, "p", {"below": F.col("neg")})
    auc = d.groupBy(*group).agg(
        div(F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2.0)), (F.sum("pos") * F.sum("neg")).cast("double")).alias("auc")
    )
    df = base.join(auc, group)
    return df.select(
        *group, "n",
        F.round((F.col("tp") + F.col("tn")) / F.col("n"), 4).alias("accuracy"),
        F.round(F.coalesce(div(2.0 * F.col("tp"), 2.0 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0)), 4).alias("f1"),
        F.round(F.coalesce("auc", F.lit(0.5)), 4).alias("roc_auc"),
        F.round("mae", 4).alias("mae"),
        F.round("rmse", 4).alias("rmse"),
        F.round("log_loss", 4).alias("log_loss"),
        "tn", "fp", "fn", "tp",
    )


def mean_metrics(fold_metrics: DataFrame, slot: list[str]) -> DataFrame:
    names = ["accuracy", "f1", "roc_auc", "mae", "rmse"]
    return fold_metrics.groupBy(*slot).agg(
        F.count(F.lit(1)).alias("n_folds"), *[F.round(F.avg(c), 4).alias(f"mean_{c}") for c in names]
    )


def curves(scores: DataFrame, group: list[str]) -> DataFrame:
    """ROC and precision-recall values at every distinct score used as threshold (score >= threshold is positive)."""
    total = scores.groupBy(*group).agg(
        F.sum(F.col("y").cast("long")).alias("all_pos"), F.sum((1 - F.col("y")).cast("long")).alias("all_neg")
    )
    d = running_totals(_by_score(scores, group), group, "p", {"pb": F.col("pos"), "nb": F.col("neg")}).join(total, group)
    tp, fp = F.col("all_pos") - F.col("pb"), F.col("all_neg") - F.col("nb")
    return d.select(
        *group, F.col("p").alias("threshold"),
        div(fp.cast("double"), F.col("all_neg").cast("double")).alias("fpr"),
        div(tp.cast("double"), F.col("all_pos").cast("double")).alias("tpr"),
        div(tp.cast("double"), (tp + fp).cast("double")).alias("precision"),
    )


def calibration(scores: DataFrame, group: list[str], bins: int = 10) -> DataFrame:
    """Share of positives and mean score per uniform bin; empty bins do not appear."""
    b = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int")
    return scores.groupBy(*group, b.alias("bin")).agg(
        F.avg("y").alias("fraction_positive"), F.avg("p").alias("mean_predicted"), F.count(F.lit(1)).alias("n")
    )


def class_report(scores: DataFrame, group: list[str], threshold: float = 0.5) -> DataFrame:
    """Precision, recall, F1 and support per class with the macro and the support-weighted mean."""
    m = metrics(scores, group, threshold)
    z = lambda a, b: F.coalesce(div(a.cast("double"), b.cast("double")), F.lit(0.0))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))

    def entry(label, hit, wrong, lost):
        return F.struct(
            F.lit(label).alias("label"), z(hit, hit + wrong).alias("precision"), z(hit, hit + lost).alias("recall"),
            z(2 * hit, 2 * hit + wrong + lost).alias("f1"), (hit + lost).alias("support"),
        )

    per = m.select(*group, F.explode(F.array(entry("0", tn, fn, fp), entry("1", tp, fp, fn))).alias("e")).select(*group, "e.*")
    roll = per.groupBy(*group).agg(
        F.sum("support").alias("s"),
        *[F.avg(c).alias(f"m_{c}") for c in ("precision", "recall", "f1")],
        *[div(F.sum(F.col(c) * F.col("support")), F.sum("support").cast("double")).alias(f"w_{c}") for c in ("precision", "recall", "f1")],
    )
    means = [
        roll.select(*group, F.lit(name).alias("label"), *[F.col(f"{k}_{c}").alias(c) for c in ("precision", "recall", "f1")], F.col("s").alias("support"))
        for k, name in (("m", "macro avg"), ("w", "weighted avg"))
    ]
    return per.unionByName(means[0]).unionByName(means[1])


def compare_models(scores: DataFrame, model: str = "model") -> DataFrame:
    """Metrics side by side with the rank by AUC; one row per model."""
    m = metrics(scores, [model])
    w = Window.orderBy(F.col("roc_auc").desc(), model)
    return m.select(model, "accuracy", "f1", "roc_auc", "log_loss", F.row_number().over(w).alias("auc_rank"))
