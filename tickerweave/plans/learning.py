"""Registered queries for selection, training, scoring and explanation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickerweave.functions.core import rnd
from tickerweave.operators import evaluation as ev
from tickerweave.operators import explain, selection, technical, training
from tickerweave.plans import inputs as i
from tickerweave.plans.inputs import BARS, r, with_ctes
from tickerweave.plans.technical import SQL, _BASE, _W
from tickerweave.session import reuse

FEATURES = technical.TECHNICAL_FEATURES


def _matrix(spark, sf):
    """Complete rows of all features with the label of the next day."""
    df = technical.feature_matrix(i.bars(spark, sf)).withColumn("label", F.col("target_1d").cast("double"))
    return df.select("ticker", "date", "label", *FEATURES)


def _split(spark, sf):
    """Matrix with fold columns and the assembled vector, kept while the folds are fitted."""
    return reuse(training.assemble(ev.walk_forward(_matrix(spark, sf)), FEATURES))


def _mi(spark, sf):
    li = i.read(spark, sf, "lineitem").withColumn("label", (F.col("l_returnflag") == "R").cast("int"))
    m = selection.mutual_information(li, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "label")
    return m.select("feature", rnd("mi", 9).alias("mi"))


def _mi_sql():
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    long = " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS x, CAST(l_returnflag = 'R' AS INTEGER) AS y FROM lineitem" for c in cols)
    return f"""WITH l AS ({long}),
e AS (SELECT feature, quantile_disc(x, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM l GROUP BY feature),
b AS (SELECT l.feature, y, len(list_filter(e.e, lambda v: v < x)) AS bin FROM l JOIN e USING (feature)),
c AS (SELECT feature, bin, y, count(*)::DOUBLE AS n FROM b GROUP BY ALL),
t AS (SELECT *, sum(n) OVER (PARTITION BY feature) AS t, sum(n) OVER (PARTITION BY feature, bin) AS nb, sum(n) OVER (PARTITION BY feature, y) AS ny FROM c)
SELECT feature, {r('greatest(sum(n / t * ln(n * t / (nb * ny))), 0)', 9)} AS mi FROM t GROUP BY feature"""


def _corr_matrix(spark, sf):
    """Variances and absolute correlations of four features with each other and the label, from one Gram pass."""
    li = i.read(spark, sf, "lineitem").withColumn("label", (F.col("l_returnflag") == "R").cast("int"))
    f = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    s = selection.fold_statistics(li, f)[0]
    rows = [(a, b, float(s.corr[x, y])) for x, a in enumerate(f) for y, b in enumerate(f) if x < y]
    rows += [(a, "label", float(s.target[x])) for x, a in enumerate(f)] + [(a, "variance", float(s.var[x])) for x, a in enumerate(f)]
    v = F.when(F.col("b") == "variance", rnd("v", 2)).otherwise(rnd("v"))
    return spark.createDataFrame(rows, "a string, b string, v double").select("a", "b", v.alias("v"))


def _corr_sql():
    f = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    y = "CAST(l_returnflag = 'R' AS INTEGER)"
    parts = [f"SELECT '{a}' AS a, '{b}' AS b, {r(f'abs(corr({a}, {b}))')} AS v FROM lineitem" for x, a in enumerate(f) for b in f[x + 1:]]
    parts += [f"SELECT '{a}', 'label', {r(f'abs(corr({a}, {y}))')} FROM lineitem" for a in f]
    parts += [f"SELECT '{a}', 'variance', {r(f'var_samp({a})', 2)} FROM lineitem" for a in f]
    return " UNION ALL ".join(parts)


def _stable(spark, sf):
    stable, audit = selection.stability_select(reuse(ev.walk_forward(_matrix(spark, sf)).select("train_fold", "label", *FEATURES)), FEATURES)
    return _positions(selection.selection_audit(audit), stable)


def _positions(a, stable):
    order = F.array_position(F.array(*[F.lit(c) for c in stable]) if stable else F.array(F.lit("")), F.col("feature"))
    return a.withColumn("position", order.cast("int")).select("feature", "folds_selected", rnd("mean_mi").alias("mean_mi"), "dropped_at",
                                                             F.col("kept").cast("int").alias("kept"), "consistency", "position")


def _basic(spark, sf):
    names = selection.basic_select(_matrix(spark, sf), FEATURES)
    return spark.createDataFrame([(k + 1, n) for k, n in enumerate(names)], "position int, feature string")


# Line items as rows of a matrix: line status for the ticker, order and line number for the date, eight numeric features, two
# of them nearly copies of the price and one nearly constant.
_LINES = {
    "quantity": "CAST(l_quantity AS DOUBLE)", "price": "CAST(l_extendedprice AS DOUBLE)", "discount": "CAST(l_discount AS DOUBLE)",
    "tax": "CAST(l_tax AS DOUBLE)", "unit": "CAST(l_extendedprice / l_quantity AS DOUBLE)",
    "charge": "CAST(l_extendedprice * (1 - l_discount) AS DOUBLE)", "total": "CAST(l_extendedprice * (1 - l_discount) * (1 + l_tax) AS DOUBLE)",
    "flat": "CAST(l_linenumber * 1e-6 AS DOUBLE)",
}
_LINE_KEYS = "l_linestatus AS ticker, l_orderkey * 8 + l_linenumber AS date, CAST(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS DOUBLE) AS label"


def _lines(spark, sf):
    return i.read(spark, sf, "lineitem").selectExpr(*_LINE_KEYS.split(", "), *[f"{e} AS {c}" for c, e in _LINES.items()])


def _stable_lines(spark, sf):
    stable, audit = selection.stability_select(ev.walk_forward(_lines(spark, sf), long=True), list(_LINES))
    return _positions(selection.selection_audit(audit), stable)


def _basic_lines(spark, sf):
    names = selection.basic_select(_lines(spark, sf), list(_LINES), top_n=3)
    return spark.createDataFrame([(k + 1, n) for k, n in enumerate(names)], "position int, feature string")


def _line_ctes(folds):
    """Per fold (nested training rows): variances, correlations and information of the eight features, in long form."""
    names = list(_LINES)
    values = ", ".join(f"{e} AS {c}" for c, e in _LINES.items())
    first = "CASE " + " ".join(f"WHEN rn < mt + {f} * fs THEN {f}" for f in range(folds)) + " END" if folds > 1 else "0"
    stats = " UNION ALL ".join(
        f"SELECT fold, {k} AS i, '{c}' AS feature, var_samp({c}) AS v, var_pop({c}) AS vp, abs(coalesce(corr({c}, label), 0)) AS t FROM s GROUP BY fold"
        for k, c in enumerate(names))
    pairs = " UNION ALL ".join(
        f"SELECT fold, {a} AS i, {b} AS j, abs(coalesce(corr({names[a]}, {names[b]}), 0)) AS c FROM s GROUP BY fold"
        for b in range(len(names)) for a in range(b))
    long = " UNION ALL ".join(f"SELECT fold, {k} AS i, {c} AS x, label AS y FROM s" for k, c in enumerate(names))
    return (
        f"b AS (SELECT {_LINE_KEYS}, {values} FROM lineitem)",
        "w AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS rn, count(*) OVER (PARTITION BY ticker) AS n FROM b)",
        f"z AS (SELECT *, CAST(floor(n * 0.4::DOUBLE) AS INTEGER) AS mt, greatest(1, CAST(floor((n - floor(n * 0.4::DOUBLE)) / {max(folds, 1)}) AS INTEGER)) AS fs FROM w)",
        f"z1 AS (SELECT *, {first} AS first FROM z)",
        f"s AS MATERIALIZED (SELECT * FROM z1, range({folds}) f(fold) WHERE first <= fold)",
        f"st AS MATERIALIZED ({stats})", f"pr AS MATERIALIZED ({pairs})", f"lg AS ({long})",
        "rk AS (SELECT *, rank() OVER (PARTITION BY fold, i ORDER BY x) - 1 AS below, count(*) OVER (PARTITION BY fold, i) AS rows FROM lg)",
        "ce AS (SELECT fold, i, least(9, 10 * below // rows) AS bin, y, count(*)::DOUBLE AS n FROM rk GROUP BY ALL)",
        """ct AS (SELECT *, sum(n) OVER (PARTITION BY fold, i) AS t, sum(n) OVER (PARTITION BY fold, i, bin) AS nb,
          sum(n) OVER (PARTITION BY fold, i, y) AS ny FROM ce)""",
        "mi AS MATERIALIZED (SELECT fold, i, greatest(sum(n / t * ln(n * t / (nb * ny))), 0) AS mi FROM ct GROUP BY ALL)",
    )


_STABLE_LINES_SQL = "WITH RECURSIVE " + ",\n".join([
    *_line_ctes(5),
    "fl AS (SELECT fold, greatest(quantile_cont(v, 0.05), 1e-9) AS floor FROM st GROUP BY fold)",
    "kp AS (SELECT st.* FROM st JOIN fl USING (fold) WHERE v >= floor)",
    """sq AS MATERIALIZED (SELECT pr.*, a.t AS ti, b.t AS tj, row_number() OVER (PARTITION BY pr.fold ORDER BY pr.j, pr.i) AS k
      FROM pr JOIN kp a ON a.fold = pr.fold AND a.i = pr.i JOIN kp b ON b.fold = pr.fold AND b.i = pr.j)""",
    """wk AS (SELECT DISTINCT fold, 0::BIGINT AS k, []::BIGINT[] AS gone FROM kp UNION ALL
      SELECT w.fold, q.k, CASE WHEN list_contains(gone, q.i) OR list_contains(gone, q.j) OR q.c <= 0.95 THEN gone
        WHEN q.tj >= q.ti THEN list_append(gone, q.i) ELSE list_append(gone, q.j) END FROM wk w JOIN sq q ON q.fold = w.fold AND q.k = w.k + 1)""",
    "gn AS (SELECT fold, arg_max(gone, k) AS gone FROM wk GROUP BY fold)",
    """lf AS (SELECT st.fold, st.i, st.feature, kp.i IS NOT NULL AS kept, list_contains(gone, st.i) AS corr, mi.mi
      FROM st LEFT JOIN kp ON kp.fold = st.fold AND kp.i = st.i JOIN gn ON gn.fold = st.fold JOIN mi ON mi.fold = st.fold AND mi.i = st.i)""",
    """sg AS (SELECT *, CASE WHEN NOT kept THEN 'low_variance' WHEN corr THEN 'correlated'
        WHEN mi < 0.05 * max(mi) FILTER (kept AND NOT corr) OVER (PARTITION BY fold) THEN 'low_mi' ELSE 'selected' END AS stage,
        CASE WHEN kept AND NOT corr THEN mi ELSE 0 END AS m FROM lf)""",
    """ag AS (SELECT i, feature, count(*) FILTER (stage = 'selected') AS k, avg(m) AS mean_mi,
        coalesce(string_agg(DISTINCT stage, ',' ORDER BY stage) FILTER (stage <> 'selected'), '') AS dropped_at FROM sg GROUP BY ALL)""",
    "ps AS (SELECT feature, row_number() OVER (ORDER BY mean_mi DESC, i) AS position FROM ag WHERE k >= 3)",
]) + f"""
SELECT feature, k AS folds_selected, {r('mean_mi')} AS mean_mi, dropped_at, CAST(k >= 3 AS INTEGER) AS kept,
  CASE WHEN k = 5 THEN 'all' WHEN k >= 3 THEN 'most' WHEN k = 1 THEN 'once' ELSE 'mixed' END AS consistency,
  CAST(coalesce(position, 0) AS INTEGER) AS position FROM ag LEFT JOIN ps USING (feature)"""

_BASIC_LINES_SQL = "WITH " + ",\n".join([
    *_line_ctes(1),
    "kp AS (SELECT * FROM st WHERE vp > 1e-5)",
    """lt AS (SELECT DISTINCT pr.j AS i FROM pr JOIN kp a ON a.i = pr.i JOIN kp b ON b.i = pr.j WHERE pr.c > 0.95)""",
    "nm AS (SELECT kp.feature, mi.mi FROM kp JOIN mi USING (i) WHERE i NOT IN (SELECT i FROM lt))",
]) + """
SELECT CAST(row_number() OVER (ORDER BY mi DESC, feature) AS INTEGER) AS position, feature FROM nm QUALIFY position <= 3"""


def _fold_picks(spark, sf):
    """Line items as picks: fold = line number, feature = brand, stage by mean discount and quantity."""
    li = i.read(spark, sf, "lineitem").select("l_partkey", "l_linenumber", "l_discount", "l_quantity")
    p = i.read(spark, sf, "part").select("p_partkey", "p_brand")
    g = li.join(p, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_linenumber").alias("fold"), F.col("p_brand").alias("feature")).agg(
        F.round(F.avg("l_discount"), 4).alias("d"), F.round(F.avg("l_quantity"), 3).alias("q"))
    stage = F.when(F.col("d") < 0.0493, "low_variance").when(F.col("q") < 25, "low_mi").otherwise("selected")
    return g.select("fold", "feature", stage.alias("stage"), F.col("d").alias("mi"))


def _audit(spark, sf):
    a = selection.selection_audit(_fold_picks(spark, sf))
    return a.select("feature", "folds_selected", rnd("mean_mi").alias("mean_mi"), "dropped_at", F.col("kept").cast("int").alias("kept"), "consistency")


_AUDIT_SQL = f"""WITH g AS (SELECT l_linenumber AS fold, p_brand AS feature, round(avg(l_discount), 4) AS d, round(avg(l_quantity), 3) AS q
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
s AS (SELECT *, CASE WHEN d < 0.0493 THEN 'low_variance' WHEN q < 25 THEN 'low_mi' ELSE 'selected' END AS stage FROM g),
n AS (SELECT count(DISTINCT fold) AS n FROM s),
a AS (SELECT feature, count(*) FILTER (WHERE stage = 'selected') AS k, avg(d) AS m, coalesce(string_agg(DISTINCT CASE WHEN stage <> 'selected' THEN stage END, ',' ORDER BY CASE WHEN stage <> 'selected' THEN stage END), '') AS dropped_at
  FROM s GROUP BY feature)
SELECT feature, k AS folds_selected, {r('m')} AS mean_mi, dropped_at, CAST(k >= least(3, n) AS INTEGER) AS kept,
  CASE WHEN k = n THEN 'all' WHEN k >= least(3, n) THEN 'most' WHEN k = 1 THEN 'once' ELSE 'mixed' END AS consistency FROM a, n"""


def _walk(name):
    def run(spark, sf):
        m = ev.metrics(training.walk_forward_scores(_split(spark, sf), name), ["fold"])
        return m.select("fold", "n", "accuracy", "f1", "roc_auc", "mae", "rmse")

    return run


def _calibrated(spark, sf):
    split = _split(spark, sf)
    model = training.Calibrated.fit(split, "random_forest")
    s = model.score(split).select(F.lit("random_forest").alias("model"), F.col("label").alias("y"), "p")
    return ev.metrics(s, ["model"])


def _search(spark, sf):
    _, done = training.search(_split(spark, sf), "logistic_regression")
    return spark.createDataFrame([(k, float(p["C"]), round(a, 4)) for k, (p, a) in enumerate(done)], "trial int, c double, mean_auc double")


def _batch(spark, sf):
    split = _split(spark, sf)
    model = training.fit(split, "logistic_regression")
    latest = technical.latest_row(technical.technical_features(i.bars(spark, sf), FEATURES).select("ticker", "date", *FEATURES))
    s, bad = training.batch_score(model, latest, FEATURES)
    return s.select("ticker", "date", "p_bullish", F.lit("").alias("reason")).unionByName(
        bad.select("ticker", F.lit(None).cast("date").alias("date"), F.lit(None).cast("double").alias("p_bullish"), "reason"))


def _columns(spark, sf):
    """Feature list and label of one horizon, checked against the columns a model needs."""
    m = technical.add_labels(technical.technical_features(i.bars(spark, sf), ["returns_1d", "sma_5"]))
    x = technical.split_xy(m, "7d")
    gone = training.missing_columns(x, ["returns_1d", "sma_5", "macd"])
    return x.select("ticker", "date", rnd("returns_1d").alias("returns_1d"), rnd("sma_5").alias("sma_5"), "label", F.lit(",".join(gone)).alias("missing"))


_COLUMNS_SQL = with_ctes(
    BARS, _BASE,
    select=f"""SELECT ticker, date, {r(SQL['returns_1d'])} AS returns_1d, {r(SQL['sma_5'])} AS sma_5, {SQL['target_7d']} AS label, 'macd' AS missing FROM base {_W}""",
)

# Coefficients of a linear model; any values show the attribution.
_COEF = {"returns_1d": 0.8, "realized_vol_5d": -0.05, "close_vs_sma_20": 0.4, "candle_dir": 0.1}


def _linear_parts(spark, sf):
    names = list(_COEF)
    m = technical.technical_features(i.bars(spark, sf), names).select("ticker", "date", *names).dropna("any")
    means = m.agg(*[F.avg(c).alias(c) for c in names])
    return explain.linear_attribution(m, _COEF, means, 0.2)


def _linear(spark, sf):
    a = _linear_parts(spark, sf)
    return explain.top_drivers(a, 3).select("ticker", "date", "feature", rnd("attribution").alias("attribution"), "direction", "rank", rnd("base_value").alias("base_value"))


def _importance(spark, sf):
    g = explain.global_importance(_linear_parts(spark, sf)).select("feature", F.round("importance", 6).alias("importance"))
    return selection.top_features(g, 3).select("feature", "importance", "rank")


def _attr_ctes():
    names = list(_COEF)
    sel = ", ".join(f"{SQL[n]} AS {n}" for n in names)
    ok = " AND ".join(f"{n} IS NOT NULL" for n in names)
    avg = ", ".join(f"avg({n}) AS m_{n}" for n in names)
    base = "0.2::DOUBLE + " + " + ".join(f"{c!r}::DOUBLE * m_{n}" for n, c in _COEF.items())
    long = " UNION ALL ".join(f"SELECT ticker, date, '{n}' AS feature, {c!r}::DOUBLE * ({n} - m_{n}) AS a, {base} AS b FROM f, m" for n, c in _COEF.items())
    return (BARS, _BASE, f"f0 AS (SELECT ticker, date, {sel} FROM base {_W})", f"f AS (SELECT * FROM f0 WHERE {ok})", f"m AS (SELECT {avg} FROM f)", f"l AS ({long})")


def _shapley(spark, sf):
    split = _split(spark, sf)
    feats = FEATURES
    model = training.fit(split, "random_forest")
    means = split.agg(*[F.avg(c).alias(c) for c in feats])
    rows = technical.latest_row(split.select("ticker", "date", *feats))
    a = explain.shapley_attribution(model, rows, feats, means)
    return a.select("ticker", "feature", rnd("attribution").alias("attribution"), rnd("base_value").alias("base_value"))


def _tree_attribution(spark, sf):
    split = _split(spark, sf)
    model = training.fit(split, "random_forest")
    a = explain.tree_attribution(model, technical.latest_row(split.select("ticker", "date", *FEATURES)), FEATURES)
    return explain.top_drivers(a, 10).select("ticker", "date", "feature", rnd("attribution").alias("attribution"), "direction", "rank",
                                             rnd("base_value").alias("base_value"))


def _surrogate(spark, sf):
    split = _split(spark, sf)
    model = training.fit(split, "random_forest")
    spread = split.agg(*[F.stddev_samp(c).alias(c) for c in FEATURES])
    rows = technical.latest_row(split.select("ticker", "date", *FEATURES))
    s = explain.local_surrogate(model, rows, FEATURES, spread)
    return s.select("ticker", "feature", rnd("weight").alias("weight"), "rank")


QUERIES = {
    "p02_p03_p05_columns": _columns,
    "m02_basic_selection": _basic,
    "m03_m04_gram_statistics": _corr_matrix,
    "m05_binned_information": _mi,
    "m06_stability_selection": _stable,
    "m02_basic_selection_lines": _basic_lines,
    "m06_stability_selection_lines": _stable_lines,
    "a28_p13_selection_audit": _audit,
    "m07_m11_logistic_walk_forward": _walk("logistic_regression"),
    "m08_random_forest_walk_forward": _walk("random_forest"),
    "m09_boosted_walk_forward": _walk("xgboost"),
    "m10_lightgbm_walk_forward": _walk("lightgbm"),
    "m12_platt_scaling": _calibrated,
    "m13_parameter_search": _search,
    "m15_batch_scoring": _batch,
    "m16_k04_linear_attribution": _linear,
    "m16_shapley_attribution": _shapley,
    "m16_tree_attribution": _tree_attribution,
    "m17_local_surrogate": _surrogate,
    "a29_global_importance": _importance,
}
ORACLES = {
    "p02_p03_p05_columns": _COLUMNS_SQL,
    "m03_m04_gram_statistics": _corr_sql(),
    "m05_binned_information": _mi_sql(),
    "m02_basic_selection_lines": _BASIC_LINES_SQL,
    "m06_stability_selection_lines": _STABLE_LINES_SQL,
    "a28_p13_selection_audit": _AUDIT_SQL,
    "m16_k04_linear_attribution": with_ctes(
        *_attr_ctes(),
        "k AS (SELECT *, CAST(row_number() OVER (PARTITION BY ticker, date ORDER BY abs(a) DESC, feature) AS INTEGER) AS rank FROM l)",
        select=f"""SELECT ticker, date, feature, {r('a')} AS attribution, CASE WHEN a > 0 THEN 'bullish' ELSE 'bearish' END AS direction, rank, {r('b')} AS base_value
          FROM k WHERE rank <= 3"""),
    "a29_global_importance": with_ctes(
        *_attr_ctes(), "g AS (SELECT feature, round(avg(abs(a)), 6) AS importance FROM l GROUP BY feature)",
        select="SELECT feature, importance, CAST(row_number() OVER (ORDER BY importance DESC, feature) AS INTEGER) AS rank FROM g QUALIFY rank <= 3"),
}
