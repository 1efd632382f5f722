"""Registered queries for ingest checks, evaluation and the model registry."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tickerweave.functions.core import rnd
from tickerweave.operators import evaluation as ev
from tickerweave.operators import technical, versions as vs
from tickerweave.operators.blocks import checkpoint_folder
from tickerweave.plans import inputs as i
from tickerweave.plans.inputs import BARS, BARS_BRAND, r, with_ctes
from tickerweave.plans.technical import SQL, _BASE, _W
from tickerweave.sources import bars as bsrc

# --- ingest -------------------------------------------------------------------------


def _read_bars(spark, sf):
    """Bars in source naming (mixed case, NaN for missing), stored and read as the standard columns."""
    raw = i.bars(spark, sf).select(
        "ticker", F.col("date").alias("Date"), F.col("open").alias("Open"), F.col("high").alias("High"), F.col("low").alias("Low"),
        F.when(F.col("volume") > 1, F.col("close")).otherwise(F.lit(float("nan"))).alias("Close"), F.col("volume").alias("Volume"),
    )
    path = f"{checkpoint_folder(spark)}/bars-{uuid.uuid4().hex}"
    raw.write.parquet(path)
    df = bsrc.read_bars(spark, path)
    return df.select("ticker", "date", *[rnd(c).alias(c) for c in bsrc.PRICE_COLUMNS])


def _window(spark, sf):
    b = bsrc.history_window(i.bars(spark, sf), "1998-06-01", years=3)
    return b.select("ticker", "date", rnd("close").alias("close"))


def _dirty(spark, sf):
    """Brand bars with gaps and bad prices that depend on the volume of the day."""
    b = i.bars_brand(spark, sf)
    brand = F.regexp_extract("ticker", r"(\d+)$", 1).cast("int")
    gap = (brand % 5 == 1) & (F.col("volume") < 5)
    bad = (brand % 5 == 2) & (F.col("volume") > 100)
    return b.withColumn("close", F.when(gap, None).when(bad, -1.0).otherwise(F.col("close")))


_DIRTY = """dirty AS (SELECT ticker, date, open, high, low, volume, CASE WHEN b % 5 = 1 AND volume < 5 THEN NULL WHEN b % 5 = 2 AND volume > 100 THEN -1.0
  ELSE close END AS close FROM (SELECT *, CAST(regexp_extract(ticker, '(\\d+)$', 1) AS INTEGER) AS b FROM bars_brand)),
rep0 AS (SELECT ticker, count(*) AS n_rows, greatest(avg(CAST(close IS NULL AS DOUBLE)), 0.0) AS nr, max(CASE WHEN close <= 0 THEN 1 ELSE 0 END) AS bad FROM dirty GROUP BY ticker),
want AS (SELECT DISTINCT p_brand AS ticker FROM part UNION SELECT r_name FROM region),
rep AS (SELECT ticker, coalesce(n_rows, 0) AS n_rows, coalesce(nr, 0.0) AS nr, CASE WHEN n_rows IS NULL THEN 'empty' WHEN n_rows < 1500 THEN 'too_few_rows'
  WHEN nr > 0.01 THEN 'too_many_nulls' WHEN bad = 1 THEN 'non_positive_close' ELSE '' END AS reason FROM want LEFT JOIN rep0 USING (ticker))"""


def _wanted(spark, sf):
    p = i.read(spark, sf, "part").select(F.col("p_brand").alias("ticker")).distinct()
    return p.unionByName(i.read(spark, sf, "region").select(F.col("r_name").alias("ticker")))


def _report(spark, sf):
    return bsrc.validation_report(_dirty(spark, sf), min_rows=1500, expected=_wanted(spark, sf))


def _valid_rows(spark, sf):
    kept = bsrc.keep_valid(_dirty(spark, sf), _report(spark, sf))
    return kept.groupBy("ticker").agg(F.count(F.lit(1)).alias("n_rows"), rnd(F.sum("volume")).alias("volume"))


def _failed(spark, sf):
    """Requested tickers that no usable bars were obtained for."""
    ok = bsrc.keep_valid(_dirty(spark, sf), _report(spark, sf)).select("ticker").distinct()
    return _wanted(spark, sf).join(ok, "ticker", "left_anti")


def _summary(spark, sf):
    return bsrc.summarize(_dirty(spark, sf))


def _position(spark, sf):
    return bsrc.year_position(i.bars(spark, sf)).select("ticker", rnd("position_pct", 4).alias("position_pct"))


def _complete(spark, sf):
    names = ["candle_body", "overnight_gap", "returns_10d"]
    df = technical.technical_features(i.bars(spark, sf), names).select("ticker", "date", *names)
    return technical.drop_incomplete(df).select("ticker", "date", *[rnd(n).alias(n) for n in names])


def _complete_sql():
    names = ["candle_body", "overnight_gap", "returns_10d"]
    sel = ", ".join(f"{SQL[n]} AS {n}" for n in names)
    return with_ctes(
        BARS, _BASE, f"f AS (SELECT ticker, date, {sel} FROM base {_W})",
        select="SELECT ticker, date, " + ", ".join(f"{r(n)} AS {n}" for n in names)
        + " FROM f WHERE " + " AND ".join(f"{n} IS NOT NULL" for n in names),
    )


def _blocks(spark, sf):
    """Technical block with a sector-wide block joined on (ticker, date)."""
    b = i.bars(spark, sf)
    tech = technical.technical_features(b, ["returns_1d", "sma_20"]).select("ticker", "date", "returns_1d", "sma_20")
    m = i.series(spark, sf).filter("symbol = 'XLK'").select("date", F.col("close").alias("xlk"))
    block = b.select("ticker", "date").join(m, "date").select("ticker", "date", "xlk")
    out = tech.join(technical.impute_median(block, ["xlk"]), ["ticker", "date"], "left")
    return out.select("ticker", "date", *[rnd(c).alias(c) for c in ("returns_1d", "sma_20", "xlk")])


_BLOCKS_SQL = with_ctes(
    BARS, i.SERIES, _BASE, f"f AS (SELECT ticker, date, {SQL['returns_1d']} AS returns_1d, {SQL['sma_20']} AS sma_20 FROM base {_W})",
    select=f"""SELECT ticker, f.date, {r('returns_1d')} AS returns_1d, {r('sma_20')} AS sma_20, {r('s.close')} AS xlk
      FROM f LEFT JOIN series s ON s.symbol = 'XLK' AND s.date = f.date""",
)

# --- evaluation ---------------------------------------------------------------------

_MODEL = "CASE lang WHEN 'en' THEN 'xgboost' WHEN 'fr' THEN 'lightgbm' WHEN 'de' THEN 'random_forest' ELSE 'logistic_regression' END"


def _scores(spark, sf):
    d = i.read(spark, sf, "documents").select("doc_id", "lang", "n_chars", "source")
    s = i.read(spark, sf, "labels").join(d, "doc_id")
    n = F.col("n_chars")
    return s.select(
        F.expr(_MODEL).alias("model"), "source", F.col("quality").alias("y"), F.round(n / (n + 1000), 2).alias("p")
    )


_SCORES = f"scores AS (SELECT {_MODEL} AS model, source, quality AS y, round(n_chars / (n_chars + 1000), 2) AS p FROM labels JOIN documents USING (doc_id))"
_AUC = """auc AS (SELECT model, (sum(CASE WHEN y = 1 THEN rk END) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / nullif(sum(y) * sum(1 - y), 0) AS auc FROM
  (SELECT *, rank() OVER (PARTITION BY model ORDER BY p) + (count(*) OVER (PARTITION BY model, p) - 1) / 2.0::DOUBLE AS rk FROM scores) GROUP BY model),
conf AS (SELECT model, count(*) AS n, count(*) FILTER (WHERE p >= 0.5 AND y = 1) AS tp, count(*) FILTER (WHERE p >= 0.5 AND y = 0) AS fp,
  count(*) FILTER (WHERE p < 0.5 AND y = 1) AS fn, count(*) FILTER (WHERE p < 0.5 AND y = 0) AS tn, avg(abs(y - p)) AS mae, sqrt(avg((y - p) * (y - p))) AS rmse,
  avg(-CASE WHEN y = 1 THEN ln(greatest(p, 2.220446049250313e-16::DOUBLE)) ELSE ln(1 - least(p, 1 - 2.220446049250313e-16::DOUBLE)) END) AS ll
  FROM scores GROUP BY model),
met AS (SELECT conf.*, round((tp + tn) / n, 4) AS accuracy, round(coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0), 4) AS f1,
  round(coalesce(auc, 0.5), 4) AS roc_auc FROM conf JOIN auc USING (model))"""


def _fold_means(spark, sf):
    """Metrics per source as if each were a fold, averaged per model."""
    return ev.mean_metrics(ev.metrics(_scores(spark, sf), ["model", "source"]), ["model"])


_FOLD_MEANS_SQL = with_ctes(
    _SCORES,
    "ms AS (SELECT model || '|' || source AS model, y, p FROM scores)",
    _AUC.replace("FROM scores", "FROM ms"),
    select="""SELECT split_part(model, '|', 1) AS model, count(*) AS n_folds, round(avg(accuracy), 4) AS mean_accuracy, round(avg(f1), 4) AS mean_f1,
      round(avg(roc_auc), 4) AS mean_roc_auc, round(avg(round(mae, 4)), 4) AS mean_mae, round(avg(round(rmse, 4)), 4) AS mean_rmse FROM met GROUP BY 1""",
)

_CLASS_SQL = with_ctes(
    _SCORES, _AUC,
    """per AS (SELECT model, '0' AS label, coalesce(tn / nullif(tn + fn, 0), 0) AS precision, coalesce(tn / nullif(tn + fp, 0), 0) AS recall,
      coalesce(2.0::DOUBLE * tn / nullif(2 * tn + fn + fp, 0), 0) AS f1, tn + fp AS support FROM conf
      UNION ALL SELECT model, '1', coalesce(tp / nullif(tp + fp, 0), 0), coalesce(tp / nullif(tp + fn, 0), 0), coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0), tp + fn FROM conf)""",
    """al AS (SELECT * FROM per UNION ALL SELECT model, 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM per GROUP BY model
      UNION ALL SELECT model, 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM per GROUP BY model)""",
    select=f"SELECT model, label, {r('precision')} AS precision, {r('recall')} AS recall, {r('f1')} AS f1, support FROM al",
)


def _split(spark, sf):
    return ev.fold_summary(ev.walk_forward(i.bars(spark, sf).select("ticker", "date")))


_SPLIT_SQL = with_ctes(
    BARS,
    """n AS (SELECT ticker, date, row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS rn, count(*) OVER (PARTITION BY ticker) AS n FROM bars)""",
    "m AS (SELECT *, CAST(floor(n * 0.4::DOUBLE) AS BIGINT) AS mt FROM n)",
    "s AS (SELECT *, greatest(1, (n - mt) // 5) AS fs FROM m)",
    "f AS (SELECT *, UNNEST([0, 1, 2, 3, 4]) AS fold FROM s)",
    select="""SELECT ticker, fold, max(mt + fold * fs) AS train_size, count(*) AS test_size, min(date) AS test_start, max(date) AS test_end
      FROM f WHERE rn >= mt + fold * fs AND rn < mt + (fold + 1) * fs GROUP BY ticker, fold""",
)

# --- registry -----------------------------------------------------------------------

_VERSION = {
    "ticker": "o_orderpriority",
    "model_name": "CASE o_orderstatus WHEN 'F' THEN 'xgboost' WHEN 'O' THEN 'lightgbm' ELSE 'random_forest' END",
    "horizon": "CASE o_custkey % 4 WHEN 0 THEN '1d' WHEN 1 THEN '7d' WHEN 2 THEN '1m' ELSE '6m' END",
    "mean_roc_auc": "round(0.44 + (o_totalprice % 1000) / 8000, 4)",
    "feature_columns": "CASE WHEN o_orderkey % 3 = 0 THEN {arr}'rsi_14', 'macd', 'obv'{end} WHEN o_orderkey % 3 = 1 THEN {arr}'macd', 'atr_14'{end} ELSE {arr}'gone_1', 'macd'{end} END",
    "has_selection": "o_orderkey % 2 = 0",
    "on_disk": "o_orderkey % 7 <> 0",
}


def _versions(spark, sf):
    """Orders as trained versions: slot from priority, status and customer; one active version per slot."""
    o = i.read(spark, sf, "orders")
    cols = [f"{e.format(arr='array(', end=')')} AS {k}" for k, e in _VERSION.items()]
    df = o.selectExpr("o_orderkey", "o_totalprice", "timestampadd(SECOND, CAST(o_orderkey AS INT), o_orderdate) AS trained_at", *cols)
    params = F.struct((F.col("o_orderkey") % 5).alias("depth"))
    return df.withColumn("version_id", vs.version_id(F.col("trained_at"), F.col("feature_columns"), params))


def _active(v):
    """The version trained on the smallest order is active; one slot in five has none."""
    a = v.groupBy(*vs.SLOT).agg(F.min_by("version_id", F.struct("o_totalprice", "o_orderkey")).alias("version_id"))
    return a.filter("NOT (ticker = '5-LOW' AND model_name = 'xgboost')")


_VERS = (
    "vers AS (SELECT o_orderkey, o_totalprice, o_orderdate + to_seconds(o_orderkey) AS trained_at, "
    + ", ".join(f"{e.format(arr='[', end=']')} AS {k}" for k, e in _VERSION.items() if k != "mean_roc_auc")
    + ", round(0.44::DOUBLE + (o_totalprice % 1000) / 8000, 4) AS mean_roc_auc FROM orders),\n"
    + """versions AS (SELECT *, strftime(trained_at, '%Y%m%dT%H%M%S_') || left(sha256('{"features":["' || array_to_string(list_sort(feature_columns), '","')
    || '"],"params":{"depth":' || o_orderkey % 5 || '}}'), 8) AS version_id FROM vers),
slots AS (SELECT ticker, model_name, horizon, arg_min(version_id, struct_pack(a := o_totalprice, b := o_orderkey)) AS active_id FROM versions GROUP BY ALL),
active AS (SELECT * FROM slots WHERE NOT (ticker = '5-LOW' AND model_name = 'xgboost')),
hist AS (SELECT versions.*, coalesce(version_id = active_id, false) AS is_active, row_number() OVER (PARTITION BY ticker, model_name, horizon ORDER BY version_id) AS version_no,
  row_number() OVER (PARTITION BY ticker, model_name, horizon ORDER BY version_id DESC) AS rdesc FROM versions LEFT JOIN active USING (ticker, model_name, horizon))"""
)


def _history(spark, sf):
    v = _versions(spark, sf)
    h = vs.history(v, _active(v), v.filter("on_disk"))
    return h.select(*vs.SLOT, "version_id", "version_no", F.col("is_active").cast("int").alias("is_active"),
                    F.col("exists_on_disk").cast("int").alias("exists_on_disk"), vs.version_time(F.col("version_id")).alias("trained_at"))


def _board(spark, sf):
    v = _versions(spark, sf)
    return vs.leaderboard(v, _active(v)).select("ticker", "horizon", "model_name", "version_id", rnd("mean_roc_auc", 4).alias("mean_roc_auc"), "position")


_PREF = "CASE model_name WHEN 'xgboost' THEN 1 WHEN 'lightgbm' THEN 2 WHEN 'random_forest' THEN 3 ELSE 4 END"


def _best(spark, sf):
    v = _versions(spark, sf)
    wanted = v.select("ticker", "horizon").distinct().unionByName(v.select("ticker", F.lit("3m").alias("horizon")).distinct())
    b = vs.select_model(v, _active(v), wanted)
    return b.select("ticker", "horizon", "model_name", "reason", rnd("auc", 4).alias("auc"), F.col("from_leaderboard").cast("int").alias("from_leaderboard"), "version_id")


_BEST_SQL = with_ctes(
    _VERS,
    "want AS (SELECT DISTINCT ticker, horizon FROM versions UNION SELECT ticker, '3m' FROM versions)",
    f"""b AS (SELECT * FROM hist WHERE is_active QUALIFY row_number() OVER (PARTITION BY ticker, horizon
      ORDER BY mean_roc_auc >= 0.52 DESC, mean_roc_auc DESC, {_PREF}) = 1)""",
    select=f"""SELECT want.ticker, want.horizon, coalesce(model_name, 'xgboost') AS model_name, CASE WHEN mean_roc_auc IS NULL THEN 'no_artifacts_default'
      WHEN mean_roc_auc >= 0.52 THEN 'leaderboard' ELSE 'best_below_threshold' END AS reason, {r('coalesce(mean_roc_auc, 0)', 4)} AS auc,
      CAST(coalesce(mean_roc_auc >= 0.52, false) AS INTEGER) AS from_leaderboard, version_id FROM want LEFT JOIN b USING (ticker, horizon)""",
)


def _prune(spark, sf):
    v = _versions(spark, sf)
    kept, _ = vs.prune(v, _active(v))
    return kept.select(*vs.SLOT, "version_id")


def _rollback(spark, sf):
    """Pointers after every slot rolls back to its newest other existing version."""
    v = _versions(spark, sf)
    a = _active(v)
    return vs.promote(a, vs.rollback_targets(v, a, v.filter("on_disk"))).select(*vs.SLOT, "version_id")


def _promotions(spark, sf):
    """The newest version of each slot as candidate against the active one."""
    v = _versions(spark, sf)
    c = v.groupBy(*vs.SLOT).agg(F.max_by("mean_roc_auc", "version_id").alias("mean_roc_auc"))
    d = vs.promotion_decisions(c, v, _active(v))
    return d.select(*vs.SLOT, rnd("mean_roc_auc", 4).alias("mean_roc_auc"), rnd("active_auc", 4).alias("active_auc"), F.col("promote").cast("int").alias("promote"))


_CURRENT = ["macd", "obv", "rsi_14", "atr_14", "bb_pct"]


def _triggers(spark, sf):
    v = _versions(spark, sf)
    current = F.array(*[F.lit(c) for c in _CURRENT])
    return vs.retrain_triggers(v.select(*vs.SLOT).distinct(), v, _active(v), v.filter("on_disk"), current)


def _drift(spark, sf):
    v = _versions(spark, sf)
    gone, new = vs.feature_drift(F.col("feature_columns"), F.array(*[F.lit(c) for c in _CURRENT]))
    return v.select("version_id", "o_orderkey", F.array_join(gone, ",").alias("missing"), F.array_join(new, ",").alias("new"))


_CUR_SQL = "[" + ", ".join(f"'{c}'" for c in _CURRENT) + "]"

QUERIES = {
    "s01_read_bars": _read_bars,
    "s03_history_window": _window,
    "s04_valid_tickers": _valid_rows,
    "p01_bar_validation": lambda s, sf: _report(s, sf).select("ticker", "n_rows", rnd("max_null_rate").alias("max_null_rate"), "status", "reason"),
    "p04_complete_rows": _complete,
    "j04_u05_block_join": _blocks,
    "j13_u03_failed_tickers": _failed,
    "a01_bar_summary": _summary,
    "a02_year_position": _position,
    "m01_walk_forward": _split,
    "a20_a22_a23_metrics": lambda s, sf: ev.metrics(_scores(s, sf), ["model"]),
    "a21_fold_means": _fold_means,
    "a24_curves": lambda s, sf: ev.curves(_scores(s, sf), ["model"]).select("model", "threshold", *[rnd(c).alias(c) for c in ("fpr", "tpr", "precision")]),
    "a25_calibration": lambda s, sf: ev.calibration(_scores(s, sf), ["model"]).select("model", "bin", rnd("fraction_positive").alias("fraction_positive"), rnd("mean_predicted").alias("mean_predicted"), "n"),
    "a26_class_report": lambda s, sf: ev.class_report(_scores(s, sf), ["model"]).select("model", "label", *[rnd(c).alias(c) for c in ("precision", "recall", "f1")], "support"),
    "a27_model_comparison": lambda s, sf: ev.compare_models(_scores(s, sf)),
    "j09_k09_version_history": _history,
    "k05_leaderboard": _board,
    "k06_best_model": _best,
    "k08_version_retention": _prune,
    "t09_rollback": _rollback,
    "t09_auto_promotion": _promotions,
    "u02_feature_drift": _drift,
    "m14_retrain_triggers": _triggers,
}
ORACLES = {
    "s01_read_bars": with_ctes(
        BARS, select=f"SELECT ticker, date, {', '.join(f'{r(c)} AS {c}' for c in ('open', 'high', 'low', 'volume'))}, CASE WHEN volume > 1 THEN {r('close')} END AS close FROM bars"),
    "s03_history_window": with_ctes(
        BARS, select=f"SELECT ticker, date, {r('close')} AS close FROM bars WHERE date >= DATE '1998-06-01' - 1095 AND date < DATE '1998-06-01'"),
    "s04_valid_tickers": with_ctes(
        BARS_BRAND, _DIRTY, select=f"SELECT ticker, count(*) AS n_rows, {r('sum(volume)')} AS volume FROM dirty WHERE ticker IN (SELECT ticker FROM rep WHERE reason = '') GROUP BY ticker"),
    "p01_bar_validation": with_ctes(
        BARS_BRAND, _DIRTY, select=f"SELECT ticker, n_rows, {r('nr')} AS max_null_rate, CASE WHEN reason = '' THEN 'ok' ELSE 'rejected' END AS status, reason FROM rep"),
    "p04_complete_rows": _complete_sql(),
    "j04_u05_block_join": _BLOCKS_SQL,
    "j13_u03_failed_tickers": with_ctes(BARS_BRAND, _DIRTY, select="SELECT ticker FROM want EXCEPT SELECT ticker FROM rep WHERE reason = ''"),
    "a01_bar_summary": with_ctes(
        BARS_BRAND, _DIRTY,
        select="""SELECT ticker, min(date) AS first_date, max(date) AS last_date, count(*) AS n_rows, round(min(close), 4) AS min_close, round(max(close), 4) AS max_close,
          round(avg(close), 4) AS mean_close, count(*) - count(close) AS null_count FROM dirty GROUP BY ticker"""),
    "a02_year_position": with_ctes(
        BARS, "l AS (SELECT ticker, max(date) AS ld FROM bars GROUP BY ticker)",
        "y AS (SELECT ticker, avg(close) AS m, min(close) AS lo, max(close) AS hi FROM bars JOIN l USING (ticker) WHERE date > ld - 365 GROUP BY ticker)",
        select=f"SELECT ticker, {r('(m - lo) / greatest(hi - lo, 0.01) * 100', 4)} AS position_pct FROM y"),
    "m01_walk_forward": _SPLIT_SQL,
    "a20_a22_a23_metrics": with_ctes(
        _SCORES, _AUC, select="SELECT model, n, accuracy, f1, roc_auc, round(mae, 4) AS mae, round(rmse, 4) AS rmse, round(ll, 4) AS log_loss, tn, fp, fn, tp FROM met"),
    "a21_fold_means": _FOLD_MEANS_SQL,
    "a24_curves": with_ctes(
        _SCORES, "t AS (SELECT DISTINCT model, p AS threshold FROM scores)",
        """c AS (SELECT t.model, threshold, count(*) FILTER (WHERE p >= threshold AND y = 1) AS tp, count(*) FILTER (WHERE p >= threshold AND y = 0) AS fp,
          sum(y) AS pp, sum(1 - y) AS nn FROM t JOIN scores s ON s.model = t.model GROUP BY ALL)""",
        select=f"SELECT model, threshold, {r('fp / nn')} AS fpr, {r('tp / pp')} AS tpr, {r('tp / (tp + fp)')} AS precision FROM c"),
    "a25_calibration": with_ctes(
        _SCORES, select=f"""SELECT model, CAST(least(floor(p * 10), 9) AS INTEGER) AS bin, {r('avg(y)')} AS fraction_positive, {r('avg(p)')} AS mean_predicted, count(*) AS n
          FROM scores GROUP BY ALL"""),
    "a26_class_report": _CLASS_SQL,
    "a27_model_comparison": with_ctes(
        _SCORES, _AUC, select="""SELECT model, accuracy, f1, roc_auc, round(ll, 4) AS log_loss,
          CAST(row_number() OVER (ORDER BY roc_auc DESC, model) AS INTEGER) AS auc_rank FROM met"""),
    "j09_k09_version_history": with_ctes(
        _VERS, select="""SELECT ticker, model_name, horizon, version_id, CAST(version_no AS INTEGER) AS version_no, CAST(is_active AS INTEGER) AS is_active,
          CAST(on_disk AS INTEGER) AS exists_on_disk, trained_at FROM hist"""),
    "k05_leaderboard": with_ctes(
        _VERS, select=f"""SELECT ticker, horizon, model_name, version_id, {r('mean_roc_auc', 4)} AS mean_roc_auc,
          CAST(row_number() OVER (PARTITION BY ticker, horizon ORDER BY mean_roc_auc DESC, {_PREF}) AS INTEGER) AS position FROM hist WHERE is_active"""),
    "k06_best_model": _BEST_SQL,
    "k08_version_retention": with_ctes(_VERS, select="SELECT ticker, model_name, horizon, version_id FROM hist WHERE rdesc <= 10 OR is_active"),
    "t09_rollback": with_ctes(
        _VERS, "t AS (SELECT ticker, model_name, horizon, max(version_id) AS v FROM hist WHERE NOT is_active AND on_disk GROUP BY ALL)",
        select="""SELECT ticker, model_name, horizon, coalesce(v, active_id) AS version_id FROM t FULL JOIN active USING (ticker, model_name, horizon)"""),
    "t09_auto_promotion": with_ctes(
        _VERS, "c AS (SELECT ticker, model_name, horizon, arg_max(mean_roc_auc, version_id) AS auc FROM versions GROUP BY ALL)",
        "a AS (SELECT ticker, model_name, horizon, mean_roc_auc AS aa FROM hist WHERE is_active)",
        select=f"""SELECT ticker, model_name, horizon, {r('auc', 4)} AS mean_roc_auc, {r('aa', 4)} AS active_auc, CAST(coalesce(auc - aa >= 0.005::DOUBLE, true) AS INTEGER) AS promote
          FROM c LEFT JOIN a USING (ticker, model_name, horizon)"""),
    "u02_feature_drift": with_ctes(
        _VERS, select=f"""SELECT version_id, o_orderkey, array_to_string(list_sort(list_filter(feature_columns, lambda x: NOT list_contains({_CUR_SQL}, x))), ',') AS missing,
          array_to_string(list_sort(list_filter({_CUR_SQL}, lambda x: NOT list_contains(feature_columns, x))), ',') AS new FROM versions"""),
    "m14_retrain_triggers": with_ctes(
        _VERS, "a AS (SELECT * FROM hist WHERE is_active)",
        select=f"""SELECT s.ticker, s.model_name, s.horizon, version_id, CASE WHEN version_id IS NULL THEN 'artifact_not_found' WHEN NOT on_disk THEN 'artifact_corrupt'
          WHEN len(list_filter(feature_columns, lambda x: NOT list_contains({_CUR_SQL}, x))) > 0 THEN 'feature_mismatch'
          WHEN NOT has_selection THEN 'feature_selection_applied' END AS trigger FROM slots s LEFT JOIN a USING (ticker, model_name, horizon)"""),
}
