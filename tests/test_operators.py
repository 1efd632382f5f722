"""Rules that are easier to state on small inputs than in SQL."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickerweave.functions.ewm import Ewm, add_ewm
from tickerweave.functions.moments import rolling_kurt, rolling_rank_pct, rolling_skew
from tickerweave.operators import admission, allocation, asof, evaluation, fusion, news, portfolio, retrieval, selection, technical
from tickerweave.operators import versions as vs
from tickerweave.sources import bars as bsrc
from tickerweave.sources import options as osrc
from tickerweave.sources.fundamentals import normalise_earnings


def walk(n, seed=42, ticker="AAA", start="2020-01-01"):
    rng = np.random.default_rng(seed)
    close = 150 * np.exp(np.cumsum(rng.normal(0.0002, 0.015, n)))
    days = pd.bdate_range(start, periods=n)
    return pd.DataFrame({
        "ticker": ticker, "date": days.date, "open": close * (1 + rng.normal(0, 0.003, n)),
        "high": close * (1 + abs(rng.normal(0, 0.005, n))), "low": close * (1 - abs(rng.normal(0, 0.005, n))),
        "close": close, "volume": rng.integers(1_000_000, 50_000_000, n).astype(float),
    })


@pytest.fixture(scope="module")
def sample(spark):
    pdf = pd.concat([walk(500), walk(300, 7, "BBB")])
    return pdf, spark.createDataFrame(pdf, bsrc.BAR_SCHEMA)


@pytest.fixture(scope="module")
def matrix(sample):
    return technical.feature_matrix(sample[1]).toPandas().sort_values(["ticker", "date"])


def test_ewm_matches_pandas(sample):
    pdf, df = sample
    got = add_ewm(df, [Ewm.span("a", F.col("close"), 5), Ewm.span("b", F.col("close"), 50), Ewm("c", F.col("volume"), 0.05, 20)]).toPandas()
    for t, g in got.sort_values("date").groupby("ticker"):
        want = pdf[pdf.ticker == t]
        for col, exp in (("a", want.close.ewm(span=5, adjust=False).mean()), ("b", want.close.ewm(span=50, adjust=False).mean()),
                         ("c", want.volume.ewm(alpha=0.05, min_periods=20, adjust=False).mean())):
            np.testing.assert_allclose(g[col].to_numpy(float), exp.to_numpy(float), rtol=1e-12)


def test_rank_and_moments_match_pandas(sample):
    pdf, df = sample
    got = df.select("ticker", "date", rolling_rank_pct("volume", 100, 60).alias("r"), rolling_skew("close", 20).alias("s"),
                    rolling_kurt("close", 20).alias("k")).filter("ticker = 'AAA'").toPandas().sort_values("date")
    p = pdf[pdf.ticker == "AAA"]
    np.testing.assert_allclose(got.r.to_numpy(float), p.volume.rolling(100, min_periods=60).rank(pct=True).to_numpy())
    np.testing.assert_allclose(got.s.to_numpy(float), p.close.rolling(20).skew().to_numpy(), rtol=1e-6)
    np.testing.assert_allclose(got.k.to_numpy(float), p.close.rolling(20).kurt().to_numpy(), rtol=1e-5)


def test_matrix_is_complete_and_bounded(matrix):
    assert len(technical.TECHNICAL_FEATURES) == 83
    x = matrix[technical.TECHNICAL_FEATURES]
    assert not x.isna().any().any() and np.isfinite(x.astype(float)).all().all()
    assert matrix.rsi_14.between(0, 100).all() and (matrix.atr_14 > 0).all()
    assert (matrix.bb_upper >= matrix.bb_middle).all() and (matrix.bb_middle >= matrix.bb_lower).all()
    assert set(matrix.target) <= {0, 1}
    # The 252-row rank needs 60 volatilities of 21 returns: row 80 is the first complete one.
    assert len(matrix[matrix.ticker == "AAA"]) == 500 - 80


def test_label_tail(spark):
    rows = [("A", dt.date(2024, 1, d), 1.0, 1.0, 1.0, float(d), 1.0) for d in (1, 2, 3)]
    df = spark.createDataFrame(rows, bsrc.BAR_SCHEMA)
    assert [r.target_1d for r in technical.add_labels(df).orderBy("date").collect()] == [1, 1, 0]
    assert [r.target_1d for r in technical.add_labels(df, "null").orderBy("date").collect()] == [1, 1, None]


def test_rsi_without_losses_is_null(spark):
    rows = [("A", dt.date(2024, 1, 1) + dt.timedelta(d), 1.0, 1.0, 1.0, 10.0 + d, 1.0) for d in range(20)]
    got = technical.technical_features(spark.createDataFrame(rows, bsrc.BAR_SCHEMA), ["rsi_14"]).collect()
    assert all(r.rsi_14 is None for r in got)


@pytest.mark.parametrize("bucket", [None, "month"])
def test_asof_keeps_null_payload(spark, bucket):
    d = lambda k: dt.datetime(2024, 1, 1) + dt.timedelta(days=k)
    left = spark.createDataFrame([("a", d(0)), ("a", d(3)), ("a", d(6)), ("a", d(70))], "k string, date timestamp")
    right = spark.createDataFrame([("a", d(1), 10.0), ("a", d(5), None), ("a", d(40), 7.0)], "k string, date timestamp, v double")
    got = [r.v for r in asof.asof_backward(left, right, ["k"], bucket=bucket).orderBy("date").collect()]
    assert got == [None, 10.0, None, 7.0]


def test_asof_bucket_keeps_null_across_periods(spark):
    d = lambda k: dt.datetime(2024, 1, 1) + dt.timedelta(days=k)
    left = spark.createDataFrame([("a", d(70))], "k string, date timestamp")
    right = spark.createDataFrame([("a", d(1), 10.0), ("a", d(5), None)], "k string, date timestamp, v double")
    assert asof.asof_backward(left, right, ["k"], bucket="month").first().v is None


def test_constant_maturity(spark):
    row = spark.range(1).select(
        osrc.constant_maturity(F.lit(0.2), F.lit(10.0), F.lit(0.3), F.lit(60.0)).alias("a"),
        osrc.constant_maturity(F.lit(None).cast("double"), F.lit(10.0), F.lit(0.3), F.lit(60.0)).alias("b"),
        osrc.constant_maturity(F.lit(0.2), F.lit(40.0), F.lit(0.3), F.lit(60.0)).alias("c"),
    ).first()
    assert round(row.a, 6) == 0.282843 and row.b == 0.3 and row.c == 0.2


def test_atm_uses_two_strikes_per_side(spark):
    day, exp = dt.date(2024, 1, 1), dt.date(2024, 1, 20)
    rows = [("T", day, exp, s, k, 0.2, 5.0, 50.0, 1.0, 1.05) for s in ("call", "put") for k in (90.0, 100.0, 110.0)]
    chain = spark.createDataFrame(rows, "ticker string, snapshot_date date, expiry date, side string, strike double, iv double, volume double, open_interest double, bid double, ask double")
    spot = spark.createDataFrame([("T", day, 100.0)], "ticker string, snapshot_date date, spot double")
    s = osrc.chain_snapshots(chain, spot).first()
    assert s.n_contracts_used == 4 and s.is_optionable and s.next_expiry is None and abs(s.atm_iv_near - 0.2) < 1e-12
    bad = chain.withColumn("ask", F.lit(2.0)).withColumn("bid", F.lit(1.0))
    assert not osrc.chain_snapshots(bad, spot).first().is_optionable


def test_snapshot_store_is_idempotent(spark, tmp_path):
    rows = [("T", dt.date(2024, 1, k), k, dt.datetime(2024, 1, k, 10)) for k in (1, 2, 31)] + [("T", dt.date(2024, 2, 3), 3, dt.datetime(2024, 2, 3, 10))]
    df = spark.createDataFrame(rows, "ticker string, snapshot_date date, n_contracts_used int, fetched_at timestamp")
    path = str(tmp_path / "store")
    osrc.store_snapshots(spark, path, df)
    osrc.store_snapshots(spark, path, df)
    later = df.filter("snapshot_date = '2024-01-02'").withColumns({"n_contracts_used": F.lit(99), "fetched_at": F.col("fetched_at") + F.expr("INTERVAL 1 HOUR")})
    osrc.store_snapshots(spark, path, later)
    got = {r.snapshot_date: r.n_contracts_used for r in spark.read.parquet(path).collect()}
    assert len(got) == 4 and got[dt.date(2024, 1, 2)] == 99 and got[dt.date(2024, 2, 3)] == 3


def test_bar_storage_round_trip(spark, sample, tmp_path):
    path = str(tmp_path / "bars")
    bsrc.write_bars(sample[1], path)
    bsrc.write_bars(sample[1].filter("ticker = 'BBB'"), path)
    assert bsrc.read_fresh(spark, path, 1).count() == 800
    assert bsrc.read_fresh(spark, path, 1, now=dt.datetime.now() + dt.timedelta(days=3)).count() == 0
    assert bsrc.read_bars(spark, path).columns == technical.BAR_COLUMNS


def test_earnings_names_are_recognised(spark):
    df = spark.createDataFrame([("A", "2024-01-05", "1.5", "1.0"), ("A", "2024-04-05", "x", "1.0"), ("A", "2024-07-05", "1.0", "0")],
                               "ticker string, announced string, `EPS Actual` string, `Expected EPS` string")
    got = normalise_earnings(df).orderBy("announced").collect()
    assert [r.surprise_pct for r in got] == [0.5, None]
    assert normalise_earnings(df.drop("Expected EPS")).count() == 0


def test_walk_forward_layout(spark):
    df = spark.createDataFrame([("A", dt.date(2024, 1, 1) + dt.timedelta(k)) for k in range(103)], "ticker string, date date")
    s = evaluation.walk_forward(df)
    f = {r.fold: (r.train_size, r.test_size) for r in evaluation.fold_summary(s).collect()}
    assert f == {k: (41 + 12 * k, 12) for k in range(5)}
    assert s.filter("test_fold IS NULL AND rn >= 41").count() == 2
    assert s.filter(evaluation.is_train(2) & evaluation.is_test(2)).count() == 0


def test_auc_ties_and_single_class(spark):
    y, p = [0, 0, 1, 1, 1, 0], [0.1, 0.4, 0.4, 0.8, 0.4, 0.9]
    df = spark.createDataFrame([("m", a, b) for a, b in zip(y, p)] + [("one", 1, 0.5)], "model string, y int, p double")
    got = {r.model: r for r in evaluation.metrics(df, ["model"]).collect()}
    pairs = [(1.0 if a > b else 0.5 if a == b else 0.0) for a, ya in zip(p, y) if ya for b, yb in zip(p, y) if not yb]
    assert abs(got["m"].roc_auc - round(sum(pairs) / len(pairs), 4)) < 1e-9 and got["one"].roc_auc == 0.5


def test_chunks(spark):
    df = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(500))), (2, " \n "), (3, "one")], "doc_id int, text string")
    got = retrieval.chunk(df).orderBy("doc_id", "chunk_index").collect()
    assert [(r.doc_id, r.word_start) for r in got] == [(1, 0), (1, 448), (3, 0)]
    assert got[1].content.split()[0] == "w448"


def test_page_text_rules():
    title, text = retrieval.page_text("<html><head><title> T </title></head><body><nav>no</nav><div id='Main-Content'><p>a&amp;b</p><script>x</script> c</div><p>out</p></body></html>")
    assert (title, text) == ("T", "a&b c")
    title, text = retrieval.page_text("<body><h1>Head</h1><article>first</article><main>x</main><table><tr><td>no</td></tr></table></body>")
    assert (title, text) == ("Head", "first")


def test_search_matches_brute_force(spark):
    rng = np.random.default_rng(0)
    v, q = rng.normal(size=(300, 8)), rng.normal(size=(3, 8))
    vd = spark.createDataFrame([(k, [float(x) for x in r]) for k, r in enumerate(v)], "vec_id bigint, embedding array<float>")
    qd = spark.createDataFrame([(k, [float(x) for x in r]) for k, r in enumerate(q)], "query_id int, vector array<double>")
    got = retrieval.search(qd, vd, 5, block_rows=40, query_rows=2).collect()
    want = {(k, int(i)) for k in range(3) for i in np.argsort(-(v.astype(np.float32).astype(float) @ q[k]))[:5]}
    assert {(r.query_id, r.vec_id) for r in got} == want


def test_embeddings_have_unit_length(spark):
    df = spark.createDataFrame([("alpha beta beta",), ("gamma",)], "content string")
    for enc in (None, lambda texts: [[len(t), 1.0] for t in texts]):
        for r in retrieval.embed(df, dim=16, encoder=enc).collect():
            assert abs(sum(x * x for x in r.embedding) - 1) < 1e-5


def test_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("two\nlines")
    (tmp_path / "b.json").write_text('["x", "y"]')
    (tmp_path / "c.json").write_text('{"k": 1}')
    got = retrieval.read_texts(spark, str(tmp_path)).orderBy("source", "part").collect()
    assert [(r.source, r.text) for r in got] == [("a.txt", "two\nlines"), ("b.json", "x"), ("b.json", "y"), ("c.json", '{"k": 1}')]


def test_rule_fusion_tiers(spark):
    sig = spark.createDataFrame([(t, 1, 0.7, "high") for t in "abcd"], "ticker string, prediction int, p_bullish double, confidence_label string")
    br = spark.createDataFrame([("a", "positive", 0.4, True), ("b", "negative", -0.4, True), ("c", "positive", 0.29, True)],
                               "ticker string, aggregate_sentiment string, sentiment_score double, retrieval_success boolean")
    got = {r.ticker: (r.final_direction, r.final_confidence, r.fusion_probability) for r in fusion.rule_fusion(sig, br).collect()}
    assert got == {"a": ("BULLISH", "MODERATE", 0.7), "b": ("NEUTRAL", "LOW", 0.5), "c": ("BULLISH", "HIGH", 0.7), "d": ("BULLISH", "HIGH", 0.7)}


def test_confidence_and_headlines(spark):
    df = spark.createDataFrame([(0.66,), (0.60,), (0.52,)], "p double")
    assert [r[0] for r in df.select(fusion.confidence_label(F.col("p"))).collect()] == ["high", "moderate", "low"]
    label, score = news.headline_sentiment(F.lit("Shares surge on strong growth but risk remains"))
    assert tuple(spark.range(1).select(label, score).first()) == ("positive", 0.5)


def test_admission_fixture_and_hot_key(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [("f", k, base + dt.timedelta(seconds=t)) for k, t in enumerate((0, 1, 2, 10, 11))]
    df = spark.createDataFrame(rows, "key string, id bigint, ts timestamp")
    got = [r.allowed for r in admission.admit(df, "key", "ts", "id", 2, 10).orderBy("id").collect()]
    assert got == [True, True, False, False, True]
    rng = np.random.default_rng(3)
    rows, truth = [], {}
    for key, n, span in (("hot", 1500, 3000), ("calm", 60, 6000), ("burst", 200, 900)):
        ts = np.sort(rng.integers(0, span, n))
        ok = admission.admit_pandas(list(ts), 3, 30)
        for k, (t, o) in enumerate(zip(ts, ok)):
            rows.append((key, k, base + dt.timedelta(seconds=int(t))))
            truth[key, k] = o
    df = spark.createDataFrame(rows, "key string, id bigint, ts timestamp")
    got = {(r.key, r.id): r.allowed for r in admission.admit(df, "key", "ts", "id", 3, 30).collect()}
    assert got == truth


def _problem(spark, mu, cov, current=None, sectors=None):
    n = len(mu)
    return spark.createDataFrame(
        [(1, [f"T{k}" for k in range(n)], current or [1 / n] * n, list(map(float, mu)), sectors or ["S"] * n, [float(x) for x in np.asarray(cov).ravel()])],
        "portfolio_id int, tickers array<string>, current array<double>, mu array<double>, sectors array<string>, cov array<double>",
    )


@pytest.fixture(scope="module")
def toy():
    vol = np.array([0.2, 0.25, 0.3, 0.15])
    corr = np.full((4, 4), 0.3) + 0.7 * np.eye(4)
    return np.array([0.10, 0.12, 0.15, 0.05]), np.outer(vol, vol) * corr


def test_optimizer_meets_limits_and_beats_the_grid(spark, toy):
    mu, cov = toy
    prob = _problem(spark, mu, cov)
    r = allocation.optimize(prob, max_position=0.4).first()
    w = np.array(r.w)
    assert abs(w.sum() - 1) < 1e-6 and (w >= -1e-9).all() and (w <= 0.4 + 1e-6).all()
    grid = allocation.lattice_search(prob, 10, 0.4).first()
    assert r.sharpe_ratio >= grid.sharpe - 2e-3


def test_sector_and_turnover_limits(spark, toy):
    mu, cov = toy
    r = allocation.optimize(_problem(spark, mu, cov, sectors=["A", "A", "B", "B"]), 0.5, 0.5).first()
    assert r.w[0] + r.w[1] <= 0.5 + 1e-4 and r.w[2] + r.w[3] <= 0.5 + 1e-4
    cur = [0.25, 0.25, 0.25, 0.25]
    r = allocation.optimize(_problem(spark, mu, cov, current=cur), 0.5, turnover=0.1).first()
    assert np.abs(np.array(r.w) - cur).sum() <= 0.1 + 1e-3


def test_frontier(spark, toy):
    mu, cov = toy
    pts = allocation.efficient_frontier(_problem(spark, mu, cov), 1.0).toPandas().sort_values("expected_return")
    assert len(pts) == 15 and pts.volatility.min() > 0
    assert abs(pts.volatility.iloc[-1] - math.sqrt(cov[2, 2])) < 1e-4
    assert allocation.efficient_frontier(_problem(spark, [0.1] * 4, cov), 1.0).count() == 1


def test_weights_default_to_equal(spark):
    pos = spark.createDataFrame([(1, t, None, None, None) for t in "abcd"], "portfolio_id int, ticker string, weight double, market_value double, shares double")
    px = spark.createDataFrame([(1, t, dt.date(2024, 1, 1), 5.0) for t in "abcd"], "portfolio_id int, ticker string, date date, close double")
    assert {r.weight for r in portfolio.current_weights(pos, px).collect()} == {0.25}


def test_correlated_pair_keeps_the_informative_one():
    corr = np.array([[1, 0.99, 0.1], [0.99, 1, 0.1], [0.1, 0.1, 1]])
    assert selection.prune_correlated(["a", "b", "c"], corr, np.array([0.2, 0.5, 0.1])) == ["a"]
    assert selection.prune_correlated(["a", "b", "c"], corr, np.array([0.5, 0.2, 0.1])) == ["b"]
    assert selection.prune_correlated(["a", "b", "c"], corr, np.array([0.5, 0.5, 0.1])) == ["a"]


def test_selector_boundary_and_metadata(spark, tmp_path):
    import json

    for model, auc in (("xgboost", 0.51), ("lightgbm", 0.52), ("random_forest", 0.52)):
        p = tmp_path / "AAA" / model / "1d" / "versions" / f"20240101T000000_{model[:4]}0000"
        p.mkdir(parents=True)
        (p / "meta.json").write_text(json.dumps({"mean_roc_auc": auc, "trained_at": "2024-01-01T00:00:00+00:00"}))
    bad = tmp_path / "AAA" / "logistic_regression" / "1d" / "versions" / "x"
    bad.mkdir(parents=True)
    (bad / "meta.json").write_text("{broken")
    v = vs.read_metadata(spark, str(tmp_path / "*/*/*/versions/*/meta.json"), "mean_roc_auc double, trained_at string").cache()
    assert v.count() == 3
    got = vs.select_model(v, v, v.select("ticker", "horizon")).first()
    assert (got.model_name, got.reason, got.from_leaderboard) == ("lightgbm", "leaderboard", True)
    kept, gone = vs.prune(v, v.limit(0), 10)
    assert kept.count() == 3 and gone.count() == 0


def test_registry_write_is_idempotent(spark, tmp_path):
    df = spark.createDataFrame([("A", "xgboost", "1d", "v1", 0.6), ("A", "xgboost", "7d", "v1", 0.7)],
                               "ticker string, model_name string, horizon string, version_id string, mean_roc_auc double")
    path = str(tmp_path / "reg")
    vs.write_registry(df, path)
    vs.write_registry(df.filter("horizon = '1d'"), path)
    assert vs.read_registry(spark, path, df.schema).count() == 2


def test_chunk_store_and_context(spark, tmp_path):
    path = str(tmp_path / "chunks")
    rows = [("http://a/x/", 0, "one", [1.0]), ("http://a/x/", 1, "two", [2.0]), ("http://b", 0, "three", [3.0])]
    df = spark.createDataFrame(rows, "url string, chunk_index int, content string, vec array<double>")
    retrieval.append_chunks(df.limit(2), path)
    for _ in range(2):
        retrieval.append_chunks(df, path)
    retrieval.append_chunks(df.withColumn("url", F.regexp_replace("url", "x/$", "x")), path)
    assert sorted(r.content for r in retrieval.load_chunks(spark, path).collect()) == ["one", "three", "two"]
    with pytest.raises(ValueError):
        retrieval.append_chunks(df.withColumn("vec", F.lit("text")), path)
    assert retrieval.load_chunks(spark, path).count() == 3
    hits = spark.createDataFrame([(1, 7, 0.5, 1)], "query_id int, vec_id long, score double, rank int")
    chunks = spark.createDataFrame([(7, "text" * 100, "s", "t")], "vec_id long, content string, source string, title string")
    asked = spark.createDataFrame([(1,), (2,)], "query_id int")
    got = {r.query_id: r.context for r in retrieval.context_block(hits, chunks, asked).collect()}
    assert "text" * 100 in got[1] and got[2] == "No relevant context found."
    assert len(retrieval.hit_views(hits, chunks, 200).first().content) == 200


def test_exponential_means_over_gaps(spark):
    from tickerweave.functions.core import pct_change

    rng = np.random.default_rng(3)
    x = pd.Series(rng.normal(100, 5, 700))
    x[:5] = np.nan
    x[rng.random(700) < 0.2] = np.nan
    x[200:420] = np.nan
    rows = [("A", k, None if np.isnan(v) else float(v)) for k, v in enumerate(x)]
    df = spark.createDataFrame(rows, "ticker string, date int, close double").repartition(3)
    specs = [("a", 0.1, 1), ("b", 2 / 6, 5), ("c", 0.02, 14)]
    out = add_ewm(df, [Ewm(n, F.col("close"), a, m) for n, a, m in specs])
    out = out.withColumn("r", pct_change("close", 3)).orderBy("date").toPandas()
    for n, a, m in specs:
        want = x.ewm(alpha=a, adjust=False, min_periods=m).mean()
        np.testing.assert_allclose(out[n].to_numpy(float), want.to_numpy(), rtol=1e-9)
    np.testing.assert_allclose(out["r"].to_numpy(float), (x.ffill() / x.ffill().shift(3) - 1).to_numpy(), rtol=1e-9)


def test_headings_in_noise_and_one_scoring_schema(spark):
    from tickerweave.operators import training

    assert retrieval.page_text("<body><header><h1>Head</h1>menu</header><p>text <b>more</p></body>") == ("Head", "text more")
    latest = spark.createDataFrame([("A", 1, 2.0)], "ticker string, date int, x double")
    scores, bad = training.batch_score(None, latest, ["x", "y"])
    assert scores.columns == ["ticker", "date", "p_bullish"] and scores.count() == 0 and bad.count() == 1


def test_snapshots_of_whatever_is_asked(spark):
    from tickerweave.sources import options as osrc

    day, later, past = dt.date(2024, 3, 1), dt.date(2024, 4, 1), dt.date(2024, 2, 1)
    quote = "ticker string, snapshot_date date, expiry date, side string, strike double, bid double, ask double, volume double, open_interest double, iv double"
    rows = [(t, day, e, s, k, 1.0, 1.1, 20.0, 50.0, 0.3) for t, e in (("GOOD", later), ("OLD", past), ("NOSPOT", later)) for s in ("call", "put") for k in (9.0, 11.0)]
    spot = spark.createDataFrame([("GOOD", day, 10.0), ("OLD", day, 10.0), ("NONE", day, 10.0)], "ticker string, snapshot_date date, spot double")
    chain = spark.createDataFrame(rows, quote)
    asked = spark.createDataFrame([(t, day) for t in ("GOOD", "OLD", "NOSPOT", "NONE")], "ticker string, snapshot_date date")
    got = {r.ticker: r for r in osrc.chain_snapshots(chain, spot, asked=asked).collect()}
    assert {t: (r.is_optionable, r.n_contracts_used) for t, r in got.items()} == {"GOOD": (True, 4), "OLD": (False, 0), "NOSPOT": (False, 0), "NONE": (False, 0)}
    assert got["OLD"].near_expiry is None and got["OLD"].atm_iv_cm30 is None and got["GOOD"].put_call_volume_ratio == 1.0
    assert osrc.chain_snapshots(chain, spot).count() == 3


def test_levels_of_many_symbols_in_one_sweep(spark):
    series = spark.createDataFrame(
        [("A", 2, 1.0), ("A", 4, None), ("A", 7, 3.0), ("B", 5, 9.0), ("C", 1, 5.0), (None, 1, 6.0)], "symbol string, date int, close double")
    bars = spark.createDataFrame([("x", d, "A" if d % 2 else "Z") for d in (1, 2, 3, 5, 8)] + [("y", 6, None)], "ticker string, date int, symbol string")
    got = asof.align_levels(bars, series, {"A": "a", "B": "b", "Q": "q"})
    rows = {r.date: (r.a, r.b, r.q) for r in got.collect()}
    none = (None, None, None)
    assert rows == {1: none, 2: (1.0, None, None), 3: (1.0, None, None), 5: (None, 9.0, None), 6: (None, 9.0, None), 8: (3.0, 9.0, None)}
    picked = got.select("date", asof.pick_level(F.col("symbol"), {"A": "a", "B": "b"}).alias("p")).collect()
    assert {r.date: r.p for r in picked} == {1: None, 2: None, 3: 1.0, 5: None, 6: None, 8: None}
    assert asof.align_levels(bars, series.limit(0), {"A": "a"}).filter("a IS NULL").count() == 6
    assert asof.align_levels(bars.limit(0), series, {"A": "a"}).count() == 0
