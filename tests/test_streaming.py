"""Streaming runs (file source, availableNow) must equal the batch operators."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_operators import walk

from tickerweave.operators import technical
from tickerweave.operators.admission import admit_pandas
from tickerweave.sources import bars as bsrc
from tickerweave.streaming import jobs


def stream(spark, batches, tmp_path, schema):
    """A file stream that delivers one file per trigger, in order."""
    src = tmp_path / "src"
    for k, b in enumerate(batches):
        b.coalesce(1).write.mode("append").parquet(str(src))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))


def run(df, tmp_path, mode="append"):
    out = str(tmp_path / "out")
    q = df.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(out)
    q.awaitTermination(120)
    assert not q.isActive
    return df.sparkSession.read.schema(df.schema).parquet(out)


def test_admission_stream(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    ts = np.sort(np.random.default_rng(1).integers(0, 400, 120))
    rows = [("k", k, base + dt.timedelta(seconds=int(t))) for k, t in enumerate(ts)]
    df = spark.createDataFrame(rows, "key string, id bigint, ts timestamp")
    s = stream(spark, [df.filter("id < 50"), df.filter("id >= 50")], tmp_path, df.schema)
    got = {r.id: r.allowed for r in run(jobs.admit_stream(s, 3, 30), tmp_path).collect()}
    assert [got[k] for k in range(120)] == admit_pandas(list(ts), 3, 30)


def test_tick_bars_stream(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    rows = [("T", base + dt.timedelta(minutes=7 * k), k, float(k % 13), 1.0) for k in range(200)]
    # A last tick far ahead moves the watermark past every earlier window.
    rows.append(("T", base + dt.timedelta(days=3), 999, 1.0, 1.0))
    df = spark.createDataFrame(rows, "ticker string, ts timestamp, id bigint, price double, size double")
    s = stream(spark, [df.filter("id < 100"), df.filter("id >= 100")], tmp_path, df.schema)
    got = run(jobs.bars_from_ticks(s), tmp_path).toPandas().sort_values("start").reset_index(drop=True)
    want = jobs.bars_from_ticks(df.filter("id <> 999")).toPandas().sort_values("start").reset_index(drop=True)
    pd.testing.assert_frame_equal(got, want)


def test_incremental_indicators_equal_batch(spark, tmp_path):
    df = spark.createDataFrame(pd.concat([walk(150), walk(120, 5, "BBB")]), bsrc.BAR_SCHEMA)
    cut = "date < '2020-04-01'"
    s = stream(spark, [df.filter(cut), df.filter(f"NOT ({cut})")], tmp_path, df.schema)
    got = run(jobs.incremental_indicators(s), tmp_path)
    feats = ["macd", "macd_signal", "rsi_14", "obv", "vwap_deviation"]
    want = technical.technical_features(df, feats)
    j = got.alias("g").join(want.alias("w"), ["ticker", "date"]).select(
        *[F.col(f"g.{c}").alias(f"g_{c}") for c in ("macd", "macd_signal", "rsi_14", "obv")],
        *[F.col(f"w.{c}").alias(f"w_{c}") for c in ("macd", "macd_signal", "rsi_14", "obv")],
        ((F.col("close") - F.col("g.vwap")) / F.col("g.vwap")).alias("g_v"), F.col("vwap_deviation").alias("w_v"),
    ).toPandas()
    assert len(j) == 270
    for c in ("macd", "macd_signal", "rsi_14", "obv", "v"):
        np.testing.assert_allclose(j[f"g_{c}"].to_numpy(float), j[f"w_{c}"].to_numpy(float), rtol=1e-9, atol=1e-9)


def test_incremental_indicators_over_gaps_equal_batch(spark, tmp_path):
    bars = pd.concat([walk(150), walk(120, 5, "BBB")]).reset_index(drop=True)
    for k, c in ((0, "close"), (3, "close"), (4, "close"), (40, "volume"), (41, "high"), (77, "close"), (90, "low"), (91, "close"), (155, "close"), (269, "close")):
        bars.loc[k, c] = None
    rows = [tuple(None if isinstance(v, float) and v != v else v for v in r) for r in bars.itertuples(index=False)]
    df = spark.createDataFrame(rows, bsrc.BAR_SCHEMA)
    cuts = ["date < '2020-01-06'", "date >= '2020-01-06' AND date < '2020-04-01'", "date >= '2020-04-01'"]
    s = stream(spark, [df.filter(c) for c in cuts], tmp_path, df.schema)
    got = run(jobs.incremental_indicators(s), tmp_path)
    want = technical.technical_features(df, ["macd", "macd_signal", "rsi_14", "obv", "vwap_deviation"])
    names = ("macd", "macd_signal", "rsi_14", "obv")
    j = got.alias("g").join(want.alias("w"), ["ticker", "date"]).select(
        *[F.col(f"g.{c}").alias(f"g_{c}") for c in names], *[F.col(f"w.{c}").alias(f"w_{c}") for c in names],
        ((F.col("close") - F.col("g.vwap")) / F.col("g.vwap")).alias("g_v"), F.col("vwap_deviation").alias("w_v")).toPandas()
    assert len(j) == 270
    for c in (*names, "v"):
        np.testing.assert_allclose(j[f"g_{c}"].to_numpy(float), j[f"w_{c}"].to_numpy(float), rtol=1e-9, atol=1e-9)


def test_first_news_stream(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [("A", "Big News!", t), ("A", "big news", t), ("B", "Big news", t), ("A", "Other", t)]
    df = spark.createDataFrame(rows, "ticker string, title string, published_at timestamp")
    s = stream(spark, [df, df], tmp_path, df.schema)
    assert run(jobs.first_news(s), tmp_path).count() == jobs.first_news(df).count() == 3


@pytest.mark.parametrize("kind", ["snapshot", "memory"])
def test_sinks(spark, tmp_path, kind):
    path = str(tmp_path / "table")
    if kind == "snapshot":
        df = spark.createDataFrame([("T", dt.date(2024, 1, 1 + k // 2), k, dt.datetime(2024, 1, 1, k)) for k in range(8)],
                                   "ticker string, snapshot_date date, n_contracts_used int, fetched_at timestamp")
        sink, key = jobs.snapshot_sink(path), "n_contracts_used"
    else:
        df = spark.createDataFrame([(1, k, "user", f"m{k}") for k in range(8)], "conv_id int, turn int, role string, text string")
        sink, key = jobs.memory_sink(path, 4), "turn"
    s = stream(spark, [df.filter(f"{key} < 5"), df.filter(f"{key} >= 5")], tmp_path, df.schema)
    q = s.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted(r[key] for r in spark.read.parquet(path).collect())
    assert got == ([1, 3, 5, 7] if kind == "snapshot" else [4, 5, 6, 7])
