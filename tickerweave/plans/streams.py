"""Registered batch runs of the streaming operators."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tickerweave.functions.core import rnd
from tickerweave.operators import fusion, news
from tickerweave.operators.admission import admit
from tickerweave.plans import inputs as i
from tickerweave.plans.inputs import r
from tickerweave.plans.news import _CLEAN, _DEDUP
from tickerweave.operators.blocks import checkpoint_folder
from tickerweave.plans.inputs import with_ctes
from tickerweave.plans.technical import _cols, feature_sql
from tickerweave.sources.bars import BAR_SCHEMA
from tickerweave.streaming import jobs

LIMIT, DAY = 3, 86_400


def _admission(spark, sf):
    """Three requests per user and day."""
    e = i.read(spark, sf, "events").select("user_id", "ts", "event_id")
    a = admit(e, "user_id", "ts", "event_id", LIMIT, DAY)
    return a.select("user_id", "event_id", F.col("allowed").cast("int").alias("allowed"), "remaining")


_ADMISSION_SQL = f"""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
step AS (
  SELECT user_id, event_id, rn, t, 1 AS allowed, [t] AS st FROM e WHERE rn = 1
  UNION ALL
  SELECT e.user_id, e.event_id, e.rn, e.t,
    CASE WHEN len(list_filter(st, lambda x: x >= e.t - {DAY * 1_000_000})) < {LIMIT} THEN 1 ELSE 0 END,
    CASE WHEN len(list_filter(st, lambda x: x >= e.t - {DAY * 1_000_000})) < {LIMIT}
      THEN list_append(list_filter(st, lambda x: x >= e.t - {DAY * 1_000_000}), e.t) ELSE list_filter(st, lambda x: x >= e.t - {DAY * 1_000_000}) END
  FROM step JOIN e ON e.user_id = step.user_id AND e.rn = step.rn + 1)
SELECT user_id, event_id, CAST(allowed AS INTEGER) AS allowed, CAST(CASE WHEN allowed = 1 THEN {LIMIT} - len(st) ELSE 0 END AS INTEGER) AS remaining FROM step"""


def _tick_bars(spark, sf):
    e = i.read(spark, sf, "events")
    t = e.select(F.col("event_type").alias("ticker"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("id"),
                 F.col("value").alias("price"), F.lit(1.0).alias("size"))
    b = jobs.bars_from_ticks(t)
    return b.select("ticker", F.col("start").cast("timestamp_ntz").alias("start"), *[rnd(c).alias(c) for c in ("open", "high", "low", "close", "volume")], "n_ticks")


_TICK_SQL = f"""SELECT event_type AS ticker, date_trunc('hour', ts) AS start, {r('arg_min(value, struct_pack(a := ts, b := event_id))')} AS open, {r('max(value)')} AS high,
  {r('min(value)')} AS low, {r('arg_max(value, struct_pack(a := ts, b := event_id))')} AS close, {r('count(*)::DOUBLE')} AS volume, count(*) AS n_ticks
  FROM events WHERE value IS NOT NULL GROUP BY 1, 2"""


def _first_news(spark, sf):
    n = news.clean_news(i.raw_news(spark, sf))
    return jobs.first_news(n, order=("query_idx", "result_idx")).select("ticker", "fingerprint", "doc_id")


def _session(spark, sf):
    m = fusion.last_messages(i.read(spark, sf, "conversations"))
    return m.groupBy("conv_id").agg(F.count(F.lit(1)).alias("messages"), F.max("turn_count").alias("turns"), F.max("turn").alias("last_turn"))


_STEPPED = ["macd", "macd_signal", "rsi_14", "obv"]


def _incremental(spark, sf):
    """The bars as a stream, read to its end: every ticker's state steps from bar to bar."""
    folder = f"{checkpoint_folder(spark)}/bar-stream-{uuid.uuid4().hex}"
    i.bars(spark, sf).write.parquet(f"{folder}/bars")
    bars = spark.readStream.schema(BAR_SCHEMA).parquet(f"{folder}/bars")
    out = jobs.incremental_indicators(bars)
    sink = out.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{folder}/progress")
    sink.trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out").select(*_cols(_STEPPED))


QUERIES = {
    "r01_admission": _admission,
    "r02_tick_bars": _tick_bars,
    "r03_incremental_indicators": _incremental,
    "r04_first_news": _first_news,
    "r06_session_memory": _session,
}
ORACLES = {
    "r01_admission": _ADMISSION_SQL,
    "r02_tick_bars": _TICK_SQL,
    "r03_incremental_indicators": feature_sql(_STEPPED),
    "r04_first_news": with_ctes(i.NEWS, _CLEAN, _DEDUP, select="SELECT ticker, fingerprint, doc_id FROM uniq"),
    "r06_session_memory": """WITH k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations)
      SELECT conv_id, count(*) AS messages, count(*) // 2 AS turns, max(turn) AS last_turn FROM k WHERE rn <= 20 GROUP BY conv_id""",
}
