"""Structured Streaming counterparts of the batch operators. Each takes a streaming frame and returns one."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tickerweave.functions.text import fingerprint
from tickerweave.operators.fusion import last_messages
from tickerweave.sources.bars import trade_order
from tickerweave.sources.options import merge_snapshots, store_snapshots
from tickerweave.sources.store import overwrite_partitions, stored


def bars_from_ticks(ticks: DataFrame, width: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """OHLCV per ticker and tumbling window; ticks(ticker, ts, id, price, size) later than `delay` are dropped.

    A tick without a price is no tick.
    """
    ticks = ticks.filter(F.col("price").isNotNull())
    if ticks.isStreaming:
        ticks = ticks.withWatermark("ts", delay)
    order = trade_order("ts", "id")
    return ticks.groupBy("ticker", F.window("ts", width).alias("w")).agg(
        F.min_by("price", order).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", order).alias("close"),
        F.sum("size").alias("volume"),
        F.count(F.lit(1)).alias("n_ticks"),
    ).select("ticker", F.col("w.start").alias("start"), "open", "high", "low", "close", "volume", "n_ticks")


def admit_stream(requests: DataFrame, limit: int = 60, window: int = 60, delay: str = "10 minutes") -> DataFrame:
    """requests(key, ts, id): sliding-window admission with the admitted instants of each key as state.

    An idle key is forgotten once the watermark has passed its last window.
    """
    span = window * 1_000_000

    def step(key, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        kept = deque(state.get[0] if state.exists else [])
        rows = pd.concat(list(frames)).sort_values(["ts", "id"])
        ok = []
        for t in rows["ts"].astype("datetime64[us]").astype("int64"):
            while kept and kept[0] < t - span:
                kept.popleft()
            ok.append(len(kept) < limit)
            if ok[-1]:
                kept.append(t)
        state.update((list(kept),))
        last = kept[-1] // 1000 if kept else 0
        state.setTimeoutTimestamp(max(last + window * 1000, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame({"key": rows["key"].to_numpy(), "id": rows["id"].to_numpy(), "allowed": ok})

    kind = requests.schema["key"].dataType.simpleString()
    return requests.withWatermark("ts", delay).groupBy("key").applyInPandasWithState(
        step, f"key {kind}, id bigint, allowed boolean", "kept array<bigint>", "append", GroupStateTimeout.EventTimeTimeout
    )


INCREMENTAL_COLUMNS = "ticker string, date date, ema_12 double, ema_26 double, macd double, macd_signal double, rsi_14 double, obv double, vwap double"


def incremental_indicators(bars: DataFrame, idle: str | None = None) -> DataFrame:
    """EMA, MACD, RSI, OBV and VWAP bar by bar, with two dozen numbers of state per ticker.

    Bars of a ticker must arrive in date order across batches; inside a batch they are sorted. A missing value is a gap:
    a smoothed series keeps its value, and what came before the gap has aged by the rows in between when the next value
    comes; a change needs both of its closes; missing parts of OBV and VWAP add nothing. `idle`, a duration, drops the
    state of a ticker that has had no bar for that long; its next bar starts anew.
    """
    fields = ["prev", "fast", "slow", "age", "n", "signal", "gain", "loss", "d_age", "d_n", "obv", "pv", "vol"]
    idle_ms = None if idle is None else int(pd.Timedelta(idle) / pd.Timedelta(milliseconds=1))

    def smooth(old, new, alpha, age):
        """The smoothed value after `age` rows since the last one."""
        if old is None:
            return new
        left = (1 - alpha) ** age
        return (left * old + alpha * new) / (left + alpha)

    def step(key, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        s = dict(zip(fields, state.get)) if state.exists else {**dict.fromkeys(fields), **dict.fromkeys(["age", "n", "d_age", "d_n"], 0)}
        s = {k: None if isinstance(v, float) and v != v else v for k, v in s.items()}
        out = []
        for bar in pd.concat(list(frames)).sort_values("date").itertuples(index=False):
            high, low, close, volume = (None if v is None or v != v else float(v) for v in (bar.high, bar.low, bar.close, bar.volume))
            s["age"] += 1
            s["d_age"] += 1
            if close is not None:
                s["fast"], s["slow"] = smooth(s["fast"], close, 2 / 13, s["age"]), smooth(s["slow"], close, 2 / 27, s["age"])
                s["age"], s["n"] = 0, s["n"] + 1
            change = close - s["prev"] if close is not None and s["prev"] is not None else None
            if change is not None:
                for k, v in (("gain", max(change, 0.0)), ("loss", max(-change, 0.0))):
                    s[k] = smooth(s[k], v, 1 / 14, s["d_age"])
                s["d_age"], s["d_n"] = 0, s["d_n"] + 1
                if volume is not None:
                    s["obv"] = (s["obv"] or 0.0) + volume * ((change > 0) - (change < 0))
            s["obv"] = s["obv"] or 0.0
            macd = s["fast"] - s["slow"] if s["n"] else None
            if macd is not None:
                s["signal"] = smooth(s["signal"], macd, 2 / 10, 1)
            if volume is not None:
                s["vol"] = (s["vol"] or 0.0) + volume
                if None not in (high, low, close):
                    s["pv"] = (s["pv"] or 0.0) + (high + low + close) / 3 * volume
            s["prev"] = close
            rsi = 100 - 100 / (1 + s["gain"] / s["loss"]) if s["d_n"] >= 14 and s["loss"] > 0 else None
            vwap = s["pv"] / s["vol"] if s["pv"] is not None and s["vol"] else None
            out.append((bar.ticker, bar.date, s["fast"], s["slow"], macd, s["signal"], rsi, s["obv"], vwap))
        state.update(tuple(s[f] for f in fields))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        names = [c.split()[0] for c in INCREMENTAL_COLUMNS.split(", ")]
        yield pd.DataFrame(out, columns=names)

    counts = {"age", "n", "d_age", "d_n"}
    state = ", ".join(f"{f} {'bigint' if f in counts else 'double'}" for f in fields)
    timeout = GroupStateTimeout.NoTimeout if idle is None else GroupStateTimeout.ProcessingTimeTimeout
    return bars.groupBy("ticker").applyInPandasWithState(step, INCREMENTAL_COLUMNS, state, "append", timeout)


def first_news(news: DataFrame, delay: str = "3 days", order: tuple[str, ...] = ("published_at",)) -> DataFrame:
    """First article per ticker and title fingerprint; copies within the watermark are dropped.

    A finite table keeps the first copy by `order`, at a tie the smallest row as JSON.
    """
    df = news.withColumn("fingerprint", fingerprint("title"))
    if not news.isStreaming:
        line = Window.partitionBy("ticker", "fingerprint").orderBy(*order, F.to_json(F.struct(*news.columns)))
        return df.withColumn("__rank", F.row_number().over(line)).filter("__rank = 1").drop("__rank")
    return df.withWatermark("published_at", delay).dropDuplicatesWithinWatermark(["ticker", "fingerprint"])


def snapshot_sink(path: str):
    """foreachBatch function: merges each batch into the snapshot table; replaying a batch changes nothing."""

    def write(batch: DataFrame, _batch_id: int):
        one = merge_snapshots(batch, batch.limit(0))
        store_snapshots(batch.sparkSession, path, one)

    return write


def memory_sink(path: str, limit: int = 20, buckets: int = 64):
    """foreachBatch function: keeps the last messages of every conversation in a bucketed parquet table.

    Only the buckets of the conversations in the batch are read and rewritten.
    """

    def write(batch: DataFrame, _batch_id: int):
        spark = batch.sparkSession
        new = batch.select("conv_id", "turn", "role", "text", F.pmod(F.xxhash64("conv_id"), F.lit(buckets)).cast("int").alias("bucket"))
        # Of several messages for one turn the batch's comes before the stored one, and then the smallest.
        one = F.min(F.struct("role", "text")).alias("m")
        new = new.groupBy("conv_id", "turn", "bucket").agg(one).select("conv_id", "turn", "m.role", "m.text", "bucket")
        rows, old = new, stored(spark, path, new.schema, ("bucket",))
        if old is not None:
            old = old.join(new.select("bucket").distinct(), "bucket", "left_semi").select(new.columns)
            rows = old.join(new, ["conv_id", "turn"], "left_anti").select(new.columns).unionByName(new)
        overwrite_partitions(last_messages(rows, limit).select(new.columns), path, "bucket")

    return write
