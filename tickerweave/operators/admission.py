"""Sliding-window admission: at most `limit` admitted events per key within the last `window` seconds.

Denied events are not recorded, so each decision depends on the earlier ones.
Most events do not need that chain:

* an event with at most `limit` events of its key in its window is admitted
  whatever happened before ("free");
* when all events of its window are free, the window content is known exactly.

Both facts are found by range frames over (key, period) partitions with a halo,
so a key that holds most of the rows is spread over its periods. Only the rest,
with the free events their windows reach back to, is replayed in order, run by
run, as a sorted stream with at most `limit` instants in memory. A run in which
a key stays saturated is one chain by definition.
"""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PERIODS = 8  # width of a partition in windows


def replay(frames, limit: int, span: int):
    """Decisions for rows sorted by (key, run, t, id); `ctx` rows are known to be admitted."""
    state, current = deque(), None
    for f in frames:
        ok, left = [], []
        for key, run, t, ctx in zip(f["key"], f["run"], f["t"], f["ctx"]):
            if (key, run) != current:
                current, state = (key, run), deque()
            while state and state[0] < t - span:
                state.popleft()
            if ctx or len(state) < limit:
                state.append(t)
                ok.append(True)
                left.append(max(0, limit - len(state)))
            else:
                ok.append(False)
                left.append(0)
        yield f.assign(allowed=ok, remaining=left)


def admit(events: DataFrame, key: str, ts: str, tie: str, limit: int = 60, window: int = 60) -> DataFrame:
    """events plus `allowed` and `remaining` (what the key has left after the event)."""
    span = window * 1_000_000
    width = PERIODS * span
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    e = events.select(F.col(key).alias("key"), F.col(ts).alias("ts"), F.col(tie).alias("id"), micros.alias("t"))
    home = F.floor(F.col("t") / width)
    # An event is also shown to the periods whose first windows reach back to it or whose last events look ahead to it.
    reach = F.sequence(F.floor((F.col("t") - span) / width), F.floor((F.col("t") + 3 * span) / width))
    p = e.withColumn("home", home).withColumn("b", F.explode(reach))
    part = Window.partitionBy("key", "b").orderBy("t")
    back, ahead, same = part.rangeBetween(-span, 0), part.rangeBetween(0, span), part.rangeBetween(0, 0)
    p = p.withColumns({"n": F.count(F.lit(1)).over(back), "dup": F.count(F.lit(1)).over(same)})
    p = p.withColumn("tight", ((F.col("n") > limit) | (F.col("dup") > 1)).cast("int"))
    p = p.withColumn("busy", F.max("tight").over(back))
    p = p.withColumn("near", F.max("busy").over(ahead))
    p = p.withColumn("linked", F.sum("near").over(back)).filter("b = home")
    known = p.filter("busy = 0").select("key", "id", "ts", F.lit(True).alias("allowed"), (F.lit(limit) - F.col("n")).cast("int").alias("remaining"))
    chain = p.filter("near = 1")
    # A run starts where no other event of the chain lies within the window before.
    chain = chain.withColumn("s", F.when(F.col("linked") == 1, F.col("t")))
    inside = Window.partitionBy("key", "b").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0)
    tails = chain.groupBy("key", "b").agg(F.max("s").alias("s"))
    before = Window.partitionBy("key").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    carry = tails.select("key", "b", F.max("s").over(before).alias("c"))
    chain = chain.withColumn("s", F.max("s").over(inside)).join(carry, ["key", "b"])
    chain = chain.select("key", F.coalesce("s", "c", F.lit(0)).alias("run"), "t", "id", "ts", (F.col("busy") == 0).alias("ctx"))
    # Row batches of one run arrive in order; a run never spans two partitions.
    lined = chain.repartition("key", "run").sortWithinPartitions("key", "run", "t", "id")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chain.schema)
    done = lined.mapInPandas(lambda fr: replay(fr, limit, span), fields + ", allowed boolean, remaining int")
    decided = done.filter("NOT ctx").select("key", "id", "ts", "allowed", "remaining")
    return known.unionByName(decided).select(
        F.col("key").alias(key), F.col("id").alias(tie), F.col("ts").alias(ts), "allowed", "remaining"
    )


def admit_pandas(df: pd.DataFrame, limit: int, window: int) -> list[bool]:
    """Plain sequential rule for one key (seconds); the yardstick of the tests."""
    state, out = deque(), []
    for t in df:
        while state and state[0] < t - window:
            state.popleft()
        out.append(len(state) < limit)
        if out[-1]:
            state.append(t)
    return out
