"""Near-duplicate documents: min-max hashing of word shingles, links confirmed on whole sets, groups by reachability."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tickerweave.llm.common import components, cut, lookup, write_once

SEED = 20240607
#: Words whose hashes a task remembers before it starts again.
REMEMBER = 400_000

#: Classes in a tile; a task compares two tiles.
TILE = 256

_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    """Word to 64-bit hash, bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBER:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None, size: int, words: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of `size` words; the whole of a shorter text; none without words."""
    hashed = [words[w] for w in (text or "").encode("utf-8", "surrogatepass").lower().split()]
    if not hashed:
        return np.empty(0, np.uint64)
    h = np.array(hashed, np.uint64)
    runs = max(1, len(h) - size + 1)
    out = np.zeros(runs, np.uint64)
    for k in range(min(size, len(h))):
        out = _mixed(out + h[k : k + runs] * np.uint64(2 * k + 1))
    return np.unique(_mixed(out + np.uint64(min(size, len(h)))))


class MinMax:
    """Signature by min-max hashing: each permutation is evaluated once and gives its minimum and its maximum.

    A band joins two minima and two maxima of four different permutations.
    """

    def __init__(self, permutations: int):
        draw = np.random.default_rng(SEED)
        self.a = draw.integers(1, 2**63, permutations, dtype=np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
        self.b = draw.integers(1, 2**63, permutations, dtype=np.uint64)[:, None]

    def signature(self, shingle: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low = high = None
        for k in range(0, len(shingle), 2048):
            h = self.a * shingle[None, k : k + 2048] + self.b
            least, most = h.min(axis=1), h.max(axis=1)
            low = least if low is None else np.minimum(low, least)
            high = most if high is None else np.maximum(high, most)
        return low, high

    def bands(self, shingle: np.ndarray) -> np.ndarray:
        low, high = self.signature(shingle)
        half = np.roll(high, -len(high) // 2)
        out = np.zeros(len(low) // 2, np.uint64)
        for part in (low[0::2], low[1::2], half[0::2], half[1::2]):
            out = _mixed(out + part)
        return out


def _id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))


def signatures(docs: DataFrame, id_col: str, text_col: str, size: int, permutations: int) -> DataFrame:
    """(id, n_shingles, k1, k2, bands) per row: k1 and k2 name the set, and are NULL for an empty one."""

    def sign(batches):
        words, family = _Words(), MinMax(permutations)
        for batch in batches:
            n, k1, k2, bands = [], [], [], []
            for text in batch.column(1).to_pylist():
                s = shingles(text, size, words)
                n.append(len(s))
                if len(s):
                    key = xxhash.xxh3_128_digest(s.tobytes())
                    a, b = np.frombuffer(key, np.int64)
                    k1.append(int(a))
                    k2.append(int(b))
                    bands.append(family.bands(s).view(np.int64))
                else:
                    k1.append(None)
                    k2.append(None)
                    bands.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()),
                 pa.array(bands, pa.list_(pa.int64()))], names=["id", "n_shingles", "k1", "k2", "bands"])

    rows = _id_and_text(docs, id_col, text_col)
    return rows.mapInArrow(sign, "id long, n_shingles long, k1 long, k2 long, bands array<long>")


def shingle_sets(rows: DataFrame, size: int) -> DataFrame:
    """(id, shingles) of rows (id, text)."""

    def make(batches):
        words = _Words()
        for batch in batches:
            texts = batch.column(1)
            for at in range(0, len(texts), 256):
                sets = [shingles(t, size, words).view(np.int64) for t in texts[at : at + 256].to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[at : at + 256], pa.array(sets, pa.list_(pa.int64()))], names=["id", "shingles"])

    return rows.mapInArrow(make, "id long, shingles array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of which 100 * intersection >= percent * union on the whole sets."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(left, "a").join(right, "b")
    shared = both.select("a", "b", (F.size("sa") + F.size("sb")).alias("total"), F.size(F.array_intersect("sa", "sb")).alias("shared"))
    return shared.filter(F.col("shared") * 100 >= (F.col("total") - F.col("shared")) * percent).select("a", "b")


def _tile_links(key, rows: pa.Table, percent: int) -> pa.Table:
    """Links among the classes of two tiles of a candidate group that join what was apart.

    Pairs that share a band are confirmed on their whole sets, unless links found so far connect them already.
    """
    i, j = key[1].as_py(), key[2].as_py()
    ids, c, tile = (rows[n].to_numpy() for n in ("id", "c", "tile"))
    bands = np.array(rows["bands"].to_pylist(), np.int64)
    column = rows["shingles"].combine_chunks()
    sizes = np.array([len(s) for s in column], np.int64)
    known: dict[int, frozenset] = {}
    root = {int(x): int(x) for x in c}

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    def whole(k):
        if k not in known:
            known[k] = frozenset(column[k].values.to_numpy().tolist())
        return known[k]

    left, right = np.flatnonzero(tile == i), np.flatnonzero(tile == j)
    found = []
    for a in left:
        others = right[right > a] if i == j else right
        near = (bands[others] == bands[a]).any(axis=1) & (c[others] != c[a])
        near &= 100 * np.minimum(sizes[others], sizes[a]) >= percent * np.maximum(sizes[others], sizes[a])
        for b in others[near]:
            x, y = find(int(c[a])), find(int(c[b]))
            if x == y:
                continue
            shared = len(whole(a) & whole(b))
            if 100 * shared >= percent * (int(sizes[a]) + int(sizes[b]) - shared):
                root[max(x, y)] = min(x, y)
                found.append((ids[a], ids[b]))
    return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 75,
                    permutations: int = 64) -> DataFrame:
    """(id_col, n_shingles, component_id, kept): one row per row of docs.

    Equal sets are one class, named by its smallest id; only classes are compared. Bands bring
    candidates into buckets. Each class is compared with the smallest class it shares a bucket with, which joins
    most groups of true copies at one comparison per class. Groups that candidate pairs connect but links
    do not are then compared tile by tile: a task tests every pair of two tiles that shares a band and is still
    apart, and returns only links that join something, so no pairs are emitted and no candidate is lost. A link needs 100 * intersection >= percent * union on the whole sets. With 64
    permutations (128 values, 32 bands of 4) a pair at 75 % misses every bucket with a chance of
    about 5 in a million. Buckets and classes that hold a large share of all rows are counted with
    partial sums and looked up by broadcast.

    NULL, empty and blank texts: no shingles, linked with nothing. A row with a NULL id is compared
    with nothing: component_id NULL, kept true. Rows that share an id are one node, so they share a
    component; repeated rows give repeated results. An empty table gives an empty table. Columns
    other than the two named are not read.
    """
    signed = write_once(signatures(docs, id_col, text_col, size, permutations), "signatures")
    full = signed.filter("id IS NOT NULL AND k1 IS NOT NULL")
    classes = cut(full.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")))

    # One row per class and band; classes that share a smallest id stay apart by their bands.
    heads = full.join(classes.select("k1", "k2", F.col("rep").alias("id")), ["k1", "k2", "id"]).dropDuplicates(["k1", "k2", "id"])
    member = heads.select("id", F.posexplode("bands").alias("band", "hash")).select(
        F.col("hash").alias("k1"), F.col("band").cast("long").alias("k2"), "id")
    buckets = member.groupBy("k1", "k2").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count(F.lit(1)).alias("n"))
    buckets = cut(buckets.filter("first < last").drop("last"))
    member = lookup(member, buckets, ("k1", "k2"), "n", ["first"], F.xxhash64("id")).filter("first IS NOT NULL")
    member = write_once(member, "bucket-members")

    asked = member.select("id").distinct()
    texts = _id_and_text(docs, id_col, text_col).join(asked, "id")
    sets = shingle_sets(texts, size).join(heads.select("id"), "id", "left_semi")
    sets = write_once(sets.dropDuplicates(["id", "shingles"]), "shingle-sets")

    # One pivot per class, the smallest first member of its buckets: a link to it joins most groups of copies.
    pivot = cut(member.groupBy("id").agg(F.min("first").alias("pivot")))
    tested = pivot.filter("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b"))
    links = cut(confirmed(tested, sets, percent))
    # Buckets connect their members' pivots; most buckets of a group have the same.
    ends = member.select("id", "first").distinct().join(pivot, "id").select("first", F.col("pivot").alias("b")).distinct()
    ends = ends.join(pivot.withColumnRenamed("id", "first"), "first").select(F.col("pivot").alias("a"), "b").filter("a <> b")
    several = full.groupBy("id").agg(F.min("k1").alias("x"), F.max("k1").alias("y")).filter("x < y").select("id")
    shared = full.join(several, "id").select("id", "k1", "k2").distinct().join(classes, ["k1", "k2"])
    links = links.union(shared.select(F.col("rep").alias("a"), F.col("id").alias("b")).filter("a <> b"))
    # What the first pivots leave apart: groups of classes that candidate pairs connect but links do not.
    label, group = components(links), components(tested.union(ends.distinct()))
    now = group.withColumnsRenamed({"node": "id", "component": "k1"}).withColumn("k2", F.lit(""))
    now = now.join(label, now.id == label.node, "left").select("id", "k1", "k2", F.coalesce("component", "id").alias("c"))
    now = cut(now)
    apart = now.groupBy("k1", "k2").agg(F.min("c").alias("x"), F.max("c").alias("y"), F.count(F.lit(1)).alias("n"))
    apart = cut(apart.filter("x < y").select("k1", "k2", "n", F.ceil(F.col("n") / TILE).cast("int").alias("tiles")))
    rest = lookup(now, apart, ("k1", "k2"), "n", ["tiles"], F.xxhash64("id")).filter("tiles IS NOT NULL")
    rest = rest.join(sets, "id").join(heads.select("id", "bands"), "id")
    rest = rest.withColumn("tile", F.pmod(F.xxhash64("id"), "tiles").cast("int"))
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rest = rest.select("k1", "id", "c", "shingles", "bands", "tile", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"))
    more = rest.groupBy("k1", "i", "j").applyInArrow(lambda key, rows: _tile_links(key, rows, percent), "a long, b long")
    links = cut(links.union(more))
    label = components(links)

    classes = classes.join(label, classes.rep == label.node, "left").select(
        "k1", "k2", "n", F.coalesce("component", "rep").alias("component"))
    rows = signed.withColumn("k1", F.coalesce("k1", F.xxhash64("id"))).withColumn("k2", F.coalesce("k2", F.lit(0)))
    out = lookup(rows, cut(classes), ("k1", "k2"), "n", ["component"], F.xxhash64("id"))
    whole = F.when(F.col("id").isNotNull(), F.coalesce(F.when(F.col("n_shingles") > 0, F.col("component")), F.col("id")))
    return out.select(F.col("id").alias(id_col), "n_shingles", whole.alias("component_id"),
                      F.coalesce(F.col("id") == whole, F.lit(True)).alias("kept"))
