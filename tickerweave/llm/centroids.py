"""Centroid clustering: exact rounds of k-means whose searches run coarse to fine over Walsh-Hadamard coefficients.

The transform keeps squared distances but for a factor, and integers stay integers. Its first coefficients, those of the
rows with the fewest changes of sign, hold most of what tells vectors apart, so a partial sum of squared differences soon
exceeds the whole distance to another centroid; a centroid is out only when it is strictly worse.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerweave.llm.common import write_once

SIZE = 64
#: Integer components up to this size keep every sum below 63 bits; others are worked on as whole numbers of any length.
SMALL = 1 << 24
#: Coefficients after which centroids are eliminated.
STEPS = [4, 8, 16, 32, SIZE]
_LIMB = 32


def _coarse_to_fine() -> np.ndarray:
    """Places of the rows of the Hadamard matrix in the order of their changes of sign."""
    h = np.ones((1, 1), np.int64)
    while len(h) < SIZE:
        h = np.block([[h, h], [h, -h]])
    return np.argsort((np.diff(h, axis=1) != 0).sum(axis=1), kind="stable")


_ORDER = _coarse_to_fine()
_BACK = np.argsort(_ORDER)


def _butterfly(x: np.ndarray) -> np.ndarray:
    x = x.copy()
    step = 1
    while step < SIZE:
        y = x.reshape(len(x), SIZE // (2 * step), 2, step)
        a, b = y[:, :, 0, :] + y[:, :, 1, :], y[:, :, 0, :] - y[:, :, 1, :]
        x = np.stack([a, b], axis=2).reshape(len(x), SIZE)
        step *= 2
    return x


def transform(x: np.ndarray) -> np.ndarray:
    """Coefficients of the rows of x (n, 64), coarse to fine; integers of int64 or of any length (object)."""
    return _butterfly(x)[:, _ORDER]


def inverse(c: np.ndarray) -> np.ndarray:
    """What transform made c from."""
    return _butterfly(c[:, _BACK]) // SIZE


def search(coefs: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, 64 times the squared distance) of each row of coefs; ties go to the smaller number.

    After the first coefficients the best centroid so far is finished, which bounds the distance from above. In each later
    step only the pairs that are not strictly worse than that bound are carried on, and those left finish all 64.
    """
    n, first = len(coefs), STEPS[0]
    so_far = sum((coefs[:, k, None] - centroids[None, :, k]) ** 2 for k in range(first))
    guess = so_far.argmin(axis=1)
    rest = coefs[:, first:] - centroids[guess, first:]
    bound = so_far[np.arange(n), guess] + (rest * rest).sum(axis=1)
    row, centroid = np.nonzero(so_far <= bound[:, None])
    total = so_far[row, centroid]
    for a, b in zip(STEPS, STEPS[1:]):
        gap = coefs[row, a:b] - centroids[centroid, a:b]
        total = total + (gap * gap).sum(axis=1)
        keep = total <= bound[row]
        row, centroid, total = row[keep], centroid[keep], total[keep]
    starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if n else np.empty(0, np.int64)
    least = np.minimum.reduceat(total, starts) if n else total
    best = np.flatnonzero(total == least[np.searchsorted(starts, np.arange(len(row)), side="right") - 1])
    best = best[np.searchsorted(row[best], np.arange(n), side="left")]  # pairs stand by row and number: the first is the smaller
    return centroid[best], total[best]


def _whole(x: float) -> int:
    """floor(256 * x) of any finite double."""
    return int(x) * 256 if abs(x) >= 1 << 53 else math.floor(256.0 * x)


def _coefs(batch: pa.RecordBatch):
    """(places of rows, coefficients) of the rows with small components, then of the others."""
    small = batch.column("coefs")
    there = np.flatnonzero(small.is_valid().to_numpy(zero_copy_only=False))
    if len(there):
        yield there, small.drop_null().flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, SIZE)
    large = np.flatnonzero(small.is_null().to_numpy(zero_copy_only=False))
    if len(large):
        rows = [[_whole(x) for x in r] for r in batch.column("large").take(pa.array(large)).to_pylist()]
        yield large, transform(np.array(rows, dtype=object).reshape(-1, SIZE))


def _search(coefs: np.ndarray, centroids: list[list[int]]):
    """search with whole numbers of any length where 64 bits might not do."""
    c = transform(np.array(centroids, dtype=object).reshape(-1, SIZE))
    if coefs.dtype == object or max(abs(v) for v in c.flat) > SMALL * SIZE:
        return search(coefs.astype(object), c)
    return search(coefs, c.astype(np.int64))


def kept_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, coefs, large): vectors of 64 finite components as coefficients of floor(256 x); large holds the components
    instead where they exceed SMALL. Written once, because every round reads it."""
    v = F.col(vector_col).cast("array<double>")
    whole = (F.size(v) == SIZE) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.filter(F.col(vector_col).isNotNull() & whole).select(F.col(id_col).alias("vec_id"), v.alias("v"))

    def turn(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, SIZE)
            is_large = (np.abs(x) * 256 >= SMALL).any(axis=1)
            c = transform(np.floor(256.0 * np.where(is_large[:, None], 0.0, x)).astype(np.int64))
            mask = pa.array(is_large)
            flat = lambda a, kind, hide: pa.ListArray.from_arrays(
                pa.array(np.arange(len(a) + 1, dtype=np.int32) * SIZE), pa.array(a.ravel(), kind), mask=hide)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), flat(c.astype(np.int32), pa.int32(), mask), flat(x, pa.float64(), pa.array(~is_large))], names=["vec_id", "coefs", "large"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    return write_once(rows.mapInArrow(turn, f"vec_id {kind}, coefs array<int>, large array<double>"), "walsh")


def seeds(rows: DataFrame, k: int, salt: str) -> list[list[int]]:
    """Components of the k vectors whose `salt:id` has the smallest SHA-256; only k rows reach the driver."""
    key = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    out = []
    for r in rows.orderBy(key, "coefs", "large").limit(k).select("coefs", "large").collect():
        if r["coefs"] is None:
            out.append([_whole(x) for x in r["large"]])
        else:
            out.append([int(v) for v in inverse(np.array([r["coefs"]], dtype=object))[0]])
    return out


def _limbs(total: np.ndarray) -> dict[int, list[int]]:
    """Whole numbers of any length as signed digits of 32 bits, so that longs can add them up exactly."""
    out: dict[int, list[int]] = {}
    rest, k = [int(t) for t in total], 0
    while k == 0 or any(rest):
        out[k] = [(abs(r) & ((1 << _LIMB) - 1)) * (1 if r >= 0 else -1) for r in rest]
        rest = [(abs(r) >> _LIMB) * (1 if r >= 0 else -1) for r in rest]
        k += 1
    return out


def move(rows: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """One round: every vector to its nearest centroid, then every non-empty centroid to the floor of its vectors' mean.

    Tasks add up their vectors per centroid; what is shuffled are sums, and at most a few rows per centroid reach the driver.
    """

    def add_up(batches):
        count = [0] * len(centroids)
        total = [np.zeros(SIZE, dtype=object) for _ in centroids]
        for batch in batches:
            for _, coefs in _coefs(batch):
                cluster, _ = _search(coefs, centroids)
                for c in np.unique(cluster):
                    its = cluster == c
                    count[c] += int(its.sum())
                    total[c] = total[c] + coefs[its].sum(axis=0)
        out = [(c, k, count[c] if k == 0 else 0, v) for c in range(len(centroids)) if count[c] for k, v in _limbs(total[c]).items()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.int64()),
             pa.array([o[3] for o in out], pa.list_(pa.int64()))], names=["cluster", "limb", "n", "v"])

    parts = rows.mapInArrow(add_up, "cluster int, limb int, n long, v array<long>")
    sums = parts.groupBy("cluster", "limb").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("v")[k]) for k in range(SIZE)]).alias("v"))
    count, total = {}, {}
    for r in sums.collect():
        count[r["cluster"]] = count.get(r["cluster"], 0) + r["n"]
        more = np.array([int(v) << _LIMB * r["limb"] for v in r["v"]], dtype=object)
        total[r["cluster"]] = total.get(r["cluster"], 0) + more
    return [[int(v) // count[c] for v in inverse(total[c][None, :])[0]] if c in count else old for c, old in enumerate(centroids)]


def assign(rows: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """(vec_id, cluster, distance) of every row; a squared distance beyond a long is NULL."""

    def place(batches):
        for batch in batches:
            cluster, far = np.zeros(batch.num_rows, np.int32), [None] * batch.num_rows
            for places, coefs in _coefs(batch):
                c, total = _search(coefs, centroids)
                cluster[places] = c
                for p, t in zip(places, total):
                    d = int(t) // SIZE
                    far[p] = d if d < 1 << 63 else None
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(cluster), pa.array(far, pa.int64())], names=["vec_id", "cluster", "distance"])

    return rows.mapInArrow(place, f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, cluster int, distance long")


def _sum(c: Column) -> Column:
    """Sum of longs, NULL where it does not fit one or a part is missing."""
    return F.when(F.count_if(c.isNull()) == 0, F.sum(c.cast("decimal(38,0)")).try_cast("long"))


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, salt: str = "2", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector with 64 finite components.

    Vectors that are NULL, of another length or hold a NULL or non-finite component are left out. Rows that repeat an id
    are vectors of their own; a NULL id counts as the empty text among the first centroids; equal hashes are ordered by
    components. With fewer than k vectors there are as many centroids as vectors, and an empty table gives no rows.
    Distances and sums beyond a long are NULL; all arithmetic is exact. Other columns play no part.

    The vectors are written once as coefficients. Each round is one pass over them; the k centroids, 64 numbers each, travel
    with the tasks, and only k sums come back.
    """
    rows = kept_vectors(vectors, id_col, vector_col)
    centroids = seeds(rows, k, salt)
    for _ in range(rounds if centroids else 0):
        centroids = move(rows, centroids)
    placed = write_once(assign(rows, centroids), "placed") if centroids else assign(rows, [[0] * SIZE])
    per = placed.groupBy("cluster").agg(_sum(F.col("distance")).alias("inertia")).collect()  # at most k rows
    inertia = {r["cluster"]: r["inertia"] for r in per}
    whole = None if None in inertia.values() else sum(inertia.values())
    whole = whole if whole is not None and whole < 1 << 63 else None
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    listed = lambda values, kind: F.array(*[F.lit(v).cast(kind) for v in values]).cast(f"array<{kind}>")[F.col("cluster")]
    return placed.select("vec_id", "cluster", "distance", listed([inertia.get(c) for c in range(len(names))], "long").alias("cluster_inertia"),
                         F.lit(whole).cast("long").alias("inertia"), listed(names, "string").alias("centroid_sha256"))
