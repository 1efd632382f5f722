"""Near-duplicate vectors: tiles compared along principal axes, cut off by a bound on what the other axes can add."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerweave.llm.common import components, cut, lookup, write_once

#: Most rows of a block; a task holds two blocks.
BLOCK_ROWS = 16_384
#: Fewest blocks, so that small tables still spread over a cluster.
LEAST_BLOCKS = 8
TILE = 1024
#: Axes after which the bound is checked, then the rest.
STEPS = (16, 32)
#: Rounding slack of the bound; whatever passes it is decided by the vectors themselves.
SLACK = 1e-9


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision, without overflow."""
    x = vectors.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _matrix(column) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)


def principal_axes(rows: DataFrame, dim: int) -> np.ndarray:
    """Orthogonal matrix whose columns are the axes of the unit vectors by falling variance, from sums over all rows."""

    def moments(batches):
        total = np.zeros((dim, dim))
        for batch in batches:
            x = unit(_matrix(batch.column(0)))
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim * dim)), pa.array(total.ravel())], names=["cell", "value"])

    cells = rows.select("vec").mapInArrow(moments, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("v")).collect()
    matrix = np.zeros(dim * dim)
    for cell, value in cells:
        matrix[cell] = value
    return np.linalg.eigh(matrix.reshape(dim, dim))[1][:, ::-1] if cells else np.eye(dim)


def tile_links(x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows of x and y with cosine >= least; px and py are x and y along the principal axes.

    The first axes of all pairs are one product, with the norms of the rest as one more column, so that
    it is the bound itself. Pairs that the bound leaves gather further axes and fall away when it does.
    """
    dim = x.shape[1]
    marks = [s for s in STEPS if s < dim]
    if not marks:
        return np.nonzero(x @ y.T >= least)
    rest = lambda p, k: np.sqrt(np.einsum("ij,ij->i", p[:, k:], p[:, k:]))
    first = marks[0]
    bound = np.c_[px[:, :first], rest(px, first)] @ np.c_[py[:, :first], rest(py, first)].T
    i, j = np.nonzero(bound >= least - SLACK)
    if len(i) > 0.1 * bound.size:  # a dense tile: the whole product costs less than gathering
        return np.nonzero(x @ y.T >= least)
    so_far = bound[i, j] - rest(px, first)[i] * rest(py, first)[j]
    for a, b in zip(marks, [*marks[1:], dim], strict=True):
        so_far = so_far + np.einsum("ij,ij->i", px[i, a:b], py[j, a:b])
        left = so_far + (rest(px, b)[i] * rest(py, b)[j] if b < dim else 0) >= least - SLACK
        i, j, so_far = i[left], j[left], so_far[left]
    sure = np.einsum("ij,ij->i", x[i], y[j]) >= least
    return i[sure], j[sure]


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Smallest index each of n nodes reaches over the pairs."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.9,
                 block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id_col, n_links, component_id, kept): one row per row of vectors.

    Equal vectors are one class with a weight. Classes are dealt by hash over blocks; each pair of blocks
    is one group of bounded size, compared tile by tile (tile_links), exactly. A task returns how many
    links each class has and, per tile, a forest of the linked classes instead of the links, so a large
    group of near copies costs products but no rows.

    Cosine is taken in double precision. NULL and zero vectors, and such with NULL or non-finite
    components, link with nothing, nor do vectors of different lengths; a row with a NULL id neither: 0
    links, component_id NULL, kept true. Repeated rows are vectors of their own that link; rows that
    share an id share a component. An empty table gives an empty table. Other columns are not read.
    """
    v = F.col(vector_col)
    odd = F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    some = F.exists(v, lambda e: e != 0)
    good = F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~odd & some
    rows = vectors.withColumn("id", F.col(id_col).cast("long")).select("id", F.when(good, v).alias("vec"))
    rows = rows.withColumn("k1", F.xxhash64("vec")).withColumn("k2", F.xxhash64(F.lit("vector"), "vec"))
    usable = rows.filter("vec IS NOT NULL")
    named = usable.groupBy("k1", "k2").agg(F.min("id").alias("node"), F.max("id").alias("top"), F.count(F.lit(1)).alias("w"))
    named = cut(named)
    heads = usable.join(named.select("k1", "k2", F.col("node").alias("id"), "w"), ["k1", "k2", "id"]).dropDuplicates(["k1", "k2"])
    heads = write_once(heads.withColumnRenamed("id", "node"), "vectors")

    sizes = heads.groupBy(F.size("vec").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    dim, n = (sizes[0]["dim"], heads.count()) if sizes else (1, 0)
    axes = principal_axes(heads.filter(F.size("vec") == dim), dim)
    blocks = max(LEAST_BLOCKS, -(-n // block_rows))
    block = F.pmod(F.xxhash64(F.lit("block"), "k1"), F.lit(blocks)).cast("int")
    dealt = heads.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = dealt.select("k1", "k2", "node", "w", "vec", "block", F.least("block", "other").alias("i"),
                         F.greatest("block", "other").alias("j"), F.size("vec").alias("dim"))

    def compare(key, group):
        i, j, size = (k.as_py() for k in key)
        side = group["block"].to_numpy()
        order = np.argsort(side, kind="stable")
        cut_at = int((side == i).sum())
        x = unit(_matrix(group["vec"]))[order]
        p = x @ axes if size == dim else x
        k1, k2, node, w = (group[c].to_numpy()[order] for c in ("k1", "k2", "node", "w"))
        links = np.zeros(len(x), np.int64)
        ends_a, ends_b = [], []
        left = range(0, cut_at if i != j else len(x), TILE)
        for a in left:
            a_end = min(a + TILE, cut_at if i != j else len(x))
            for b in range(a if i == j else cut_at, len(x), TILE):
                b_end = min(b + TILE, len(x))
                r, c = tile_links(x[a:a_end], x[b:b_end], p[a:a_end], p[b:b_end], least)
                if i == j and a == b:
                    r, c = r[r < c], c[r < c]
                if len(r):
                    r, c = r + a, c + b
                    np.add.at(links, r, w[c])
                    np.add.at(links, c, w[r])
                    near = np.unique(np.r_[r, c])
                    root = _forest(np.searchsorted(near, r), np.searchsorted(near, c), len(near))
                    ends_a.append(near)
                    ends_b.append(near[root])
        has = np.flatnonzero(links)
        a = np.concatenate(ends_a) if ends_a else np.empty(0, np.int64)
        b = np.concatenate(ends_b) if ends_b else np.empty(0, np.int64)
        tie = np.unique(np.c_[a, b][a != b], axis=0)
        nothing = np.zeros(len(tie), np.int64)
        return pa.table({
            "k1": np.r_[k1[has], nothing], "k2": np.r_[k2[has], nothing], "links": np.r_[links[has], nothing],
            "a": np.r_[np.zeros(len(has), np.int64), node[tie[:, 0]]], "b": np.r_[np.zeros(len(has), np.int64), node[tie[:, 1]]],
        })

    found = write_once(dealt.groupBy("i", "j", "dim").applyInArrow(compare, "k1 long, k2 long, links long, a long, b long"), "vector-links")
    counts = found.filter("links > 0").groupBy("k1", "k2").agg(F.sum("links").alias("links"))
    ties = found.filter("links = 0").select("a", "b")
    # Ids with several vectors: every class that holds one is tied to it.
    several = usable.groupBy("id").agg(F.min("k1").alias("x"), F.max("k1").alias("y")).filter("x < y").select("id")
    ties = ties.union(usable.join(several, "id").select("id", "k1", "k2").distinct().join(named, ["k1", "k2"]).select("node", "id"))
    label = components(ties)
    classes = named.join(counts, ["k1", "k2"], "left").join(label.withColumnRenamed("node", "at"), F.col("node") == F.col("at"), "left")
    classes = cut(classes.select("k1", "k2", "w", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("links"),
                                 F.coalesce("component", "node").alias("component")))
    # Rows without a usable vector are spread by their id and find no class.
    bare = F.col("vec").isNull()
    rows = rows.select("id", F.when(bare, F.xxhash64("id")).otherwise(F.col("k1")).alias("k1"),
                       F.when(bare, 0).otherwise(F.col("k2")).alias("k2"))
    out = lookup(rows, classes, ("k1", "k2"), "w", ["links", "component"], F.xxhash64("id", "k1"))
    whole = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
                      whole.alias("component_id"), F.coalesce(F.col("id") == whole, F.lit(True)).alias("kept"))
