"""Exact values at given ranks of many sets of numbers, by counting: no row is sorted, moved or stored."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells that a round cuts the ranges still in question into, over all sets.
CELLS = 1 << 15
#: So many values in question are told apart one by one; the driver gets no more rows than this or the cells.
FEW = 1 << 19
#: Values that a task looks at together.
_AT_ONCE = 1 << 20
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def sort_keys(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the values: NaN is the largest, both zeros are one."""
    if x.dtype.kind != "f":
        return x.astype(np.int64)
    x = x.astype(np.float64) + 0.0
    x[np.isnan(x)] = np.nan
    bits = x.view(np.int64)
    return bits ^ ((bits >> 63) & _MOST)


def from_key(key: int) -> float:
    """The double that a sort key stands for."""
    return float(np.array([key if key >= 0 else key ^ _MOST], np.int64).view(np.float64)[0])


def _counted(open_cells: list[tuple[int, int, int]], share: int | None, classes: int):
    """Task that counts, per cell and class, the values in the open ranges (set, least, largest), with the least and the
    largest value met. A range is cut into at most `share` cells (two or more); None: every value is a cell. Also the first
    and the last cell of each range."""
    by_set: dict[int, list[tuple[int, int, int, int]]] = {}
    spans, total = {}, 0
    for g, lo, hi in open_cells:
        step = -(-(hi - lo + 1) // share) if share else 1
        by_set.setdefault(g, []).append((lo, hi, step, total))
        spans[g, lo, hi] = (total, total - (-(hi - lo + 1) // step) - 1) if share else (lo, hi)
        total += -(-(hi - lo + 1) // step) if share else 0
    ranges = {g: tuple(np.array(v, t) for v, t in zip(zip(*r), (np.int64, np.int64, np.uint64, np.int64))) for g, r in by_set.items()}
    names = ["g", "at", "least", "most", *[f"n{k}" for k in range(classes)]]

    def task(batches: Iterable[pa.RecordBatch]):
        n = np.zeros((total, classes), np.int64)
        least, most, of = np.full(total, _MOST), np.full(total, _LEAST), np.zeros(total, np.int32)
        single: list[tuple[np.ndarray, ...]] = []

        def one_set(g, x, c):
            if g not in ranges:
                return
            lo, hi, step, start = ranges[g]
            key = sort_keys(x)
            i = np.searchsorted(lo, key, "right") - 1
            ok = (i >= 0) & (key <= hi[i])
            if not ok.all():
                key, i, c = key[ok], i[ok], c[ok]
            if not len(key):
                return
            if not share:
                single.append((np.full(len(key), g, np.int32), key, c))
                return
            at = start[i] + ((key.view(np.uint64) - lo[i].view(np.uint64)) // step[i]).astype(np.int64)
            a, b = int(at.min()), int(at.max()) + 1
            n[a:b] += np.bincount((at - a) * classes + c, minlength=(b - a) * classes).reshape(-1, classes)
            np.minimum.at(least, at, key)
            np.maximum.at(most, at, key)
            of[at] = g

        def look(held):
            g, c, *xs = (np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in held]) for k in range(held[0].num_columns))
            if len(c) and c.min() < 0:
                g, c, *xs = (v[c >= 0] for v in (g, c, *xs))
            if len(g) and g.min() != g.max():
                order = np.argsort(g, kind="stable")
                g, c, xs = g[order], c[order], [x[order] for x in xs]
            ends = [*np.flatnonzero(np.diff(g)) + 1, len(g)]
            for a, b in zip([0, *ends], ends):
                for j, x in enumerate(xs):
                    if a < b:
                        one_set(int(g[a]) + j, x[a:b], c[a:b])

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows * (batch.num_columns - 2)
            if size >= _AT_ONCE:
                look(held)
                held, size = [], 0
        if held:
            look(held)
        if single:
            g, key, c = (np.concatenate(v) for v in zip(*single))
            order = np.lexsort((key, g))
            g, key, c = g[order], key[order], c[order]
            new = np.r_[True, (np.diff(g) != 0) | (key[1:] != key[:-1])]
            at = np.cumsum(new) - 1
            n = np.bincount(at * classes + c, minlength=(at[-1] + 1) * classes).reshape(-1, classes)
            cells = [g[new], key[new], key[new], key[new]]
        else:
            met = np.flatnonzero(n.sum(axis=1))
            n, cells = n[met], [of[met], met, least[met], most[met]]
        out = [*cells, *n.T]
        for a in range(0, len(out[0]), 10_000):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.ascontiguousarray(v[a:a + 10_000]), pa.int32() if k == 0 else pa.int64()) for k, v in enumerate(out)], names)

    return task, spans


def _collected(rows: DataFrame, task, classes: int):
    """Counts of all tasks, ordered by set and cell: arrays of sets, cells, least and largest values, counts by class."""
    counts = [f"n{k}" for k in range(classes)]
    met = rows.mapInArrow(task, ", ".join(["g int, at long, least long, most long", *[f"{c} long" for c in counts]]))
    met = met.groupBy("g", "at").agg(F.min("least").alias("least"), F.max("most").alias("most"), *[F.sum(c).alias(c) for c in counts])
    t = met.toArrow()
    g, at, least, most, *n = (t.column(c).to_numpy() for c in ("g", "at", "least", "most", *counts))
    order = np.lexsort((at, g))
    return g[order], at[order], least[order], most[order], np.column_stack(n)[order]


def at_ranks(rows: DataFrame, sets: int, wanted: Callable[[dict[int, np.ndarray]], list[tuple[int, int, int]]], classes: int = 1):
    """The values at wanted ranks and how many values lie below and up to them.

    `rows` has columns (g, c, x0, x1, ...): the value xj, without NULLs, belongs to set g + j < `sets` and to class c < `classes`;
    rows with c < 0 take no part.
    `wanted` gets the number of values per set and class and names the ranks: (set, k, r) asks for the r-th smallest
    (from 1) of the values in the first k classes. Returns the numbers and, per wanted rank, (sort key of the value, values
    of the set below it, values up to it), both by class.

    Each round reads the rows once and counts the values in the ranges that hold a wanted rank, cut into cells; the cell
    with the rank is the next range, as narrow as the values in it. A range of one value is settled. What is counted
    is bounded by CELLS and FEW however many rows there are.
    """
    task, _ = _counted([(s, _LEAST, _MOST) for s in range(sets)], 2, classes)
    g, _, least, most, n = _collected(rows, task, classes)
    totals, first = {}, {}
    for s in np.unique(g).tolist():
        totals[s], first[s] = n[g == s].sum(axis=0), (s, int(least[g == s].min()), int(most[g == s].max()))
    asked = wanted(totals)
    found: list = [None] * len(asked)
    # Rank number -> (its range, values of the set below the range by class, values in the range).
    left = {k: (first[s], np.zeros(classes, np.int64), int(totals[s].sum())) for k, (s, _, _) in enumerate(asked)}
    while left:
        held = {cell: inside for cell, _, inside in left.values()}
        cells = sorted(held)
        share = None if sum(held.values()) <= FEW else max(2, CELLS // len(cells))
        task, spans = _counted(cells, share, classes)
        g, at, least, most, n = _collected(rows, task, classes)
        sums = np.vstack([np.zeros((1, classes), np.int64), np.cumsum(n, axis=0)])
        upto = {k: sums[:, :k].sum(axis=1) for k in {asked[q][1] for q in left}}
        span = {}
        for cell, (lo, hi) in spans.items():
            a, b = np.searchsorted(g, cell[0], "left"), np.searchsorted(g, cell[0], "right")
            span[cell] = a + np.searchsorted(at[a:b], lo, "left"), a + np.searchsorted(at[a:b], hi, "right")
        for q, (cell, below, _) in list(left.items()):
            _, k, r = asked[q]
            a, b = span[cell]
            j = a + int(np.searchsorted(upto[k][a + 1:b + 1], r - below[:k].sum() + upto[k][a]))
            before = below + sums[j] - sums[a]
            if least[j] == most[j]:
                found[q] = int(least[j]), before, before + n[j]
                del left[q]
            else:
                left[q] = (cell[0], int(least[j]), int(most[j])), before, int(n[j].sum())
    return totals, found
