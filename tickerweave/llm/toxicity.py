"""Toxicity: a factorization machine over hashed terms, so that terms also count together."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tickerweave.llm.labelled import bounded

#: Terms are hashed to this many places.
PLACES = 1 << 20
#: Words whose places a task remembers before it starts again.
REMEMBER = 400_000
STEMS = (5, 6, 7)
LEVELS = (1, 2, 3, 4, 6)
_LETTERS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()


def words_of(text: str | None) -> set[bytes]:
    """Distinct words: letters and digits, A-Z lower-cased, and whatever is not ASCII."""
    return set((text or "").encode("utf-8", "surrogatepass").translate(_LETTERS).split())


def _hash(kind: int, part: bytes) -> int:
    return xxhash.xxh3_64_intdigest(part, kind) % PLACES


def word_place(word: bytes) -> int:
    return _hash(0, word)


def stem_places(word: bytes) -> tuple[int, ...]:
    """Places of the word's beginnings of 5, 6 and 7 bytes."""
    return tuple(_hash(k, word[:k]) for k in STEMS if len(word) > k)


def level_place(stem: int, level: int) -> int:
    """Place of "at least `level` distinct words of the text begin so"."""
    return (stem + level * 402_653_189) % PLACES


def length_place(words: int) -> int:
    """Place of the text's length, in powers of two of its distinct words."""
    return _hash(99, b"%d" % words.bit_length())


def text_places(text: str | None) -> np.ndarray:
    """Places of all terms of a text: words, how many of them share a beginning, and its length."""
    words = words_of(text)
    stems, counts = np.unique(np.array([p for w in words for p in stem_places(w)], np.int64), return_counts=True)
    found = [np.array([length_place(len(words)), *map(word_place, words)], np.int64)]
    found += [level_place(stems[counts >= level], level) for level in LEVELS]
    return np.unique(np.concatenate(found))


class Machine:
    """Log odds = bias + sum of the terms' weights + sum over pairs of terms of the product of their vectors."""

    def __init__(self, chosen: np.ndarray, rank: int = 8, seed: int = 3):
        """chosen: the places the machine knows, ascending."""
        self.chosen = chosen
        self.w0 = 0.0
        self.w = np.zeros(len(chosen))
        self.v = np.random.default_rng(seed).standard_normal((len(chosen), rank)) * 0.02

    def odds(self, flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log odds, and sums of vectors, of rows given as one array of term numbers and where each row starts."""
        sizes = np.diff(np.append(starts, len(flat)))
        row = np.repeat(np.arange(len(starts)), sizes)
        line = np.bincount(row, self.w[flat], len(starts))
        v = self.v[flat]
        total = np.zeros((len(starts), self.v.shape[1]))
        some = sizes > 0
        if some.any():
            total[some] = np.add.reduceat(v, starts[some], axis=0)
        square = np.bincount(row, np.einsum("ij,ij->i", v, v), len(starts))
        return self.w0 + line + 0.5 * (np.einsum("ij,ij->i", total, total) - square), total


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def choose(rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray, most: int, screened: int = 1_024) -> np.ndarray:
    """Places the machine knows: those that say most about the label alone, and those that say something beside another.

    Alone: the largest likelihood ratios of term and label, at least 3 rows each. Beside another: `screened` places, half
    of them the best alone and the rest those whose presence varies most, are tried pair by pair, and both places of
    a pair stay when the label moves with the product of their centred presences. A group mention that is as common in
    clean text as in toxic text gets its vector this way.
    """
    if not len(y):
        return np.empty(0, np.int64)
    flat = np.concatenate(rows)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    seen = np.bincount(flat, minlength=PLACES)
    a = np.bincount(flat, (weight * y)[row], PLACES)
    b = np.bincount(flat, (weight * (1 - y))[row], PLACES)
    pos, neg = (weight * y).sum(), (weight * (1 - y)).sum()
    part = lambda k, n: k * np.log(np.maximum(k, 1e-12) / np.maximum(n, 1e-12))
    share = pos / max(pos + neg, 1e-12)
    gain = 2 * (part(a, (a + b) * share) + part(b, (a + b) * (1 - share)))
    gain[seen < 3] = 0
    best = np.argsort(-gain, kind="stable")[:most]
    alone = best[gain[best] > 10.8]  # one chance in a thousand
    varied = seen * (len(rows) - seen)
    varied[alone[: screened // 2]] = 0
    varied = np.argsort(-varied, kind="stable")[: screened - min(len(alone), screened // 2)]
    tried = np.sort(np.concatenate([alone[: screened // 2], varied[seen[varied] >= 3]]))
    return np.union1d(alone, tried[moves_together(rows, y, weight, tried)])


def moves_together(rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray, places: np.ndarray, least: float = 36.0,
                   chunk: int = 1_000) -> np.ndarray:
    """Which of the places (ascending) stand in a pair whose centred product goes with the label: squared normal
    deviate above `least`, with the label's residual after the two places' own slopes."""
    n, m = len(rows), len(places)
    if m < 2:
        return np.zeros(m, bool)
    terms = [as_terms(r, places) for r in rows]
    mean = np.bincount(np.concatenate(terms), weight[np.repeat(np.arange(n), [len(t) for t in terms])], m) / weight.sum()
    rest = y - (weight * y).sum() / weight.sum()

    def present(lo):
        x = np.zeros((min(chunk, n - lo), m), np.float32)
        for k, t in enumerate(terms[lo : lo + chunk]):
            x[k, t] = 1
        return x - mean.astype(np.float32)

    slope, size = np.zeros(m), np.zeros(m)
    for lo in range(0, n, chunk):
        x, w = present(lo), weight[lo : lo + chunk]
        slope += x.T @ (w * rest[lo : lo + chunk])
        size += (x * x).T @ w
    slope /= np.maximum(size, 1e-9)
    both, spread, cubed, square = (np.zeros((m, m)) for _ in range(4))
    for lo in range(0, n, chunk):
        x, w, e = present(lo), weight[lo : lo + chunk], rest[lo : lo + chunk]
        both += x.T @ (x * (w * e)[:, None].astype(np.float32))
        spread += (x * x).T @ (x * x * ((w * e) ** 2)[:, None].astype(np.float32))
        cubed += (x * x).T @ (x * w[:, None].astype(np.float32))
        square += (x * x).T @ (x * x * (w * w)[:, None].astype(np.float32))
    # The product of two places also goes with the label through each place's own slope; that part is taken off.
    both -= slope[:, None] * cubed + slope[None, :] * cubed.T
    deviate = both**2 / np.maximum(spread, 1e-6 * square + 1e-9)
    np.fill_diagonal(deviate, 0)
    return (deviate > least).any(axis=1)


def as_terms(places: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    at = np.searchsorted(chosen, places)
    at = at[at < len(chosen)] if len(chosen) else at[:0]
    return np.unique(at[np.isin(chosen[at], places)]) if len(at) else at


def fit(rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray, most_terms: int = 4096, rank: int = 8, epochs: int = 12,
        batch: int = 128, rate: float = 0.05, decay: float = 2e-4, threshold: float = 0.7, seed: int = 9) -> Machine:
    """Trains on four fifths of the rows, sets the bias on the rest so that the best F1 falls on the threshold."""
    if not len(y) or y.min() == y.max():
        machine = Machine(np.empty(0, np.int64), rank)
        machine.w0 = -20.0 if not len(y) or y.max() == 0 else 20.0
        return machine
    draw = np.random.default_rng(seed)
    fifth = draw.permutation(len(y)) % 5 == 0
    chosen = choose([r for r, f in zip(rows, fifth, strict=True) if not f], y[~fifth], weight[~fifth], most_terms)
    machine = Machine(chosen, rank)
    terms = [as_terms(r, chosen) for r in rows]
    mean = (weight * y)[~fifth].sum() / weight[~fifth].sum()
    machine.w0 = math.log((mean + 1e-6) / (1 - mean + 1e-6))
    gw, gv, g0 = np.full(len(chosen), 1e-4), np.full((len(chosen), rank), 1e-4), 1e-4
    train = np.flatnonzero(~fifth)
    for _ in range(epochs):
        order = draw.permutation(train)
        for s in range(0, len(order), batch):
            part = order[s : s + batch]
            flat = np.concatenate([terms[i] for i in part])
            sizes = np.array([len(terms[i]) for i in part])
            z, total = machine.odds(flat, np.cumsum(sizes) - sizes)
            err = (_sigmoid(z) - y[part]) * weight[part] / weight[part].sum()
            g0 += err.sum() ** 2
            machine.w0 -= rate * err.sum() / math.sqrt(g0)
            row = np.repeat(np.arange(len(part)), sizes)
            used, back = np.unique(flat, return_inverse=True)
            gl = np.bincount(back, err[row], len(used)) + decay * machine.w[used]
            each = err[row][:, None] * (total[row] - machine.v[flat])
            gp = np.zeros((len(used), rank))
            np.add.at(gp, back, each)
            gp += decay * machine.v[used]
            gw[used] += gl * gl
            gv[used] += gp * gp
            machine.w[used] -= rate * gl / np.sqrt(gw[used])
            machine.v[used] -= rate * gp / np.sqrt(gv[used])
    held = np.flatnonzero(fifth)
    sizes = np.array([len(terms[i]) for i in held])
    flat = np.concatenate([terms[i] for i in held]) if len(held) else np.empty(0, np.int64)
    z = machine.odds(flat.astype(np.int64), np.cumsum(sizes) - sizes)[0]
    order = np.argsort(-z, kind="stable")
    hits = np.cumsum((weight * y)[held][order])
    f1 = 2 * hits / (np.cumsum(weight[held][order]) + (weight * y)[held].sum())
    if len(f1) and hits[-1] > 0:
        k = int(np.argmax(f1))
        below = z[order[k + 1]] if k + 1 < len(order) else z[order[k]] - 2
        machine.w0 += math.log(threshold / (1 - threshold)) - (z[order[k]] + below) / 2
    return machine


def learn(docs: DataFrame, labels: DataFrame, may_learn: Column, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", most_positive: int = 5_000, most_negative: int = 10_000, threshold: float = 0.7) -> Machine:
    """The machine from labelled rows that may be learned from: at most about most_positive texts labelled 1 and
    most_negative labelled 0, drawn evenly by a hash of the id and weighted back to their true numbers. The drawn ids, bounded so, are broadcast."""
    mine = labels.filter(may_learn & F.col(label_col).isNotNull()).select(id_col, F.col(label_col).cast("int").alias("y"))
    sets = {1: mine.filter("y = 1"), 0: mine.filter("y <> 1")}
    counts = {k: d.count() for k, d in sets.items()}
    drawn = bounded(sets[1], id_col, most_positive).union(bounded(sets[0], id_col, most_negative)).distinct()
    texts = docs.select(F.col(id_col), F.col(text_col)).filter(may_learn).join(F.broadcast(drawn), id_col).select(text_col, "y")

    def make(batches):
        for batch in batches:
            found = [text_places(text).astype(np.int32) for text in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.list_(pa.int32()))], names=["y", "places"])

    table = texts.mapInArrow(make, "y int, places array<int>").toArrow()
    y = table["y"].to_numpy().astype(float)
    column = table["places"].combine_chunks()
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values, at = column.flatten().to_numpy(), np.concatenate([[0], np.cumsum([len(x) for x in column])])
    rows = [values[a:b].astype(np.int64) for a, b in zip(at[:-1], at[1:], strict=True)]
    order = sorted(range(len(rows)), key=lambda i: (y[i], len(rows[i]), rows[i].tobytes()))  # as tasks may finish in any order
    weight = np.where(y == 1, counts[1] / max(1, y.sum()), counts[0] / max(1, (1 - y).sum()))
    return fit([rows[i] for i in order], y[order], weight[order] / weight.mean() if len(y) else weight, threshold=threshold)


def score_toxicity(docs: DataFrame, machine: Machine, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """Rows of docs with score (double, 0 to 1) and predicted (1 if score >= threshold).

    Every whole text is scored where it lies; no row moves. NULL and empty texts have no terms and score by the
    bias alone. Repeated rows score alike, an empty table stays empty; columns of docs named score or
    predicted are replaced, all others pass through.
    """
    sent = docs.sparkSession.sparkContext.broadcast((machine.chosen, machine.w0, machine.w, machine.v))
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    base = docs.select(*kept)
    at = kept.index(text_col)

    def score(batches):
        chosen, w0, w, v = sent.value
        mine = Machine(chosen[:0])
        mine.chosen, mine.w0, mine.w, mine.v = chosen, w0, w, v
        number = {int(p): k for k, p in enumerate(chosen)}
        known: dict[bytes, tuple] = {}

        def look(word):
            """Number of the word's own term or none, and its beginnings of which any level is a term."""
            if len(known) >= REMEMBER:
                known.clear()
            own = number.get(word_place(word))
            stems = tuple(s for s in stem_places(word) if any(level_place(s, n) in number for n in LEVELS))
            known[word] = found = (own, stems) if own is not None or stems else None
            return found

        for batch in batches:
            rows = []
            for text in batch.column(at).to_pylist():
                words = words_of(text)
                terms, stems = {number.get(length_place(len(words)))}, {}
                for word in words:
                    found = known[word] if word in known else look(word)
                    if found:
                        terms.add(found[0])
                        for stem in found[1]:
                            stems[stem] = stems.get(stem, 0) + 1
                for stem, n in stems.items():
                    terms.update(number.get(level_place(stem, level)) for level in LEVELS if level <= n)
                terms.discard(None)
                rows.append(np.array(sorted(terms), np.int64))
            sizes = np.array([len(r) for r in rows], np.int64)
            flat = np.concatenate(rows) if rows else np.empty(0, np.int64)
            s = _sigmoid(mine.odds(flat, np.cumsum(sizes) - sizes)[0])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                                             names=[*kept, "score", "predicted"])

    return base.mapInArrow(score, StructType(base.schema.fields + StructType.fromDDL("score double, predicted int").fields))
