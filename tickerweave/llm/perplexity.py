"""Quality rules with n-gram perplexity: a modified Kneser-Ney model counted by Spark, and bands of perplexity per language.

The n-grams are five characters of the text, whose words are each followed by one blank. A character is a symbol of 12 bits
(characters beyond U+0FFF share the upper places by a hash), so that an n-gram is a number of 60 bits whose context and whose
shorter end are a shift and a mask away: counts of all lower orders, contexts and discounts are aggregations of numbers.
For scoring, n-grams lie in arrays sorted by an invertible hash, found by their leading bits.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerweave.llm.common import cut, lookup, write_once

ORDER = 5
BITS = 12
#: The symbol before a text begins; it is context, never predicted.
START = 0
#: Characters worked on at a time, distinct n-grams that a counting task holds before it passes them on.
PIECE = 2 << 20
HELD = 2 << 20
#: Most n-grams and contexts that are broadcast for scoring; a larger model is joined to the n-grams of the texts instead.
BROADCAST = 4_000_000

_ODD = np.uint64(0x9E3779B97F4A7C15)
_SYMBOLS = b"#*$%&|<>"
_CONTINUED = bytes(range(0x80, 0xC0))


# --- texts to n-grams -------------------------------------------------------------------------


def symbols(text: bytes) -> np.ndarray:
    """Symbols of the words of a UTF-8 text, each word followed by a blank."""
    words = text.split()  # bytes split at exactly [\\x20\\x09-\\x0D]
    if not words:
        return np.empty(0, np.int64)
    point = np.frombuffer((b" ".join(words) + b" ").decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.int64)
    point[point == START] = 1
    beyond = point >= 0x1000
    if beyond.any():
        point[beyond] = 0x400 + ((point[beyond] * 2654435761 & 0xFFFFFFFF) >> 12) % 0xC00
    return point


def ngrams(texts):
    """(texts' numbers, starts, n-grams) of lists of texts, a bounded number of characters at a time: the n-grams of the
    j-th number begin at starts[j]. A long text comes in several parts, each with the symbols before it as context."""
    owner, parts, held = [], [], 0

    def keys():
        u = np.concatenate(parts)
        k = u.copy()
        for j in range(1, ORDER):
            k[j:] |= u[:-j] << (BITS * j)
        size = np.array([len(p) for p in parts])
        first = np.cumsum(size) - size
        inside = np.ones(len(u), bool)
        inside[(first[:, None] + np.arange(ORDER - 1)).ravel()] = False
        size = size - (ORDER - 1)
        return np.array(owner), np.cumsum(size) - size, k[inside]

    for number, text in enumerate(texts):
        s = np.concatenate([np.full(ORDER - 1, START, np.int64), symbols(text)])
        for a in range(ORDER - 1, len(s), PIECE):
            owner.append(number)
            parts.append(s[a - ORDER + 1 : a + PIECE])
            held += len(parts[-1])
            if held >= PIECE:
                yield keys()
                owner, parts, held = [], [], 0
    if parts:
        yield keys()


def slices(batch: pa.RecordBatch, column: int, most: int = 256):
    """Parts of a batch of at most `most` rows with their texts."""
    for a in range(0, batch.num_rows, most):
        part = batch.slice(a, most)
        yield part, part.column(column).to_pylist()


def count_ngrams(texts: DataFrame, text_col: str) -> DataFrame:
    """(key, n) of all n-grams of all texts; tasks add up before the shuffle."""

    def count(batches):
        held, waiting = (np.empty(0, np.int64), np.empty(0, np.int64)), []

        def merge():
            key = np.concatenate([held[0], *[w[0] for w in waiting]])
            n = np.concatenate([held[1], *[w[1] for w in waiting]])
            order = np.argsort(key, kind="stable")
            key, n = key[order], n[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
            waiting.clear()
            return key[first], np.add.reduceat(n, first) if len(key) else n

        def rows():
            for a in range(0, len(held[0]), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(held[0][a : a + 100_000]), pa.array(held[1][a : a + 100_000])], names=["key", "n"])

        for batch in batches:
            for _, texts in slices(batch, 0):
                for _, _, keys in ngrams(texts):
                    waiting.append(np.unique(keys, return_counts=True))
                    if sum(len(w[0]) for w in waiting) >= HELD:
                        held = merge()
                        if len(held[0]) >= HELD:
                            yield from rows()
                            held = (np.empty(0, np.int64), np.empty(0, np.int64))
        held = merge()
        yield from rows()

    binary = texts.select(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    return binary.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


# --- the model --------------------------------------------------------------------------------


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """What is taken off counts of 1, 2, and 3 or more, by how often counts 1 to 4 occur; fixed values where one does not."""
    if not (n1 and n2 and n3 and n4):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    raw = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3
    return tuple(min(max(d, 0.1), float(k)) for k, d in enumerate(raw, 1))


def _mask(order: int) -> int:
    return (1 << BITS * order) - 1


def tag(order: int, key: Column) -> Column:
    """One number for an n-gram of any order."""
    return key.bitwiseOR(F.lit(order << BITS * ORDER))


def kneser_ney(grams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(n-grams: key, logp; contexts: key, logw) of all orders, from the counts (key, n) of the highest; natural logarithms.

    Interpolated modified Kneser-Ney: counts of lower orders are numbers of different symbols before; three discounts per
    order; what a context's discounts free is its weight for the next lower order, down to an even share for each symbol
    seen and one unseen. Joins are by key; a context, or a shorter end, has at most one row per symbol to join with.
    """
    counts = {ORDER: cut(grams.select("key", "n"))}
    for o in range(ORDER - 1, 0, -1):
        end = F.col("key").bitwiseAND(F.lit(_mask(o)))
        counts[o] = cut(counts[o + 1].groupBy(end.alias("key")).agg(F.count(F.lit(1)).alias("n")))
    few = [F.count_if(F.col("n") == k).alias(f"n{k}") for k in range(1, 5)]
    levels = None
    for o, c in counts.items():
        level = c.agg(F.lit(o).alias("o"), F.count(F.lit(1)).alias("rows"), *few)
        levels = level if levels is None else levels.union(level)
    levels = {r["o"]: r for r in levels.collect()}  # one row per order
    even = 1.0 / (levels[1]["rows"] + 1)
    below, all_p, all_w = None, None, None
    for o in range(1, ORDER + 1):
        d1, d2, d3 = discounts(*[levels[o][f"n{k}"] for k in range(1, 5)])
        n = F.col("n")
        off = F.when(n == 1, d1).when(n == 2, d2).otherwise(d3)
        rows = counts[o].withColumn("context", F.shiftrightunsigned("key", BITS))
        shares = cut(rows.groupBy("context").agg(F.sum("n").alias("total"), (F.sum(off) / F.sum("n")).alias("w")))
        rows = rows.join(shares, "context")
        if below is None:
            p = (n - off) / F.col("total") + F.col("w") * F.lit(even)
        else:
            lower = below.select(F.col("key").alias("end"), F.col("p").alias("low"))
            rows = rows.withColumn("end", F.col("key").bitwiseAND(F.lit(_mask(o - 1)))).join(lower, "end")
            p = (n - off) / F.col("total") + F.col("w") * F.col("low")
        below = cut(rows.select("key", p.alias("p")))
        ps = below.select(tag(o, F.col("key")).alias("key"), F.ln("p").alias("logp"))
        ws = shares.select(tag(o - 1, F.col("context")).alias("key"), F.ln("w").alias("logw"))
        all_p, all_w = (ps, ws) if all_p is None else (all_p.union(ps), all_w.union(ws))
    return all_p, all_w


class Sorted:
    """Values of numbers in two arrays sorted by a hash of the number. The hash is a product with an odd constant modulo
    2^64, so different numbers never share one; its leading bits give the place where a search begins."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        h = keys.astype(np.uint64) * _ODD
        order = np.argsort(h)
        self.hashes, self.values = h[order], values[order].astype(np.float64)
        self.shift = np.uint64(64 - max(1, len(keys).bit_length() + 1))
        edges = np.arange(1 << (64 - int(self.shift)), dtype=np.uint64) << self.shift
        self.first = np.searchsorted(self.hashes, edges).astype(np.int32)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(value or 0, whether it is there) of each key."""
        n = len(self.hashes)
        if not n:
            return np.zeros(len(keys)), np.zeros(len(keys), bool)
        h = keys.astype(np.uint64) * _ODD
        at = np.minimum(self.first[h >> self.shift], n - 1)
        seen = self.hashes[at]
        late = np.flatnonzero(seen < h)
        while len(late):
            step = at[late] + 1
            late, step = late[step < n], step[step < n]
            at[late] = step
            seen[late] = self.hashes[step]
            late = late[seen[late] < h[late]]
        there = seen == h
        return np.where(there, self.values[at], 0.0), there


class Model:
    """A model whose n-grams fit in memory."""

    def __init__(self, grams: DataFrame, contexts: DataFrame, even: float):
        arrays = []
        for df in (grams, contexts):
            t = df.toArrow()
            arrays.append(Sorted(t.column(0).to_numpy(), t.column(1).to_numpy()))
        self.grams, self.contexts = arrays
        self.even = np.log(even)

    def logp(self, keys: np.ndarray) -> np.ndarray:
        """Log probability of the last symbol of each n-gram after the others."""
        out = np.zeros(len(keys))
        left, shorter = np.arange(len(keys)), keys
        for o in range(ORDER, 0, -1):
            value, there = self.grams.find(shorter | (o << BITS * ORDER))
            out[left[there]] += value[there]
            left, shorter = left[~there], shorter[~there]
            if not len(left):
                return out
            weight, _ = self.contexts.find((shorter >> BITS) | ((o - 1) << BITS * ORDER))
            out[left] += weight  # a context never seen passes everything on: a weight of 1
            shorter = shorter & _mask(o - 1)
        out[left] += self.even
        return out


# --- scoring ----------------------------------------------------------------------------------


def repeated_words(numbers: np.ndarray, distinct: int) -> int:
    """Words inside a window of three that occurs twice or more, from the words' numbers below `distinct`."""
    if len(numbers) < 4:
        return 0
    if distinct < 1 << 20:
        windows = (numbers[:-2] * distinct + numbers[1:-1]) * distinct + numbers[2:]
        _, which, n = np.unique(windows, return_inverse=True, return_counts=True)
        often = n[which] > 1
    else:
        w = numbers.tolist()
        n = Counter(zip(w, w[1:], w[2:]))
        often = np.array([n[x] > 1 for x in zip(w, w[1:], w[2:])])
    hit = np.zeros(len(numbers), bool)
    hit[:-2] |= often
    hit[1:-1] |= often
    hit[2:] |= often
    return int(hit.sum())


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a text."""
    words = text.split()
    seen: dict[bytes, int] = {}
    numbers = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    joined = b"".join(words)
    lines = [x for x in text.split(b"\n") if x and x.strip()]
    return (len(words), len(joined.translate(None, _CONTINUED)),
            len(text) - len(text.translate(None, _SYMBOLS)), len(lines) - len(set(lines)), repeated_words(numbers, max(len(seen), 1)))


_BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def _score(rows: DataFrame, model) -> DataFrame:
    """rows (doc_id, lang, _row, text binary) with the base counts, the number of symbols and, given a broadcast model,
    their log probability; without one, the text's n-grams and how often each occurs."""
    names = [f.split()[0] for f in _BASE.split(", ")]
    joined = model is None
    last = "grams array<long>, counts array<long>" if joined else "logp double"

    def score(batches):
        for batch in batches:
            for part, texts in slices(batch, 3):
                base = [base_counts(t) for t in texts]
                n, logp = np.zeros(len(texts), np.int64), np.zeros(len(texts))
                lists = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(texts)
                for owner, starts, keys in ngrams(texts):
                    np.add.at(n, owner, np.diff([*starts, len(keys)]))
                    if joined:
                        for o, a, b in zip(owner, starts, [*starts[1:], len(keys)]):
                            u, c = np.unique(np.concatenate([lists[o][0], keys[a:b]]), return_inverse=True)
                            lists[o] = u, np.bincount(c, np.concatenate([lists[o][1], np.ones(b - a, np.int64)])).astype(np.int64)
                    else:
                        np.add.at(logp, owner, np.add.reduceat(model.value.logp(keys), starts))
                out = [*part.columns[:3], *[pa.array([b[k] for b in base], pa.int64()) for k in range(len(names))], pa.array(n)]
                if joined:
                    out += [pa.array([x[k] for x in lists], pa.list_(pa.int64())) for k in range(2)]
                else:
                    out.append(pa.array(logp))
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "lang", "_row", *names, "n_chars", *(["grams", "counts"] if joined else ["logp"])])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(score, f"doc_id {kind}, lang string, _row long, {_BASE}, n_chars long, {last}")


def _score_by_join(rows: DataFrame, grams: DataFrame, contexts: DataFrame, even: float) -> DataFrame:
    """_score for a model of any size: the different n-grams of the texts meet the model's in joins by key.

    An n-gram asks for itself and its ends in all orders, and for their contexts; the longest end that is there counts,
    with the weights of the contexts above it. An n-gram that very many texts hold is one row here, and its log probability
    comes back to the texts by lookup.
    """
    texts = write_once(_score(rows, None), "ngram-texts")
    pairs = texts.select("_row", F.inline(F.arrays_zip("grams", "counts"))).toDF("_row", "gram", "n")
    asked = cut(pairs.groupBy("gram").agg(F.count(F.lit(1)).alias("rows")))
    orders = F.array(*[F.struct(F.lit(o).alias("o"), tag(o, F.col("gram").bitwiseAND(F.lit(_mask(o)))).alias("key"),
                                tag(o - 1, F.shiftrightunsigned(F.col("gram").bitwiseAND(F.lit(_mask(o))), BITS)).alias("context"))
                       for o in range(1, ORDER + 1)])
    ends = asked.select("gram", F.inline(orders))
    ends = ends.join(grams, "key", "left").join(contexts.withColumnRenamed("key", "context"), "context", "left")
    found = ends.groupBy("gram").agg(F.array_sort(F.collect_list(F.struct("o", "logp", "logw"))).alias("at"))  # one entry per order
    p = F.aggregate("at", F.lit(float(np.log(even))), lambda low, x: F.coalesce(x["logp"], low + F.coalesce(x["logw"], F.lit(0.0))))
    values = cut(found.select("gram", p.alias("p")).join(asked, "gram").select("gram", F.lit(0).alias("zero"), "p", "rows"))
    pairs = pairs.withColumn("zero", F.lit(0))
    pairs = lookup(pairs, values, ("gram", "zero"), "rows", ["p"], F.xxhash64("_row", "gram"))
    sums = pairs.groupBy("_row").agg(F.sum(F.col("n") * F.col("p")).alias("logp"))
    return texts.drop("grams", "counts").join(sums, "_row", "left").withColumn("logp", F.coalesce("logp", F.lit(0.0)))


def bands(scored: DataFrame, low: float, high: float, least_spread: float, grid: int = 1000) -> DataFrame:
    """(lang, lower, upper, rows): per language the median of log_perplexity less `low` and plus `high` spreads, where a
    spread is 1.4826 median absolute deviations, least_spread at least. Medians are exact to 1/grid: texts are counted per
    step of the grid before the shuffle, so that no task holds a language's texts, only its steps."""

    def median(steps: DataFrame, value: str) -> DataFrame:
        w = Window.partitionBy("lang").orderBy(value)
        c = steps.groupBy("lang", value).agg(F.sum("n").alias("n"))
        c = c.withColumns({"to": F.sum("n").over(w), "all": F.sum("n").over(Window.partitionBy("lang"))})
        return c.filter(2 * F.col("to") >= F.col("all")).groupBy("lang").agg(F.min(value).alias("middle"), F.max("all").alias("rows"))

    step = F.floor(F.col("log_perplexity") * grid).cast("long")
    steps = cut(scored.groupBy("lang", step.alias("step")).agg(F.count(F.lit(1)).alias("n")))
    middle = cut(median(steps, "step"))
    away = steps.join(middle.select("lang", "middle"), "lang").select("lang", F.abs(F.col("step") - F.col("middle")).alias("away"), "n")
    spread = median(away, "away").select("lang", F.col("middle").alias("away"))
    b = middle.join(spread, "lang")
    centre = (F.col("middle") + 0.5) / grid
    s = F.greatest(F.lit(1.4826) * F.col("away") / grid, F.lit(least_spread))
    return b.select("lang", (centre - low * s).alias("lower"), (centre + high * s).alias("upper"), "rows")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", low: float = 10.0, high: float = 5.0,
          least_spread: float = 0.01, min_words: int = 50, repeat_percent: int = 50, broadcast: int = BROADCAST) -> DataFrame:
    """(doc_id, lang, base counts, base_failed, n_chars, log_perplexity, lower, upper, kept) per row of docs.

    The model is counted over all texts of docs, every row once. log_perplexity is the mean negative log probability of a
    symbol; NULL without words. A document is kept when it does not fail the base rules and its log_perplexity lies within
    the band of its language, which the documents of that language that pass the base rules define. Copies lower the
    perplexity of what they share, so the lower band is the wider one.

    NULL texts have no words, a NULL language is "". Rows that repeat an id are judged one by one. A language with a single
    document keeps it. An empty table gives no rows. Other columns, whatever their names, play no part.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"),
                       F.monotonically_increasing_id().alias("_row"), text.cast("binary").alias("text"))
    counted = count_ngrams(docs.select(text_col), text_col)
    grams, contexts = kneser_ney(counted)
    grams, contexts = cut(grams), cut(contexts)
    n_grams, n_first = grams.agg(F.count(F.lit(1)), F.count_if(F.shiftrightunsigned("key", BITS * ORDER) == 1)).first()
    even = 1.0 / (n_first + 1)
    if n_grams + contexts.count() <= broadcast:
        scored = _score(rows, docs.sparkSession.sparkContext.broadcast(Model(grams, contexts, even)))
    else:
        scored = _score_by_join(rows, grams, contexts, even)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    scored = scored.withColumns({"base_failed": failed, "log_perplexity": F.when(F.col("n_chars") > 0, -F.col("logp") / F.col("n_chars"))})
    scored = write_once(scored.drop("logp", "_row"), "perplexity")
    limits = cut(bands(scored.filter(~F.col("base_failed") & F.col("log_perplexity").isNotNull()), low, high, least_spread))
    limits = limits.withColumns({"k1": F.xxhash64("lang"), "k2": F.col("lang")}).drop("lang")
    out = scored.withColumn("k1", F.xxhash64("lang")).withColumn("k2", F.col("lang"))
    out = lookup(out, limits, ("k1", "k2"), "rows", ["lower", "upper"], F.xxhash64("doc_id")).drop("k1", "k2")
    inside = F.col("log_perplexity").between(F.col("lower"), F.col("upper"))
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(True)))
