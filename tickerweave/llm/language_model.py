"""A gated recurrent language model over words: counted on Spark, trained by averaged passes, scored document by document."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerweave.llm.common import frequent_rows, write_once

#: The token that ends a document. It holds white space, so no word equals it.
END = b"\n"
#: Most words the network tells apart; all others share one of its places and are told apart by their counts.
VOCABULARY = 4_096
#: Most words whose counts are broadcast; the counts of rarer ones are joined.
FREQUENT = 131_072
#: Tokens a task lays out in parallel lanes at a time.
POOL = 1_500_000
SEED = 7


def tokens(text: str | None) -> list[bytes]:
    """Words between ASCII white space with A-Z lower-cased, then the end."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    words.append(END)
    return words


# --- counting --------------------------------------------------------------------------------


def count_words(texts: DataFrame, text_col: str, flush: int = 300_000) -> DataFrame:
    """(word binary, n) over all texts; tasks add up before the shuffle, with at most `flush` words in memory."""

    def count(batches):
        seen: Counter = Counter()
        out = lambda: pa.RecordBatch.from_arrays(
            [pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(tokens(text))
                if len(seen) >= flush:
                    yield out()
                    seen.clear()
        yield out()

    parts = texts.select(text_col).mapInArrow(count, "word binary, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """The most frequent words, at most `most`, by falling count; a count is taken whole or not at all."""
    rows = [(bytes(r["word"]), r["n"]) for r in frequent_rows(counts, "n", most).collect()]
    return sorted(rows, key=lambda r: (-r[1], r[0]))


# --- the network -----------------------------------------------------------------------------


def _log_sum(logits: np.ndarray) -> np.ndarray:
    """log of the sum of exp by row; logits start at or below 0, so a maximum is only taken if one has grown large."""
    with np.errstate(over="ignore", divide="ignore"):
        out = np.log(np.exp(logits) @ np.ones(logits.shape[1], logits.dtype))
    if not np.isfinite(out).all():
        top = logits.max(1)
        out = top + np.log(np.exp(logits - top[:, None]).sum(1))
    return out


def _softmax(logits: np.ndarray, scale: np.float32) -> np.ndarray:
    """scale times the softmax by row; a maximum is only taken if one has grown large."""
    with np.errstate(over="ignore"):
        out = np.exp(logits)
        total = out @ np.ones(out.shape[1], out.dtype)
    if not 0 < total.min() <= total.max() < np.inf:
        out = np.exp(logits - logits.max(1, keepdims=True))
        total = out.sum(1)
    out *= (scale / total)[:, None]
    return out


def _sorted(keys: np.ndarray, most: int) -> np.ndarray:
    """Stable order of keys below `most`; short integers are sorted by radix."""
    return np.argsort(keys.astype(np.int16) if most <= 32_768 else keys, kind="stable")


class Network:
    """Gated recurrent cell with a class-factored softmax: P(word) = P(class | state) * P(word | class, state).

    Words sit in classes of about equal size by falling frequency; place 0 stands for every word outside
    the vocabulary. Biases start at log frequencies, so that the untrained network is the unigram model.
    """

    NAMES = ("emb", "wx", "wh", "b", "wc", "bc", "ww", "bw")

    def __init__(self, weights: list[int], hidden: int, seed: int = SEED):
        """weights: training counts by place."""
        size = len(weights)
        self.hidden = hidden
        self.width = max(1, int(math.ceil(math.sqrt(size))))
        self.classes = -(-size // self.width)
        self.size = size
        draw = np.random.default_rng(seed)
        count = np.full(self.classes * self.width, 0.0)
        count[:size] = np.asarray(weights, float) + 0.5
        by_class = count.reshape(self.classes, self.width)
        h = hidden
        small = lambda *shape: (draw.standard_normal(shape) * 0.1).astype(np.float32)
        self.emb = small(size, h)
        self.wx, self.wh = small(h, 3 * h), small(h, 3 * h)
        self.b = np.zeros(3 * h, np.float32)
        self.wc, self.ww = np.zeros((h, self.classes), np.float32), np.zeros((self.classes, h, self.width), np.float32)
        self.bc = np.log(by_class.sum(1) / count.sum()).astype(np.float32)
        with np.errstate(divide="ignore"):
            bw = np.log(by_class / by_class.sum(1, keepdims=True))
        self.bw = np.where(np.isfinite(bw), bw, -1e9).astype(np.float32)

    def get(self) -> list[np.ndarray]:
        return [getattr(self, n) for n in self.NAMES]

    def put(self, arrays: list[np.ndarray]) -> Network:
        for name, value in zip(self.NAMES, arrays, strict=True):
            setattr(self, name, value)
        return self

    def states(self, ids: np.ndarray, fresh: np.ndarray, h: np.ndarray, keep: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
        """State before each token, and after the last. ids, fresh: (steps, lanes); a fresh token starts a document.

        The input of a step is the token before it; a document starts from a zero state. Inside, lanes come last,
        so that gates are blocks of memory.
        """
        n = self.hidden
        steps, lanes = ids.shape
        x = self.emb[ids.ravel()]
        # tanh of half the input gives the gates between 0 and 1.
        halves = np.repeat(np.array([0.5, 1], np.float32), (2 * n, n))
        gates = (((self.wx * halves).T @ x.T) + (self.b * halves)[:, None]).reshape(3 * n, steps, lanes)
        wh_zr, wh_c = np.ascontiguousarray(self.wh[:, : 2 * n].T) * np.float32(0.5), np.ascontiguousarray(self.wh[:, 2 * n :].T)
        starts = fresh.any(axis=1)
        h = np.ascontiguousarray(h.T)
        all_h = np.empty((n, steps, lanes), np.float32)
        if keep is not None:
            zrs, rhs, cs = (np.empty((k * n, steps, lanes), np.float32) for k in (2, 1, 1))
        for t in range(steps):
            if starts[t]:
                h = np.where(fresh[t], np.float32(0), h)
            all_h[:, t] = h
            zr = wh_zr @ h
            zr += gates[: 2 * n, t]
            np.tanh(zr, out=zr)
            zr *= np.float32(0.5)
            zr += np.float32(0.5)
            rh = zr[n:] * h
            c = wh_c @ rh
            c += gates[2 * n :, t]
            np.tanh(c, out=c)
            if keep is not None:
                zrs[:, t], rhs[:, t], cs[:, t] = zr, rh, c
            c -= h
            c *= zr[:n]
            h = h + c
        if keep is not None:
            keep.update(x=x, h=all_h, z=zrs[:n], r=zrs[n:], rh=rhs, c=cs)
        return np.ascontiguousarray(all_h.transpose(1, 2, 0)), np.ascontiguousarray(h.T)

    def _by_class(self, cls: np.ndarray):
        """Order of rows by class, and (class, begin, end) of each that occurs."""
        order = _sorted(cls, self.classes)
        bounds = np.searchsorted(cls[order], np.arange(self.classes + 1)).tolist()
        return order, [(c, bounds[c], bounds[c + 1]) for c in range(self.classes) if bounds[c + 1] > bounds[c]]

    def _words(self, state: np.ndarray, cls: np.ndarray, parts: list[tuple[int, int, int]]) -> np.ndarray:
        """Logits within the class of each row, with rows sorted by class."""
        out = self.bw[cls]
        for c, begin, end in parts:
            out[begin:end] += state[begin:end] @ self.ww[c]
        return out

    def log_probability(self, state: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Natural log of P(token | state) for rows of states."""
        order, parts = self._by_class(ids // self.width)
        state, ids = state[order], ids[order]
        cls, place = ids // self.width, ids % self.width
        got = np.empty(len(ids), np.result_type(state, self.wc))
        for at in range(0, len(ids), 2048):
            part = slice(at, at + 2048)
            logits = state[part] @ self.wc
            logits += self.bc
            got[part] = logits[np.arange(len(logits)), cls[part]] - _log_sum(logits)
            words = self._words(state[part], cls[part], [(c, max(b - at, 0), e - at) for c, b, e in parts if b < at + 2048 and e > at])
            got[part] += words[np.arange(len(words)), place[part]] - _log_sum(words)
        out = np.empty_like(got)
        out[order] = got
        return out

    def gradients(self, ids: np.ndarray, fresh: np.ndarray, h: np.ndarray, use: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the mean loss over one window (truncated backpropagation), and the state after it."""
        n = self.hidden
        kept: dict = {}
        before, h = self.states(ids, fresh, h, kept)
        steps, lanes = ids.shape
        every = ids.ravel()
        some = np.flatnonzero(use.ravel())
        order, parts = self._by_class(every[some] // self.width)
        some = some[order]
        state, flat = before.reshape(-1, n)[some], every[some]
        scale = np.float32(1 / max(1, len(some)))
        cls, place = flat // self.width, flat % self.width
        rows = np.arange(len(flat))
        p = _softmax(state @ self.wc + self.bc, scale)
        p[rows, cls] -= scale
        g = {"wc": state.T @ p, "bc": p.sum(0)}
        d = p @ self.wc.T
        occur = np.array([c for c, _, _ in parts], np.int64)
        q = _softmax(self._words(state, cls, parts), scale)
        q[rows, place] -= scale
        ww = np.empty((len(parts), n, self.width), np.float32)
        for k, (c, begin, end) in enumerate(parts):
            ww[k] = state[begin:end].T @ q[begin:end]
            d[begin:end] += q[begin:end] @ self.ww[c].T
        bw = np.add.reduceat(q, [begin for _, begin, _ in parts], axis=0) if parts else np.empty((0, self.width), np.float32)
        g["ww"], g["bw"] = (occur, ww), (occur, bw)
        spread = np.zeros((steps * lanes, n), np.float32)
        spread[some] = d
        d = np.ascontiguousarray(spread.reshape(steps, lanes, n).transpose(0, 2, 1))
        old, z, r, rh, c = (kept[k] for k in ("h", "z", "r", "rh", "c"))
        to_c, to_z, to_r = 1 - c * c, (c - old) * (1 - z), rh * (1 - r)
        pre = np.empty((3 * n, steps, lanes), np.float32)
        back = np.zeros((n, lanes), np.float32)
        starts = fresh.any(axis=1)
        wh_zr, wh_c = np.ascontiguousarray(self.wh[:, : 2 * n]), np.ascontiguousarray(self.wh[:, 2 * n :])
        for t in range(steps - 1, -1, -1):
            gone = back * z[:, t]
            dc = gone * to_c[:, t]
            drh = wh_c @ dc
            pre[:n, t], pre[n : 2 * n, t], pre[2 * n :, t] = gone * to_z[:, t], drh * to_r[:, t], dc
            back -= gone
            drh *= r[:, t]
            back += drh
            back += wh_zr @ pre[: 2 * n, t]
            back += d[t]
            if starts[t]:
                back = np.where(fresh[t], np.float32(0), back)
        flat_pre = pre.reshape(3 * n, -1)
        g["wx"], g["b"] = (flat_pre @ kept["x"]).T, flat_pre.sum(1)
        g["wh"] = np.hstack([old.reshape(n, -1) @ flat_pre[: 2 * n].T, rh.reshape(n, -1) @ flat_pre[2 * n :].T])
        g["emb"] = (every, flat_pre.T @ self.wx.T)
        return g, h


class Steps:
    """Adaptive steps: each weight's is divided by the root of its squared gradients so far."""

    def __init__(self, net: Network, rate: float):
        self.net, self.rate = net, rate
        self.sums = {n: np.full_like(v, 1e-6) for n, v in zip(net.NAMES, net.get(), strict=True)}

    def _move(self, name, grad, at=slice(None)):
        total = self.sums[name][at] + grad * grad
        self.sums[name][at] = total
        np.sqrt(total, out=total)
        np.divide(grad, total, out=total)
        total *= np.float32(self.rate)
        getattr(self.net, name)[at] -= total

    def apply(self, g: dict) -> None:
        for name in ("wx", "wh", "b", "wc", "bc"):
            self._move(name, g[name])
        for name in ("ww", "bw"):
            at, grad = g[name]
            self._move(name, grad, at)
        ids, grad = g["emb"]
        order = _sorted(ids, self.net.size)
        first = np.flatnonzero(np.r_[True, np.diff(ids[order]) > 0])
        self._move("emb", np.add.reduceat(grad[order], first, axis=0), ids[order][first])


def lanes_of(docs: list[np.ndarray], lanes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents laid end to end in at most so many lanes, longest first into the shortest lane.

    There are no more lanes than keep the longest document from leaving the others idle.

    Returns tokens and document numbers, both (steps, lanes), with document -1 where a lane is over, and
    whether a token starts its document.
    """
    import heapq

    even = sum(map(len, docs)) // max(map(len, docs))
    heap = [(0, k) for k in range(max(1, min(lanes, even)))]
    place: list[list[int]] = [[] for _ in heap]
    for d in sorted(range(len(docs)), key=lambda d: -len(docs[d])):
        used, k = heapq.heappop(heap)
        place[k].append(d)
        heapq.heappush(heap, (used + len(docs[d]), k))
    steps = max(u for u, _ in heap)
    ids, owner = np.zeros((steps, len(heap)), np.int64), np.full((steps, len(heap)), -1, np.int64)
    fresh = np.ones((steps, len(heap)), bool)
    for k, chain in enumerate(place):
        at = 0
        for d in chain:
            end = at + len(docs[d])
            ids[at:end, k], owner[at:end, k], fresh[at + 1 : end, k] = docs[d], d, False
            at = end
    return ids, owner, fresh


def pools(batches, column: int, most: int = POOL):
    """Groups of (batch, row, text) with at most about `most` tokens, by size, in memory."""
    held, size = [], 0
    for batch in batches:
        for row, text in enumerate(batch.column(column).to_pylist()):
            held.append((batch, row, text))
            size += len(text) // 5 + 1
            if size >= most:
                yield held
                held, size = [], 0
    if held:
        yield held


def train_pass(texts: DataFrame, words: list[bytes], net: Network, lanes: int, window: int, rate: float) -> Network:
    """One pass over the texts: each task trains the network it is given, and the changes are averaged by tokens.

    words: the network's, by place. The state runs through every token, and every window of the lanes is
    learned from, by backpropagation through that window.
    """
    sent = texts.sparkSession.sparkContext.broadcast((net.get(), net.hidden, words))

    def train(batches):
        arrays, hidden, known = sent.value
        mine = Network([1] * len(known), hidden).put([a.copy() for a in arrays])
        steps, done = Steps(mine, rate), 0
        place = {w: k for k, w in enumerate(known) if k}
        for pool in pools(batches, 0):
            docs = [np.array([place.get(w, 0) for w in tokens(text)], np.int64) for _, _, text in pool]
            ids, owner, fresh = lanes_of(docs, lanes)
            h = np.zeros((ids.shape[1], hidden), np.float32)
            for t in range(0, len(ids), window):
                part = slice(t, t + window)
                use = owner[part] >= 0
                g, h = mine.gradients(ids[part], fresh[part], h, use)
                steps.apply(g)
                done += int(use.sum())
        if done:
            for k, (old, new) in enumerate(zip(arrays, mine.get(), strict=True)):
                change = ((new - old) * np.float32(done)).ravel()
                for at in range(0, len(change), 65536):
                    part = change[at : at + 65536]
                    yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([at]), pa.array([done]), pa.array([part.tobytes()])],
                                                     names=["k", "at", "done", "change"])

    def add(key, group):
        total = sum(np.frombuffer(part.as_py(), np.float32).astype(np.float64) for part in group["change"])
        mean = (total / sum(group["done"].to_pylist())).astype(np.float32)
        return pa.table({"k": [key[0].as_py()], "at": [key[1].as_py()], "change": [mean.tobytes()]})

    parts = texts.mapInArrow(train, "k long, at long, done long, change binary")
    arrays = [a.copy() for a in net.get()]
    for row in parts.groupBy("k", "at").applyInArrow(add, "k long, at long, change binary").collect():
        change = np.frombuffer(bytes(row["change"]), np.float32)
        arrays[row["k"]].reshape(-1)[row["at"] : row["at"] + len(change)] += change
    return Network([1] * len(words), net.hidden).put(arrays)


# --- scoring ---------------------------------------------------------------------------------


def score_documents(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", hidden: int = 16,
                    vocabulary: int = VOCABULARY, words: int = FREQUENT, lanes: int = 128, window: int = 16,
                    passes: int = 4, rate: float = 0.1) -> DataFrame:
    """(id_col, n_tokens, n_known, train_tokens, base_score, score), one row per row of docs.

    train says which rows may be learned from; a NULL of it is no. Word counts cover all of them. base_score is the add-one
    unigram score, score the network's log10 probability of the whole text. The network tells the
    `vocabulary` most frequent words apart; for others it gives their common place, times the
    share (count + 1) / (N' + V' + 1) among the N' training tokens and V' words outside the vocabulary, an
    unseen word counting 0. So the probabilities of what may follow add up to 1.

    The `words` most frequent words and the network, both of bounded size, are broadcast; counts of rarer
    words are joined by word, where no key is frequent. A document's state runs through all its windows.
    Training goes over `passes` disjoint parts of the training rows, each once (train_pass).

    NULL, empty and blank texts: only the end is scored. Repeated rows count and score one by one. With no
    training rows N is 0, nothing is known and the score is that of one common place. Empty table:
    empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
                       F.coalesce(train, F.lit(False)).alias("learn"))
    learn = rows.filter("learn")
    counts = write_once(count_words(learn, "text"), "word-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    ends = counts.filter(F.col("word") == F.lit(END)).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    known = [(END, ends), *[r for r in frequent(counts, words) if r[0] != END]]
    inside = known[: vocabulary - 1]
    outside, kinds = total - sum(c for _, c in inside), distinct - sum(c > 0 for _, c in inside)
    names = [b"", *[w for w, _ in inside]]
    net = Network([outside, *[c for _, c in inside]], hidden)
    part = F.pmod(F.xxhash64(F.lit("pass"), "id"), F.lit(passes))
    for k in range(passes if total else 0):
        net = train_pass(learn.filter(part == k).select("text"), names, net, lanes, window, rate / (1 + k))
    sent = spark.sparkContext.broadcast((net.get(), hidden, known, len(names)))

    def score(batches):
        arrays, size, seen, inside_to = sent.value
        mine = Network([1] * inside_to, size).put(arrays)
        index = {w: k + 1 for k, (w, _) in enumerate(seen)}
        log_of = np.log10(np.array([0, *[c for _, c in seen]], float) + 1)
        for pool in pools(batches, 1):
            docs, heads = [], []
            for batch, row, text in pool:
                words_ = tokens(text)
                at = np.array([index.get(w, 0) for w in words_], np.int64)
                rare = Counter([words_[i] for i in np.flatnonzero(at == 0).tolist()])
                known_here = int((at > 0).sum()) - (0 if seen[0][1] else int((at == 1).sum()))
                heads.append((batch.column(0)[row].as_py(), len(at), known_here, float(log_of[at].sum()),
                              int(((at == 0) | (at >= inside_to)).sum()), float(log_of[at[at >= inside_to]].sum()), list(rare.items())))
                docs.append(np.where(at < inside_to, at, 0))
            ids, owner, fresh = lanes_of(docs, 512)
            h, sums = np.zeros((ids.shape[1], size), np.float32), np.zeros(len(docs))
            step = max(32, 16_384 // ids.shape[1])
            for t in range(0, len(ids), step):
                span = slice(t, t + step)
                states, h = mine.states(ids[span], fresh[span], h)
                use = np.flatnonzero(owner[span].ravel() >= 0)
                got = mine.log_probability(states.reshape(-1, size)[use], ids[span].ravel()[use])
                sums += np.bincount(owner[span].ravel()[use], got.astype(np.float64), len(docs))
            for a in range(0, len(docs), 1000):
                cols = list(zip(*heads[a : a + 1000], strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], batch.schema.field(0).type), *[pa.array(cols[i], kind) for i, kind in
                     ((1, pa.int64()), (2, pa.int64()), (3, pa.float64()), (4, pa.int64()), (5, pa.float64()))],
                     pa.array(sums[a : a + 1000] / math.log(10)), pa.array(cols[6], pa.map_(pa.binary(), pa.int64()))],
                    names=["id", "n_tokens", "n_known", "logs", "n_outside", "outside_logs", "lm", "rare"])

    kind = rows.schema["id"].dataType.simpleString()
    scored = rows.select("id", "text").mapInArrow(
        score, f"id {kind}, n_tokens long, n_known long, logs double, n_outside long, outside_logs double, lm double, rare map<binary,bigint>")
    scored = write_once(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = scored.select("row", F.explode("rare").alias("word", "k")).join(counts, "word")
    rare = rare.groupBy("row").agg(F.sum("k").alias("more"), F.sum(F.col("k") * F.log10(F.col("n") + 1)).alias("more_logs"))
    out = scored.drop("rare").join(rare, "row", "left").fillna(0, ["more", "more_logs"])
    of_all = math.log10(total + distinct + 1)
    of_outside = math.log10(outside + kinds + 1)
    return out.select(
        F.col("id").alias(id_col), "n_tokens", (F.col("n_known") + F.col("more")).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("logs") + F.col("more_logs") - F.col("n_tokens") * F.lit(of_all)).alias("base_score"),
        (F.col("lm") + F.col("outside_logs") + F.col("more_logs") - F.col("n_outside") * F.lit(of_outside)).alias("score"))
