"""Byte-level BPE by column expressions: ranked merges folded over the bytes of words, and the way back."""

from __future__ import annotations

import json
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tickerweave.llm.common import frequent_rows, write_once
from tickerweave.llm.tokens import BYTE_BPE, PATTERN, read_ranks

#: White space of the published pattern, spelled out because engines differ in what \\s covers.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Most words whose ids are kept ready and broadcast; other words are encoded once for each batch of texts.
FREQUENT = 500_000
#: Tasks that encode them.
WAYS = 96
#: Bytes of text in a batch.
BATCH = 6 << 20
#: Distinct words a counting task holds before it passes them on.
FLUSH = 250_000
#: Seeds of the two hashes that a word is known by.
_SEEDS = (42, xxhash.xxh64_intdigest(b"word", seed=42))


def as_bytes(text: Column) -> Column:
    """The UTF-8 bytes of a text, one character (U+0000 to U+00FF) each, so that bytes can be cut, joined and looked up."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


#: Bits of a rank, which is also the id of a piece, and of the place where a piece begins in its word.
_RANK_BITS, _PLACE_BITS = 17, 23
_RANK, _LOW = (1 << _RANK_BITS) - 1, (1 << _RANK_BITS + _PLACE_BITS) - 1


def _table(entries: dict[int, int]) -> tuple[list[int], list[int], int]:
    """(shifts, cells, n): a map in which every key has a place of its own, so that one look finds it. A key stands, with its
    value in the lower bits, in cell key % n + shifts[key % len(shifts)]; 0 is an empty cell."""
    n = len(entries) + 13
    while True:
        buckets = {}
        for key in entries:
            buckets.setdefault(key % (len(entries) // 3 + 1), []).append(key)
        if all(len({k % n for k in keys}) == len(keys) for keys in buckets.values()):
            break
        n += 1  # two keys of a bucket would always meet
    most = n // 2 + 13
    shifts, cells, shift = [0] * (len(entries) // 3 + 1), [0] * (n + most), 0
    for bucket in sorted(buckets, key=lambda b: -len(buckets[b])):
        at = [k % n for k in buckets[bucket]]
        while any(cells[x + shift] for x in at):
            shift = (shift + 7919) % most
        shifts[bucket] = shift
        for x, key in zip(at, buckets[bucket], strict=True):
            cells[x + shift] = key << _RANK_BITS | entries[key]
    return shifts, cells, n


def _let(value: Column, use) -> Column:
    """use(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _let_all(values: list[Column], use, bound: tuple = ()) -> Column:
    """use(list of the values) with each of them computed once."""
    return use(list(bound)) if not values else _let(values[0], lambda v: _let_all(values[1:], use, (*bound, v)))


class Codec:
    """Encoding with the ranks of one vocabulary, as expressions of a literal map.

    A piece is known by its id, which is its rank. The rank map is kept by pairs: two pieces whose joint bytes are in
    the vocabulary, left id plus one times SHIFT plus right id lead to the rank of both together.
    """

    SHIFT = 1 << _RANK_BITS

    def __init__(self, ranks: dict[bytes, int]):
        if max(ranks.values()) >= _RANK - 1:
            raise ValueError(f"ranks of {_RANK_BITS} bits at most")
        pairs = {}
        for piece, rank in ranks.items():
            for k in range(1, len(piece)):
                left, right = ranks.get(piece[:k]), ranks.get(piece[k:])
                if left is not None and right is not None:
                    pairs[(left + 1) * self.SHIFT + right] = rank
        self.end = max(ranks.values()) + 1  # stands before and after a word; makes no pair
        shifts, cells, self.n = _table(pairs)
        self.buckets = len(shifts)
        # Indices of arrays begin with 1.
        self.shifts = F.from_json(F.lit(json.dumps([x + 1 for x in shifts])), "array<bigint>")
        self.cells = F.from_json(F.lit(json.dumps(cells)), "array<bigint>")
        self.bytes = F.array(*[F.lit(ranks.get(bytes([b]))).cast("bigint") for b in range(256)])

    def encode_words(self, words: Column) -> Column:
        """Ids of each of an array of matches of the pattern, given as texts. The rank map stands in the plan once, bound to
        a variable."""
        return self.encode_codes(F.transform(words, lambda w: F.transform(F.split(as_bytes(w), ""), F.ascii)))

    def encode_codes(self, words: Column) -> Column:
        """encode_words for matches given by their UTF-8 bytes, arrays of 0 to 255 or, as in signed bytes, -128 to 127."""
        return _let_all([self.bytes, self.shifts, self.cells], lambda bound: F.transform(words, lambda w: self._encode(w, *bound)))

    def _encode(self, codes: Column, byte_ids: Column, shifts: Column, cells: Column) -> Column:
        """Starts from the bytes of a word and merges, one step of the fold at a time, the neighbours whose joint piece has
        the lowest rank, the first of them at a tie.

        A piece is one number: the rank that it makes with the piece after it (_RANK: none), the place where it begins, its
        id. So the least number is the next pair to merge.
        """
        rank_bits, place_bits = F.lit(_RANK).cast("bigint"), F.lit(_LOW - _RANK)

        def above(left, right, rest):
            """rest, with the rank of left and right above it."""
            def from_key(key):
                def from_cell(cell):
                    rank = F.when(F.shiftright(cell, _RANK_BITS) == key, cell.bitwiseAND(rank_bits)).otherwise(rank_bits)
                    return F.shiftleft(rank.cast("bigint"), _RANK_BITS + _PLACE_BITS).bitwiseOR(rest)

                shift = F.element_at(shifts, (key % F.lit(self.buckets) + 1).cast("int"))
                return _let(F.element_at(cells, (key % F.lit(self.n) + shift).cast("int")), from_cell)

            return _let((left + 1) * F.lit(self.SHIFT) + right, from_key)

        def piece(x):
            return x.bitwiseAND(rank_bits)

        def start(ids):
            return F.transform(ids, lambda x, k: above(x, F.get(ids, k + 1), F.shiftleft(k.cast("bigint"), _RANK_BITS).bitwiseOR(x)))

        def merge(pieces, _):
            def at(low, both, place):
                before, after = F.element_at(pieces, place - 1), F.element_at(pieces, place + 2)
                pair = F.array(
                    above(piece(before), both, before.bitwiseAND(F.lit(_LOW))),
                    above(both, piece(after), low.bitwiseAND(place_bits).bitwiseOR(both)),
                )
                return F.concat(F.slice(pieces, 1, place - 2), pair, F.slice(pieces, place + 2, F.lit(1 << 30)))

            def step(low):
                # Not array_position, which leaves its loop by an exception.
                begin = low.bitwiseAND(place_bits)
                place = _let(begin, lambda b: F.size(F.filter(pieces, lambda x: x.bitwiseAND(place_bits) < b)) + 1)
                found = _let_all([F.shiftright(low, _RANK_BITS + _PLACE_BITS), place], lambda b: at(low, *b))
                return F.when(low > F.lit(_RANK << _RANK_BITS + _PLACE_BITS), pieces).otherwise(found)

            return _let(F.array_min(pieces), step)

        def fold(ids):
            pieces = F.aggregate(F.sequence(F.lit(4), F.greatest(F.size(ids), F.lit(4))), start(ids), merge)
            return _let(pieces, lambda p: F.transform(F.slice(p, 2, F.size(p) - 2), lambda x: piece(x).cast("int")))

        # What is used more than once is bound to a variable, because functions of arrays compute each mention anew.
        ends = F.array(F.lit(self.end).cast("bigint"))
        ids = F.transform(codes, lambda c: F.element_at(byte_ids, F.pmod(c.cast("int"), F.lit(256)) + 1))
        return _let(F.concat(ends, ids, ends), fold)


# --- texts to words --------------------------------------------------------------------------


class Splitter:
    """Matches of the pattern in a text, each distinct part between blanks matched once.

    In a text whose white space is single blanks and line feeds, no match crosses a blank but as its first character, and a
    line feed is a match of its own. Other texts are matched whole.
    """

    def __init__(self, pattern: str):
        spelled = pattern.replace(r"[^\s", f"[^{_SPACE}").replace(r"\S", f"[^{_SPACE}]").replace(r"\s", f"[{_SPACE}]")
        self.find = regex.compile(spelled).findall
        self.odd = regex.compile(f"[{_SPACE.replace('-', chr(45))}](?<![ \n])|[ \n][ \n]").search

    def cut(self, text: str) -> list[str] | None:
        """The text cut at its blanks, where each part but the first has one before it and the matches of the parts, one
        after the other, are those of the text; None where it has to be matched whole."""
        return None if self.odd(text) else text.split(" ")


def count_words(texts: DataFrame, text_col: str, pattern: str) -> DataFrame:
    """(word, n) of the words found twice or more, which are worth keeping ready: Spark counts the parts between blanks, and
    the words of each distinct part are then found once, as if a blank stood before it."""
    parts = texts.select(F.explode(F.split(text_col, " ")).alias("part")).groupBy("part").agg(F.count(F.lit(1)).alias("n"))

    def find(batches):
        split, words = Splitter(pattern), Counter()
        for batch in batches:
            for part, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for word in split.find(" " + part):
                    words[word] += n
                if len(words) >= FLUSH:
                    yield _counted(words)
                    words.clear()
        yield _counted(words)

    return parts.mapInArrow(find, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter("n > 1")


def _counted(words: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], names=["word", "n"])


def word_hashes(word) -> list[Column]:
    """The two hashes of a word that Python's xxhash repeats."""
    return [F.xxhash64(word), F.xxhash64(F.lit("word"), word)]


class Numbered(dict):
    """Numbers of strings by their first appearance; `into` lists them, each after `lead`."""

    def __init__(self, into: list, lead: str):
        self.into, self.lead = into, lead

    def __missing__(self, key):
        self[key] = number = len(self.into)
        self.into.append(self.lead + key)
        return number


def _spread(parts: np.ndarray, per_text: np.ndarray, lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of the words, one text after the other; how many each text has) from numbers of parts and the parts' words."""
    size = np.array([len(x) for x in lists], np.int64)
    begin = np.cumsum(size) - size
    flat = np.fromiter(chain.from_iterable(lists), np.int32, int(size.sum()))
    each = size[parts]
    total = np.concatenate([[0], np.cumsum(each)])
    words = flat[np.repeat(begin[parts] - total[:-1], each) + np.arange(total[-1])]
    return words, np.diff(total[np.concatenate([[0], np.cumsum(per_text)])])


class Ready:
    """Ids of the frequent words, by their two hashes; what has to find words and what has to copy ids travel apart."""

    def __init__(self, spark, table: pa.Table):
        key, check = (table.column(k).to_numpy() for k in (0, 1))
        order = np.argsort(key)
        lists = pa.concat_arrays(table.column(2).chunks).take(pa.array(order)) if table.num_rows else pa.array([], pa.list_(pa.int32()))
        lengths = pyarrow.compute.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int32)
        self.keys = spark.sparkContext.broadcast((key[order], check[order]))
        self.ids = spark.sparkContext.broadcast((lengths, lists.flatten().to_numpy(zero_copy_only=False).astype(np.int32)))


def _find(words: list[str], keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
    """The place of each word among the frequent ones, -1 where it is none of them."""
    if not len(keys):
        return np.full(len(words), -1, np.int64)
    raw = [w.encode() for w in words]
    h1, h2 = (np.array([xxhash.xxh64_intdigest(w, seed=s) for w in raw], np.uint64).view(np.int64) for s in _SEEDS)
    at = np.minimum(np.searchsorted(keys, h1), len(keys) - 1)
    return np.where((keys[at] == h1) & (checks[at] == h2), at, -1)


def encode_texts(docs: DataFrame, text_col: str = "text", ids_col: str = "ids", ranks_path: str = BYTE_BPE, pattern: str = PATTERN,
                 frequent: int = FREQUENT, keep_text: bool = True, back: bool = False) -> DataFrame:
    """Rows of docs with ids_col, the ids of the whole text: every match of the pattern encoded by itself. With back, also
    <ids_col>_text, the decimal ids joined by one blank, and <ids_col>_bytes, what the ids decode to.

    Words are merged by Codec.encode_words, a fold of column expressions over a literal rank map, once for each distinct
    word: once for all for the `frequent` most frequent words, whose ids are broadcast, and once per batch of texts for
    the others, which occur a few times at most. A task cuts its texts into batches of bounded size, lists each batch's
    distinct words, has the expressions encode those that are not ready and puts the texts together again from word
    numbers. No row moves but for the word counts.

    NULL and empty texts: no ids. Any other text decodes to itself. Repeated rows are encoded alike, an empty table stays
    empty, and columns of docs named like new ones are replaced; all others pass through, the text only with keep_text.
    """
    ranks = read_ranks(ranks_path)
    codec = Codec(ranks)
    counts = write_once(count_words(docs, text_col, pattern), "bpe-words")
    # A table of its own, since the driver keeps a description of each plan, which holds the rank map, and of each new plan
    # that adaptive execution makes after an exchange.
    some = write_once(frequent_rows(counts, "n", frequent).repartition(WAYS, "word"), "bpe-frequent")
    encoded = F.element_at(codec.encode_words(F.array("word")), 1)
    ready = Ready(docs.sparkSession, some.select(*[h.alias(f"h{k}") for k, h in enumerate(word_hashes(F.col("word")))], encoded.alias("ids")).toArrow())
    new = {ids_col: "array<int>"} | ({f"{ids_col}_text": "string", f"{ids_col}_bytes": "binary"} if back else {})
    kept = [c for c in docs.columns if c not in new and (keep_text or c != text_col)]
    base = docs.select(*kept, F.col(text_col).alias("_words_of"))
    find, ids = ready.keys, ready.ids
    spelled = docs.sparkSession.sparkContext.broadcast(_pieces(ranks)) if back else None

    def cut_up(batches):
        split = Splitter(pattern)
        for batch in batches:
            sizes = pyarrow.compute.binary_length(batch.column(len(kept))).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends_at = np.cumsum(sizes)
            start = 0
            while start < len(sizes):
                done = ends_at[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(ends_at, done + BATCH, side="right")))
                part = batch.slice(start, stop - start)
                start = stop
                # A text is a list of parts, a part a list of words; both are numbered by their first appearance.
                parts, ends, parts_of = [], [], []
                rest, first = Numbered(parts_of, " "), Numbered(parts_of, "")
                for text in part.column(len(kept)).to_pylist():
                    cut = split.cut(text or "") or [text]
                    line = [first[cut[0]], *map(rest.__getitem__, cut[1:])]
                    parts.append(np.array(line, np.int32))
                    ends.append(len(line))
                local = Numbered(words := [], "")
                lists = [list(map(local.__getitem__, split.find(p))) for p in parts_of]
                numbers, ends = _spread(np.concatenate(parts), np.array(ends), lists)
                place = _find(words, *find.value)
                rare = np.flatnonzero(place < 0)
                place[rare] = -1 - np.arange(len(rare))
                raw = [words[k].encode() for k in rare.tolist()]
                begins = np.concatenate([[0], np.cumsum([len(w) for w in raw])]).astype(np.int32)
                codes = pa.ListArray.from_arrays(pa.array(begins), pa.array(np.frombuffer(b"".join(raw), np.int8)))
                sink = pa.BufferOutputStream()
                rows = part.select(list(range(len(kept))))
                with pa.ipc.new_stream(sink, rows.schema) as stream:
                    stream.write_batch(rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.array([numbers.tobytes()], pa.binary()),
                     pa.array([ends.tobytes()], pa.binary()), pa.array([place.tobytes()], pa.binary()),
                     pa.ListArray.from_arrays(pa.array([0, len(raw)], pa.int32()), codes)],
                    names=["rows", "numbers", "ends", "place", "rare"])

    def spell(out, bounds):
        if spelled is None:
            return ()
        pieces, texts, back_ = spelled.value, [], []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            own = out[a:b].tolist()
            texts.append(" ".join(map(str, own)))
            back_.append(b"".join(map(pieces.__getitem__, own)))
        return texts, back_

    def put_together(batches):
        lengths, flat = ids.value
        first = np.cumsum(lengths, dtype=np.int64) - lengths
        for batch in batches:
            for k in range(batch.num_rows):
                place = np.frombuffer(batch.column(3)[k].as_py(), np.int64)
                more = batch.column(4)[k].values
                known, late = place >= 0, -1 - place
                size, begin = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
                size[known], begin[known] = lengths[place[known]], first[place[known]]
                pieces = flat
                if len(more):
                    offsets = more.offsets.to_numpy()
                    size[~known], begin[~known] = np.diff(offsets)[late[~known]], offsets[:-1][late[~known]] - offsets[0] + len(flat)
                    pieces = np.concatenate([flat, more.flatten().to_numpy().astype(np.int32)])
                numbers = np.frombuffer(batch.column(1)[k].as_py(), np.int32)
                texts = np.frombuffer(batch.column(2)[k].as_py(), np.int64)
                each = size[numbers]
                total = np.concatenate([[0], np.cumsum(each)])
                out = pieces[np.repeat(begin[numbers] - total[:-1], each) + np.arange(total[-1])]
                total = total[np.concatenate([[0], np.cumsum(texts)])]
                a = 0
                for part in pa.ipc.open_stream(pa.py_buffer(batch.column(0)[k].as_py())):
                    b = a + part.num_rows
                    lists = pa.ListArray.from_arrays(pa.array((total[a : b + 1] - total[a]).astype(np.int32)), pa.array(out[total[a] : total[b]]))
                    more_of = [pa.array(x, t) for x, t in zip(spell(out, total[a : b + 1]), (pa.string(), pa.binary()), strict=False)]
                    yield pa.RecordBatch.from_arrays([*part.columns, lists, *more_of], names=[*kept, *new])
                    a = b

    cut_ = base.mapInArrow(cut_up, "rows binary, numbers binary, ends binary, place binary, rare array<array<tinyint>>")
    cut_ = cut_.select("rows", "numbers", "ends", "place", codec.encode_codes(F.col("rare")).alias("rare"))
    return cut_.mapInArrow(put_together, StructType(docs.select(*kept).schema.fields + StructType.fromDDL(", ".join(f"{c} {t}" for c, t in new.items())).fields))


def _pieces(ranks: dict[bytes, int]) -> list[bytes]:
    """Pieces by id."""
    pieces = [b""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece
    return pieces


def decode_ids(ids: Column, ranks_path: str = BYTE_BPE) -> Column:
    """Binary text of a column of ids, their binary pieces one after the other; NULL for NULL, an unknown id is an error."""
    pieces = [piece.decode("latin-1") for piece in _pieces(read_ranks(ranks_path))]
    held = F.from_json(F.lit(json.dumps(pieces)), "array<string>")
    return F.encode(_let(held, lambda p: F.array_join(F.transform(ids, lambda i: F.element_at(p, i + 1)), "")), "ISO-8859-1")
