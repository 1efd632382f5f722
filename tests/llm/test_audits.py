"""Clustering, perplexity rules and filter audit against plain versions, with odd rows."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_documents import ODD, SCHEMA, bag, frame

from tickerweave.llm import centroids, filter_audit, perplexity

PARTS = "doc_id long, text string, lang string, part string, fails string"


# --- clustering -------------------------------------------------------------------------------


def plain_clusters(rows, k, rounds, salt):
    """rows: (id, list of 64 finite numbers)."""
    whole = [(i, [math.floor(256 * x) if abs(x) < 2**40 else 256 * int(x) for x in v]) for i, v in rows]
    order = sorted(whole, key=lambda r: (hashlib.sha256(f"{salt}:{'' if r[0] is None else r[0]}".encode()).hexdigest()))
    cents = [v for _, v in order[:k]]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v: min(range(len(cents)), key=lambda c: (gap(v, cents[c]), c))
    for _ in range(rounds):
        held = {}
        for _, v in whole:
            held.setdefault(nearest(v), []).append(v)
        cents = [[sum(x) // len(held[c]) for x in zip(*held[c])] if c in held else old for c, old in enumerate(cents)]
    placed = [(i, nearest(v), gap(v, cents[nearest(v)])) for i, v in whole]
    per = Counter()
    for _, c, d in placed:
        per[c] += d
    whole_sum = sum(per.values())
    fits = lambda x: x if x < 2**63 else None
    return [(i, c, fits(d), fits(per[c]), fits(whole_sum), hashlib.sha256(",".join(map(str, cents[c])).encode()).hexdigest()) for i, c, d in placed]


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster int").repartition(3)


def test_clusters_equal_a_plain_version(spark):
    r = random.Random(11)
    middles = [[r.uniform(-1, 1) for _ in range(64)] for _ in range(5)]
    good = [(i, [m + r.gauss(0, 0.05) for m in middles[i % 5]]) for i in range(150)]
    good += [(200 + i, good[0][1]) for i in range(20)]  # copies: equal distances, equal centroids
    good += [(300 + i, [float(r.randint(-1, 1)) for _ in range(64)]) for i in range(30)]
    good += [(400, [0.0] * 64), (401, [-0.5 / 256] * 64)]
    nan, inf = float("nan"), float("inf")
    odd = [(500, None), (501, []), (502, [1.0] * 63), (503, [1.0] * 65), (504, [1.0] * 63 + [nan]), (505, [inf] + [0.0] * 63), (506, [None] * 64)]
    got = centroids.cluster(vectors(spark, [(i, v, 7) for i, v in good + odd]), k=12, rounds=4, salt="s")
    assert bag(got.collect()) == bag(plain_clusters(good, 12, 4, "s"))


def test_clusters_of_few_repeated_and_huge_vectors(spark):
    r = random.Random(12)
    few = [(1, [r.random() for _ in range(64)]), (1, [r.random() for _ in range(64)]), (None, [r.random() for _ in range(64)])]
    got = centroids.cluster(vectors(spark, [(i, v, 0) for i, v in few]), k=40)
    assert sorted(x["distance"] for x in got.collect()) == [0, 0, 0]  # a centroid each
    huge = [(i, [r.uniform(-1, 1) * 10.0 ** r.choice([0, 5, 7, 30, 300]) for _ in range(64)]) for i in range(12)]
    huge += [(100 + i, [r.uniform(-1, 1) for _ in range(64)]) for i in range(12)]
    got = centroids.cluster(vectors(spark, [(i, v, 0) for i, v in huge]), k=5, rounds=3, salt="2")
    assert bag(got.collect()) == bag(plain_clusters(huge, 5, 3, "2"))
    assert centroids.cluster(vectors(spark, [])).collect() == []


def test_transform_is_exact_and_search_meets_ties():
    r = np.random.default_rng(3)
    x = r.integers(-300, 300, (50, 64))
    c = centroids.transform(x)
    assert (centroids.inverse(c) == x).all()
    assert ((c * c).sum(1) == 64 * (x * x).sum(1)).all()
    cents = np.concatenate([x[:5], x[:5], x[5:20]])
    best, far = centroids.search(c, centroids.transform(cents))
    plain = ((x[:, None] - cents[None]) ** 2).sum(2)
    assert (best == plain.argmin(1)).all() and (far == 64 * plain.min(1)).all()


# --- filter audit -----------------------------------------------------------------------------

LABELS = "doc_id long, quality int, toxic int, part string"


def plain_audit(rows, labels):
    """rows: (id, text, part); labels: (id, quality, toxic)."""
    judged = []
    for k, (i, text, part) in enumerate(rows):
        t = text or ""
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        fails = {"A"} if len(w) < 200 else set()
        fails |= {"B"} if 100 * len(set(w)) < 50 * len(w) else set()
        fails |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 3 * len(t) else set()
        fails |= {"D"} if re.search(r"[#$%&*|]", t) else set()
        fails |= {"E"} if any((u or "") == t and j is not None and i is not None and j < i for j, u, _ in rows) else set()
        judged.append((part or "", fails, any(j == i and q == 1 for j, q, _ in labels if j is not None),
                       any(j == i and x == 1 for j, _, x in labels if j is not None)))
    out, shares = {}, Counter()
    for part in {p for p, *_ in judged}:
        mine = [d for d in judged if d[0] == part]
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                failing = sum(f in d[1] for d in mine)
                out[part, "".join(order), step] = [len(left), len(gone), failing - len(gone), sum(d[1] == {f} for d in mine),
                                                   sum(d[2] for d in gone), sum(d[3] for d in gone)]
                shares[part, f] += len(gone)
    return [(*k, *v, shares[k[0], k[1][k[2] - 1]]) for k, v in out.items()]


def test_filter_audit(spark):
    r = random.Random(13)
    vocab = ["".join(r.choice("abcde") for _ in range(r.randint(1, 5))) for _ in range(400)]
    rows = []
    for k in range(150):
        n = r.choice([5, 150, 199, 200, 201, 400])
        text = " ".join(r.choice(vocab[: r.choice([20, 400])]) for _ in range(n))
        text += r.choice(["", "", " #", " 5 %", "É一"])
        text = text.upper() if r.random() < 0.2 else text
        rows.append((k, text, r.choice(["en", "de", "", None])))
    rows += [(1000 - k, rows[k % 9][1], r.choice(["en", "fr"])) for k in range(40)]
    rows += [(i, t, "odd") for i, t in ODD]
    labels = [(k, r.randint(0, 1), r.choice([0, 1, None]), "x") for k in range(0, 150, 2)] + [(2, 1, 0, "x"), (2, 0, 1, "x"), (None, 1, 1, "x")]
    docs = spark.createDataFrame([(i, t, p, "clash", "clash") for i, t, p in rows], PARTS).repartition(3)
    got = filter_audit.audit(docs, spark.createDataFrame(labels, LABELS))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert bag(got.collect()) == bag(plain_audit(rows, [x[:3] for x in labels]))
    empty = spark.createDataFrame([], PARTS)
    assert filter_audit.audit(empty, spark.createDataFrame([], LABELS)).collect() == []
    assert filter_audit.audit(docs, spark.createDataFrame([], LABELS)).filter("good_lost + toxic_lost > 0").count() == 0


def test_carry_save_counts():
    r = np.random.default_rng(5)
    planes, total = filter_audit.Planes(), np.zeros(32, np.int64)
    for n in (0, 1, 2, 3, 1000, 7, 4096):
        words = r.integers(0, 1 << 32, n, dtype=np.uint32)
        planes.add(words)
        total += ((words[:, None] >> np.arange(32, dtype=np.uint32)) & 1).sum(0, dtype=np.int64)
    assert (planes.counts() == total).all() and all(len(held) < 3 for held in planes.levels)


def test_many_parts_are_passed_on_in_time(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "GROUPS", 3)
    rows = [(k, "x y", f"p{k % 40}") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2)
    got = filter_audit.audit(docs, spark.createDataFrame([], LABELS)).filter("filter_order = 'ABCDE' AND step = 1")
    assert bag(got.select("part", "removed").collect()) == Counter({(f"p{k}", 5): 1 for k in range(40)})


# --- quality rules ----------------------------------------------------------------------------


def plain_symbols(text):
    out = []
    for w in re.split(r"[\x20\x09-\x0D]+", text or ""):
        if w:
            for c in w + " ":
                p = max(ord(c), 1)
                out.append(p if p < 4096 else 1024 + ((p * 2654435761 & 0xFFFFFFFF) >> 12) % 3072)
    return out


def plain_model(texts):
    """logp(context of 4 symbols, symbol) of interpolated modified Kneser-Ney, by dictionaries."""
    counts = {5: Counter()}
    for t in texts:
        s = [0] * 4 + plain_symbols(t)
        counts[5].update(tuple(s[k - 4 : k + 1]) for k in range(4, len(s)))
    for o in range(4, 0, -1):
        counts[o] = Counter(g[1:] for g in counts[o + 1])
    even = 1 / (len(counts[1]) + 1)
    off, total, weight = {}, Counter(), Counter()
    for o, c in counts.items():
        n = Counter(c.values())
        off[o] = perplexity.discounts(n[1], n[2], n[3], n[4])
        for g, k in c.items():
            total[g[:-1], o] += k
            weight[g[:-1], o] += off[o][min(k, 3) - 1]

    def p(context, symbol, o=5):
        if o == 0:
            return even
        context = context[len(context) - o + 1 :]
        low = p(context, symbol, o - 1)
        if not total[context, o]:
            return low
        k = counts[o][context + (symbol,)]
        own = max(k - off[o][min(k, 3) - 1], 0) if k else 0
        return (own + weight[context, o] * low) / total[context, o]

    return p, [g[0] for g in counts[1]]


def plain_base(text):
    t = text or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
    lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    windows = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    hit = {k + j for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)


@pytest.fixture(scope="module")
def prose():
    r = random.Random(12)
    vocab = ["".join(r.choice("abcdeé一丁") for _ in range(r.randint(1, 6))) for _ in range(200)]
    rows = [(k, " ".join(r.choice(vocab) for _ in range(r.choice([3, 40, 60, 120]))) + r.choice(["", "\n\n# <x>", "\nzz\nzz"]), r.choice(["en", "de", None]))
            for k in range(60)]
    rows += [(100 + k, "".join(chr(r.randint(0x5000, 0x5200)) + r.choice(["", " "]) for _ in range(400)), "en") for k in range(3)]
    rows += [(200 + k, rows[0][1], "de") for k in range(10)]
    return rows + [(i, t, "odd") for i, t in ODD] + [(600, "a\0b " * 60, "xx")]


WIDE = "doc_id long, text string, lang string, logp int, kept string"


def quality_frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "clash") for r in rows], WIDE).repartition(3)


def test_quality_rules(spark, prose):
    got = perplexity.judge(quality_frame(spark, prose), low=6.0, high=3.0).collect()
    p, _ = plain_model([t for _, t, _ in prose])
    rows = []
    for i, t, lang in prose:
        s = [0] * 4 + plain_symbols(t)
        logp = sum(math.log(p(tuple(s[k - 4 : k]), s[k])) for k in range(4, len(s)))
        base = plain_base(t)
        failed = base[0] < 50 or 100 * base[4] > 50 * base[0]
        rows.append((i, lang or "", *base, failed, -logp / (len(s) - 4) if len(s) > 4 else None))
    limits = {}
    middle = lambda v: sorted(v)[(len(v) - 1) // 2]
    for lang in {r[1] for r in rows}:
        steps = [math.floor(r[8] * 1000) for r in rows if r[1] == lang and not r[7]]
        if steps:
            m = middle(steps)
            s = max(1.4826 * middle([abs(x - m) for x in steps]) / 1000, 0.01)
            limits[lang] = (m + 0.5) / 1000 - 6 * s, (m + 0.5) / 1000 + 3 * s
    key = lambda r: tuple("" if x is None else str(x) for x in r)
    want = sorted(((*r[:8], r[8], not r[7] and limits[r[1]][0] <= r[8] <= limits[r[1]][1]) for r in rows), key=lambda r: key(r[:8]))
    have = sorted(((*[g[c] for c in ("doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")],
                    g["log_perplexity"], g["kept"]) for g in got), key=lambda r: key(r[:8]))
    assert [w[:8] for w in want] == [h[:8] for h in have] and [w[9] for w in want] == [h[9] for h in have]
    assert [w[8] is None for w in want] == [h[8] is None for h in have]
    assert [w[8] or 0.0 for w in want] == pytest.approx([h[8] or 0.0 for h in have], rel=1e-9)
    assert {h[0] for h in have if not h[7] and not h[9]} >= {100, 101, 102}


def test_a_model_too_large_to_broadcast_gives_the_same(spark, prose):
    docs = quality_frame(spark, prose)
    columns = ["doc_id", "n_words", "n_repeat_words", F.round("log_perplexity", 9).alias("x"), "kept"]
    joined = perplexity.judge(docs, broadcast=0).select(*columns).collect()
    assert bag(joined) == bag(perplexity.judge(docs).select(*columns).collect())


def test_probabilities_add_up_also_of_unseen_ngrams(spark, prose):
    texts = [t for _, t, _ in prose]
    p, symbols = plain_model(texts)
    counts = perplexity.count_ngrams(quality_frame(spark, prose), "text")
    grams, contexts = perplexity.kneser_ney(counts)
    model = perplexity.Model(grams, contexts, 1 / (len(symbols) + 1))
    r = random.Random(2)
    for context in [(0, 0, 0, 0), (97, 98, 32, 97), (1, 2, 3, 4), *[tuple(r.choice(symbols) for _ in range(4)) for _ in range(20)]]:
        keys = np.array([sum(x << 12 * (4 - j) for j, x in enumerate((*context, s))) for s in [*symbols, 4000]])
        got = np.exp(model.logp(keys))
        assert got.sum() == pytest.approx(1.0) and got == pytest.approx([p(context, s) for s in [*symbols, 4000]])


def test_pieces_of_long_texts(monkeypatch):
    text = " ".join(f"word{k % 17}" for k in range(500)).encode()
    whole = [k.tolist() for _, _, k in perplexity.ngrams([b"", text, b"x"])]
    monkeypatch.setattr(perplexity, "PIECE", 64)
    parts = list(perplexity.ngrams([b"", text, b"x"]))
    assert len(parts) > 20 and sum([k.tolist() for _, _, k in parts], []) == whole[0]
    assert all(len(k) <= 2 * 64 for _, _, k in parts)


def test_empty_table_and_single_documents(spark):
    assert perplexity.judge(quality_frame(spark, [])).collect() == []
    one = perplexity.judge(quality_frame(spark, [(1, "word other " * 10 + " ".join(f"w{k}" for k in range(60)), "xx"), (2, None, "yy")])).collect()
    assert {(r["doc_id"], r["kept"]) for r in one} == {(1, True), (2, False)}
