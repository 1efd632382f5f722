"""Operators on documents against plain versions, with odd rows, and the pipeline stage by stage."""

import hashlib
import math
import random
from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from tickerweave.llm import byte_bpe, decontaminate, labelled, language_model, line_dedup, near_dup, quality, token_counts, tokens, toxicity

ODD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one\n"), (6, "\n\nOne \n two"), (7, "ÀÉ one ß"), (None, "one\ntwo"),
    (8, "same row"), (8, "same row"), (9, "first text"), (9, "second text\none"), (10, "x " * 3000), (11, "word\x1cword\x85 two"),
]
SCHEMA = "doc_id long, text string"


def frame(spark, rows, extra=()):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for name in extra:
        df = df.withColumn(name, F.lit("clash"))
    return df


def bag(rows):
    return Counter(tuple(r) for r in rows)


@pytest.fixture(scope="module")
def many():
    """Random texts with shared lines, copies and near copies."""
    r = random.Random(4)
    vocab = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 6))) for _ in range(300)]
    sentence = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    common = [sentence(6) for _ in range(4)]
    rows = []
    for k in range(120):
        ls = [sentence(r.randint(1, 15)) for _ in range(r.randint(1, 6))]
        if r.random() < 0.3:
            ls.insert(r.randint(0, len(ls)), r.choice([" ", ""]) + r.choice(common).upper() + r.choice(["", "\t"]))
        rows.append((100 + k, "\n".join(ls)))
    base = sentence(60).split()
    for k in range(40):  # a drifting chain: neighbours are alike, ends are not
        base[r.randrange(len(base))] = r.choice(vocab)
        rows.append((300 + k, " ".join(base)))
    rows += [(400 + k, rows[k % 7][1]) for k in range(30)]
    return rows + ODD


def test_line_dedup(spark, many):
    got = line_dedup.dedup_lines(frame(spark, many, ["n_lines", "extra"]), min_docs=5)
    assert set(got.columns) == {"doc_id", "text", "n_lines", "n_dropped", "extra"}
    rows = got.select("doc_id", "n_lines", "n_dropped", "text").collect()
    assert bag(rows) == bag(brute.lines(many, 5))
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0


def test_decontamination(spark, many):
    items = [(1, many[0][1]), (2, many[3][1]), (3, "one"), (4, None), (5, ""), (None, many[5][1].upper()), (6, many[0][1])]
    items += [(7, "short words"), (8, many[125][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = bag(brute.contamination(many, items))
    for block in (1 << 20, 600):  # one automaton, and several
        got = decontaminate.find_contamination(frame(spark, many, ["n_hit", "spans"]), bench, block_bytes=block)
        rows = got.collect()
        assert bag((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows) == want
        for r in rows:
            for s in r.spans:
                part = brute.bench_words(r.text[s.start : s.end])
                assert part and brute.bench_words(r.text[: s.start]) + part + brute.bench_words(r.text[s.end :]) == brute.bench_words(r.text)
    none = decontaminate.find_contamination(frame(spark, many), bench.limit(0))
    assert none.filter("contaminated").count() == 0 and none.count() == len(many)
    assert decontaminate.find_contamination(frame(spark, []), bench).count() == 0


TEXTS = [t for _, t in ODD] + [
    "Hello  world!!  \n\n  it's we'll 123abc  ", "　wide space \xa0x", "日本語 Ελλάδα 🙂🙂 á", " " * 50, "a" * 700, "\t\r\n x\x0by",
    "don't'S 'T  's\n's \n 's", "x\n y", "end \n", "\nstart", "<|endoftext|>", "\x00\x01\x7f",
]


def test_byte_bpe(spark, many):
    rows = [(k, t) for k, t in enumerate(TEXTS + [t for _, t in many])]
    own = tokens.encoder(tokens.read_ranks())
    for frequent in (100, 400_000):
        out = byte_bpe.encode_texts(frame(spark, rows, ["ids"]), frequent=frequent)
        got = out.withColumn("back", byte_bpe.decode_ids(F.col("ids"))).collect()
        assert len(got) == len(rows)
        for r in got:
            assert r.ids == own.encode_ordinary(rows[r.doc_id][1] or ""), rows[r.doc_id]
            assert bytes(r.back).decode() == (rows[r.doc_id][1] or "")
    assert byte_bpe.encode_texts(frame(spark, [])).count() == 0


def test_byte_bpe_spells_ids_and_what_they_decode_to(spark):
    rows = [*enumerate(TEXTS), (0, "twice"), (None, "no id")]
    got = byte_bpe.encode_texts(frame(spark, rows, ["ids_text"]), keep_text=False, back=True).collect()
    own = tokens.encoder(tokens.read_ranks())
    want = [own.encode_ordinary(t or "") for _, t in rows]
    assert bag((r.doc_id, tuple(r.ids), r.ids_text, bytes(r.ids_bytes)) for r in got) == bag(
        (k, tuple(ids), " ".join(map(str, ids)), (t or "").encode()) for (k, t), ids in zip(rows, want, strict=True))


def test_byte_bpe_table_gives_each_pair_a_place():
    entries = {(a + 1) << 17 | b: (a * 31 + b) % 50_000 for a in range(0, 9_000, 7) for b in range(0, 50_000, 997)}
    shifts, cells, n = byte_bpe._table(entries)
    for key, value in entries.items():
        assert cells[key % n + shifts[key % len(shifts)]] == key << 17 | value
    assert len(cells) <= 1.6 * len(entries) and len(cells) - cells.count(0) == len(entries)


def test_near_duplicates(spark, many):
    merged = []  # rows that share an id are one node: the plain version wants them to be alike
    for i, t in many:
        merged.append((i, t) if i != 9 else (9, "second text\none"))
    got = near_dup.near_duplicates(frame(spark, merged, ["kept"])).collect()
    assert bag(got) == bag(brute.near(merged))
    assert near_dup.near_duplicates(frame(spark, [])).count() == 0
    two = near_dup.near_duplicates(frame(spark, [(9, "a b c"), (9, "d e f"), (12, "d e f"), (5, "a b c")])).collect()
    assert {r.component_id for r in two} == {5}


def test_min_max_estimates():
    r = np.random.default_rng(0)
    a = r.integers(0, 2**63, 400, dtype=np.uint64)
    b = np.concatenate([a[:320], r.integers(0, 2**63, 80, dtype=np.uint64)])
    family = near_dup.MinMax(512)
    (la, ha), (lb, hb) = family.signature(a), family.signature(b)
    assert abs(np.r_[la == lb, ha == hb].mean() - 320 / 480) < 0.06


def test_language_model(spark, many):
    rows = [(i, t) for i, t in many]
    learn = F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(3)) != 0
    got = language_model.score_documents(frame(spark, rows, ["score"]), learn, vocabulary=40, words=90, passes=2).collect()
    train = Counter()
    for i, t in rows:
        if (i or 0) % 3:
            train.update(language_model.tokens(t))
    n, v = sum(train.values()), len(train)
    want = {}
    for i, t in rows:
        ts = language_model.tokens(t)
        base = sum(math.log10((train[w] + 1) / (n + v + 1)) for w in ts)
        want.setdefault(i, []).append((len(ts), sum(train[w] > 0 for w in ts), n, round(base, 6)))
    have = {}
    for r in got:
        have.setdefault(r.doc_id, []).append((r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)))
        assert math.isfinite(r.score) and r.score < 0
    assert {k: sorted(x) for k, x in have.items()} == {k: sorted(x) for k, x in want.items()}
    assert sum(r.score for r in got) > sum(r.base_score for r in got)
    blank = language_model.score_documents(frame(spark, rows), F.lit(False)).collect()
    assert len(blank) == len(rows) and all(r.n_known == 0 and r.train_tokens == 0 for r in blank)
    assert language_model.score_documents(frame(spark, []), F.lit(True)).count() == 0


def test_language_model_learns_from_every_window(spark):
    """What follows the first window of each text is learned as well."""
    rows = [(k, "a b " * 8 + "c d " * 120) for k in range(24)] + [(100, "c d " * 50)]
    got = language_model.score_documents(frame(spark, rows), F.col("doc_id") < 100, passes=1).filter("doc_id = 100").first()
    assert got.score > got.base_score + 5


def test_network_is_a_distribution_with_true_gradients():
    net = language_model.Network([3, 5, 2, 7, 1, 4, 9], hidden=3, seed=1)
    draw = np.random.default_rng(2)
    net.put([(a + draw.standard_normal(a.shape) * 0.3).astype(np.float64) for a in net.get()])
    state = draw.standard_normal((1, 3))
    total = sum(np.exp(net.log_probability(state, np.array([k]))[0]) for k in range(7))
    pad = net.classes * net.width - 7
    assert total <= 1 + 1e-9 and (pad or abs(total - 1) < 1e-6)
    ids, fresh = np.array([[1, 2], [3, 4], [5, 6], [0, 1]]), np.array([[True, True], [False, False], [False, True], [False, False]])
    use = np.array([[True, True], [True, True], [True, True], [True, False]])

    def loss():
        states, _ = net.states(ids, fresh, np.zeros((2, 3)))
        return -net.log_probability(states.reshape(-1, 3).astype(np.float64), ids.ravel())[use.ravel()].mean()

    g, _ = net.gradients(ids, fresh, np.zeros((2, 3)), use)
    for name in ("wh", "wx", "b", "wc"):
        weight = getattr(net, name)
        for at in [tuple(0 for _ in weight.shape), tuple(n - 1 for n in weight.shape)]:
            keep = weight[at]
            weight[at] = keep + 0.01
            up = loss()
            weight[at] = keep - 0.01
            slope = (up - loss()) / 0.02
            weight[at] = keep
            assert abs(slope - g[name][at]) < 2e-3, name


def test_token_counts(spark, many):
    own = tokens.encoder(tokens.read_ranks())
    rows = [(k, t) for k, (_, t) in enumerate(many)] + [(1000 + k, t) for k, t in enumerate(TEXTS)]
    texts = dict(rows)
    for rule in token_counts.RULES:
        got = token_counts.count_tokens(frame(spark, rows, ["n_tokens"]), rule=rule).collect()
        assert len(got) == len(rows)
        for r in got:
            text = texts[r.doc_id] or ""
            ids = own.encode_ordinary(text)
            spans = token_counts.line_sections(text)
            assert "".join(text[a:b] for a, b in spans) == text
            count, crossing, at = [0] * len(spans), 0, 0
            owner = [k for k, (a, b) in enumerate(spans) for _ in text[a:b].encode()]
            for piece in own.decode_tokens_bytes(ids):
                inside = owner[at : at + len(piece)]
                at += len(piece)
                crossing += inside[0] != inside[-1]
                pick = {"first": inside[0], "last": inside[-1], "largest": max(sorted(set(inside)), key=inside.count)}[rule]
                count[pick] += 1
            assert (r.n_tokens, r.n_crossing, r.n_sections, r.section_tokens) == (len(ids), crossing, len(spans), count)
    assert token_counts.count_tokens(frame(spark, [])).count() == 0


def auc(rows):
    ranked = sorted(rows)
    pos = [k for k, (_, y) in enumerate(ranked) if y]
    return (sum(pos) - len(pos) * (len(pos) - 1) / 2) / (len(pos) * (len(rows) - len(pos)))


@pytest.mark.parametrize("name,label,folds,held,least", [("quality", "quality", 5, 0, 0.95), ("toxicity", "toxic", 3, 1, 0.8)])
def test_classifiers(spark, name, label, folds, held, least):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    may = labelled.fold("doc_id", folds) != held
    module = {"quality": quality, "toxicity": toxicity}[name]
    score = getattr(module, f"score_{name}")
    model = module.learn(docs, labels, may)
    got = score(docs, model).join(labels, "doc_id").select("doc_id", "score", "predicted", label).collect()
    assert auc([(r.score, r[label]) for r in got if brute.fold(r.doc_id, folds) == held]) > least
    odd = score(frame(spark, ODD, ["score"]), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r.score <= 1 for r in odd)
    assert score(frame(spark, []), model).count() == 0
    # Labels that may not be learned from have no part in the model.
    other = labels.withColumn(label, F.when(may, F.col(label)).otherwise(1 - F.col(label)))
    again = {r.doc_id: r.score for r in score(docs, module.learn(docs, other, may)).select("doc_id", "score").collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-9 for r in got)
    none = module.learn(docs.limit(0), labels.limit(0), may)
    assert score(docs, none).select(F.countDistinct("score")).first()[0] == 1


def test_pipeline(spark):
    import corpus_pipeline as pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    own = tokens.encoder(tokens.read_ranks())
    texts = lambda df: [(r.doc_id, r.text) for r in df.collect()]
    before = docs
    for k, (_, stage) in enumerate(pipeline.STAGES):
        after = line_dedup.write_once(stage(spark, before, sf), "stage")
        rows = texts(before)
        if k < 4:
            assert after.columns == docs.columns
        if k == 0:
            good = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1").collect()}
            kept = dict(texts(after))
            assert all(dict(rows)[i] == t for i, t in kept.items())
            assert len(good & set(kept)) >= 0.97 * len(good & {i for i, _ in rows}) and len(kept) < len(rows)
        elif k == 1:
            assert bag(texts(after)) == bag((i, t) for i, _, _, t in brute.lines(rows))
        elif k == 2:
            keep = {i for i, _, _, kept in brute.near(rows) if kept}
            assert bag(texts(after)) == bag(r for r in rows if r[0] in keep)
        elif k == 3:
            clean = {r[0] for r in brute.contamination(rows, bench) if not r[5]}
            assert bag(texts(after)) == bag(r for r in rows if r[0] in clean)
        else:
            want = {i: own.encode_ordinary(t) for i, t in rows}
            got = after.collect()
            assert {r.doc_id: r.ids for r in got} == want
            assert all(r.decoded_sha256 == hashlib.sha256(dict(rows)[r.doc_id].encode()).hexdigest() for r in got)
        before = after


def test_one_of_each_group_with_repeated_ids(spark):
    import corpus_pipeline as pipeline

    rows = frame(spark, [(1, "a b c"), (1, "a b c"), (2, "a b c"), (3, "x"), (None, "a b c"), (None, None), (4, None), (4, "y z")])
    got = pipeline.keep_one_of_each_group(spark, rows, "").collect()
    assert Counter(r.doc_id for r in got) == Counter({1: 1, 3: 1, None: 2, 4: 1})
