"""Near-duplicate vectors and WARC archives."""

import base64
import gzip
import hashlib
import math

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from tickerweave.llm import vector_dup, warc


@pytest.mark.parametrize("dim", [5, 64])
def test_near_vectors(spark, dim):
    r = np.random.default_rng(dim)
    rows = [(k, r.standard_normal(dim).tolist()) for k in range(150)]
    centre = r.standard_normal(dim)
    rows += [(200 + k, (centre + r.standard_normal(dim) * (0.2 + 0.004 * k)).tolist()) for k in range(60)]
    rows += [(300 + k, (centre * 2.0).tolist()) for k in range(20)] + [(5, rows[5][1])]
    good = list(rows)
    bad = [(400, None), (401, [0.0] * dim), (402, [math.nan] * dim), (403, [math.inf] + [1.0] * (dim - 1)), (404, []), (None, rows[0][1])]
    bad.append((405, [None] + [1.0] * (dim - 1)))
    rows += bad + [(406, [1.0] * (dim + 1)), (407, [2.0] * (dim + 1)), (408, [1e300] * dim)]
    good.append((408, [1e300] * dim))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("n_links", F.lit("clash")).repartition(4)
    got = vector_dup.near_vectors(df, block_rows=40).collect()
    assert len(got) == len(rows)
    x = np.array([v for _, v in good])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    ids = [i for i, _ in good]
    label = brute.reach(set(ids), [(ids[a], ids[b]) for a, b in zip(*np.nonzero(near), strict=True)])
    want = sorted((i, int(near[k].sum()), label[i], label[i] == i) for k, i in enumerate(ids))
    want += [(i, 0, i, True) for i in (400, 401, 402, 403, 404, 405)] + [(406, 1, 406, True), (407, 1, 406, False)]
    assert sorted(tuple(g) for g in got if g.vec_id is not None) == sorted(want)
    assert [tuple(g) for g in got if g.vec_id is None] == [(None, 0, None, True)]
    assert vector_dup.near_vectors(df.limit(0)).count() == 0


PAGES = [(1, "http://a", "<p>x</p>"), (2, "http://b\r\nX: y", "<p>x</p>"), (3, None, None), (4, "http://d", ""), (5, "http://é", "WARC/1.1\r\nü" * 40),
         (6, "u", "line\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n"), (7, "u", "solo"), (7, "u", "solo"), (None, "u", "<p>x</p>"), (8, "u", "z" * 50_000)]


def digest(raw):
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


@pytest.mark.parametrize("least", [0, 5])
def test_archives_round_trip(spark, least):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3)
    folder = warc.write_archives(pages, min_bytes=least, records_per_file=2)
    got = warc.read_archives(spark, folder, with_payload=True).collect()
    bodies = [(i, (b or "").encode()) for i, _, b in PAGES]
    want = []
    for i, raw in bodies:
        top = max((j for j, other in bodies if other == raw and j is not None), default=None)
        revisit = i is not None and len(raw) >= least and i < top
        want.append((f"<urn:page:{'' if i is None else i}>", "revisit" if revisit else "response", len(raw), digest(raw),
                     f"<urn:page:{top}>" if revisit else None, b"" if revisit else raw))
    have = [(r.record_id, r.kind, r.payload_bytes, r.payload_digest, r.refers_to, bytes(r.payload)) for r in got]
    assert sorted(have, key=str) == sorted(want, key=str)
    empty = warc.write_archives(pages.limit(0))
    assert warc.read_archives(spark, empty).count() == 0


def record(n, body=b"payload"):
    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{n}>\r\nWARC-Payload-Digest: sha1:{digest(body)}\r\nContent-Length: {len(body)}\r\n\r\n"
    return head.encode() + body + b"\r\n\r\n"


def summary(data):
    found = list(warc.salvage(data))
    at = 0
    for offset, length, _ in found:  # every byte is in a record or a gap
        assert offset == at
        at += length
    assert at == len(data)
    return [f["kind"] if f["kind"] == "gap" else f["record_id"] for _, _, f in found]


def test_salvage_plain():
    parts = [record(k) for k in range(5)]
    assert summary(b"".join(parts)) == [f"<urn:page:{k}>" for k in range(5)]
    assert summary(b"") == [] and summary(b"junk") == ["gap"]
    flipped = parts[1].replace(b"payload\r\n\r\n", b"paYload\r\n\r\n")
    assert summary(parts[0] + flipped + parts[2]) == ["<urn:page:0>", "gap", "<urn:page:2>"]
    assert summary(parts[0] + parts[1][:-20] + parts[2]) == ["<urn:page:0>", "gap", "<urn:page:2>"]
    assert summary(parts[0] + parts[1][30:] + b"x" * 10 + b"\r\n" + parts[2]) == ["<urn:page:0>", "gap", "<urn:page:2>"]
    assert summary(parts[0] + parts[1][:60]) == ["<urn:page:0>", "gap"]
    assert summary(parts[0] + parts[1].replace(b"Length: 7", b"Length: x") + parts[2]) == ["<urn:page:0>", "gap", "<urn:page:2>"]


def test_salvage_members():
    parts = [gzip.compress(record(k, b"body" * 30_000)) for k in range(4)]
    names = [f"<urn:page:{k}>" for k in range(4)]
    assert summary(b"".join(parts)) == names
    hurt = bytearray(parts[1])
    hurt[len(hurt) // 2] ^= 0xFF
    assert summary(parts[0] + bytes(hurt) + parts[2]) == [names[0], "gap", names[2]]
    assert summary(parts[0] + parts[1][:-9] + parts[2] + record(9)) == [names[0], "gap", names[2], "<urn:page:9>"]
    assert summary(parts[3][:40]) == ["gap"]
