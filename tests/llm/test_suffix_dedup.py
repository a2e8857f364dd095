"""Repeated strings against a dictionary of every window."""

import hashlib

import numpy as np
import pytest

from corpusmill.llm import queries, repeats as R, suffix_dedup as S
from tests.llm import fixtures


def slow(docs):
    """docs: (id, text) in order. (n_bytes, n_removed, n_spans, sha256) of each."""
    seen, out = set(), []
    for _, text in docs:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - 99):
            w = raw[s : s + 100]
            if w in seen:
                gone[s : s + 100] = b"\x01" * 100
            seen.add(w)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def texts(seed=1):
    r = np.random.default_rng(seed)
    noise = lambda n: "".join(map(chr, r.integers(97, 123, n)))
    passage, long = noise(130), noise(900)
    out = [noise(400), passage, noise(50) + passage + noise(70), noise(20) + passage[10:] + noise(9), passage[:99], passage[:100], passage[30:] + passage]
    out += [long, long, long[:450] + "X" + long[451:], long[:300] + "YY" + long[300:], noise(10) + long[200:420] + noise(10) + long[380:700], "z" * 500, "z" * 230, "ab" * 300, "b" + "ab" * 120, "é" * 120, "xé" + "é" * 70]
    for _ in range(25):
        a, b = sorted(r.integers(0, 900, 2))
        out.append(noise(r.integers(0, 120)) + long[a:b] + noise(r.integers(0, 120)) + passage[r.integers(0, 30) :])
    return out


def got(spark, docs, schema="doc_id long, text string"):
    frame = spark.createDataFrame(docs, schema) if isinstance(docs, list) else docs
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in S.remove_repeats(frame).collect()}


def test_windows_share_their_anchor():
    """Equal windows have equal anchors, whatever surrounds them."""
    r = np.random.default_rng(0)
    core = r.integers(97, 100, 300).astype(np.uint8)
    found = []
    for _ in range(3):
        raw = np.concatenate([r.integers(97, 100, 40).astype(np.uint8), core, r.integers(97, 100, 40).astype(np.uint8)])
        _, _, first, count, anchor = R.cells(R.pointers(raw))
        of = np.repeat(anchor, count)
        assert len(of) == len(raw) - 99 and (np.repeat(first, count) + np.concatenate([np.arange(c) for c in count]) == np.arange(len(of))).all()
        found.append((of - np.arange(len(of)))[40 : 40 + 201].tolist())
    assert found[0] == found[1] == found[2]


def test_against_every_window(spark):
    docs = list(enumerate(texts()))
    want = dict(zip(range(len(docs)), slow(docs)))
    assert got(spark, docs[::-1]) == want


def test_blocks(spark, monkeypatch):
    docs = list(enumerate(texts(2)[:16]))
    want = slow(docs)
    for text, block in ((docs[7][1], 64), (docs[8][1], 333)):
        covered = [at + s for at, raw in S._parts(text, block) for s in range(len(raw) - 99)]
        assert covered == list(range(len(text) - 99))
    assert got(spark, docs) == dict(enumerate(want))


def test_awkward_documents(spark):
    small = [(i, t if len(t or "") < 20_000 else t[:3000]) for i, t in enumerate(fixtures.TEXTS)]
    assert got(spark, small) == dict(enumerate(slow(small)))
    rows = S.remove_repeats(fixtures.documents(spark)).collect()
    assert len(rows) == len(fixtures.TEXTS)
    assert S.remove_repeats(fixtures.empty(spark)).collect() == []


def test_ids_that_repeat_or_are_null(spark):
    a, b = "".join(map(chr, range(33, 127))) * 2, "x" * 50
    rows = S.remove_repeats(spark.createDataFrame([(None, a), (3, a), (3, b), (3, a), (None, None)], "doc_id long, text string")).collect()
    first = slow([(3, a), (3, a), (3, b), (None, None), (None, a)])
    want = sorted((str(i), *x) for i, x in zip([3, 3, 3, None, None], first))
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows) == want


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    rows = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in queries.QUERIES["op7_suffix_dedup"](spark, sf).collect()}
    assert rows == {d[0]: x for d, x in zip(docs, slow(docs))}
    assert sum(x[1] for x in rows.values()) > 0


def test_removed_runs():
    assert S.removed(500, [S._pack(np.int64(0), np.int64(1)), S._pack(np.int64(100), np.int64(3)), S._pack(np.int64(300), np.int64(1))]) == [(0, 202), (300, 400)]
    assert S.keep(b"abcdef", [(1, 3), (5, 6)]) == b"ade"
    with pytest.raises(IndexError):
        R.window_ids(R.pointers(np.zeros(120, np.uint8)), np.array([30]))
