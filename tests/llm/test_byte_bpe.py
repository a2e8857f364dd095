"""Byte-level BPE: exact round trips, and the library on whole texts."""

import base64
import hashlib

import numpy as np
import public_tokenizers as P
import regex
import tiktoken
from hypothesis import given, settings, strategies as st

from corpusmill.llm import byte_bpe, queries
from tests.llm import fixtures

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
with open(RANKS, "rb") as f:
    RAW = f.read()
CODER = byte_bpe.ByteBPE(RAW, P.PATTERN)
TABLE = {base64.b64decode(a): int(b) for a, b in map(bytes.split, RAW.splitlines())}
WHOLE = tiktoken.Encoding("whole", pat_str=P.PATTERN, mergeable_ranks=TABLE, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(" \t\n\r\x1c\x85  ab'sré漢1.!|"), max_size=60), st.integers(1, 7))
def test_parts_encode_as_the_whole(text, chunk):
    assert CODER.encode(text, chunk) == WHOLE.encode_ordinary(text)
    assert CODER.decode_bytes(CODER.encode(text, chunk)) == text.encode()


def test_long_runs(monkeypatch):
    for text in (" " * 9000 + "x", "x" + "\n" * 9000, "a " * 9000, "!" * 50_000, "a" * 100_000, " " * 5000 + "\n" * 5000 + " b", "word " * 40_000):
        assert CODER.encode(text) == WHOLE.encode_ordinary(text)
    millions = " " * 3_000_000 + "tail"
    assert CODER.decode_bytes(CODER.encode(millions)) == millions.encode()


def test_fallback_splits_alike(monkeypatch):
    class Broken:
        _core_bpe = WHOLE._core_bpe

        def encode_ordinary(self, text):
            raise ValueError

    text = " it's 12,\x1c   x \n\n y'll 漢字 \t"
    own = byte_bpe.ByteBPE(RAW, P.PATTERN)
    own.library = Broken()
    assert own.encode(text) == WHOLE.encode_ordinary(text)


def test_tables(spark):
    docs = fixtures.documents(spark)
    got = {r["doc_id"]: r for r in byte_bpe.encode_table(docs, RANKS, P.PATTERN).collect()}
    digest = {r["doc_id"]: r for r in byte_bpe.digest_table(docs, RANKS, P.PATTERN).collect()}
    back = {r["doc_id"]: r["text"] for r in byte_bpe.decode_table(byte_bpe.encode_table(docs, RANKS, P.PATTERN), RANKS, P.PATTERN).collect()}
    for r in docs.collect():
        text, ids = r["text"] or "", WHOLE.encode_ordinary(r["text"] or "")
        assert list(got[r["doc_id"]]["ids"]) == ids and got[r["doc_id"]]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest() and back[r["doc_id"]] == text
        d = digest[r["doc_id"]]
        assert (d["n_tokens"], d["ids_sha256"], d["decoded_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert byte_bpe.digest_table(fixtures.empty(spark), RANKS, P.PATTERN).collect() == []


def test_null_key_and_raw_bytes(spark):
    rows = byte_bpe.digest_table(spark.createDataFrame([(None, "x"), (2**60 + 1, "y")], "doc_id long, text string"), RANKS, P.PATTERN).collect()
    assert sorted(r["doc_id"] or 0 for r in rows) == [0, 2**60 + 1]
    half = CODER.encode("é")[:1] if len(CODER.encode("é")) > 1 else [TABLE[b"\xc3"]]
    assert CODER.decode(half) == "�"


def test_query_covers_the_table(spark):
    sf = "/root/testdata/sf0.001"
    assert queries.QUERIES["op3_byte_bpe"](spark, sf).count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert regex.findall(P.PATTERN, "it's") == ["it", "'s"]
