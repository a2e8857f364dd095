"""Byte-level BPE: encoding and decoding with the tiktoken library and a local rank file.

Free style (mapInArrow): one narrow pass, no shuffle. The driver's rank file is sent to the executors
once, as a broadcast of its bytes (the vocabulary's size bounds it); each Python worker builds the
encoder once and keeps it.

A long text is cut at safe boundaries, where no match of the splitting pattern can stand on both
sides, and encoded piece by piece, so memory follows the longest piece. Two boundaries are safe: between a
character that is not white space and one that is; and before the last character of a run of white space
that something else follows. A run of white space too long for the library's regular expression is merged
as one piece, as the pattern would match it; a text on which the library still gives up is split by the
`regex` module instead.

Cases: null and empty texts have no ids. Ids are int32. Invalid ids raise. Rows are independent: repeated
rows give equal results, extra columns are not passed on by encode_table, and an empty table gives an
empty result. Batches are worked on ROWS rows at a time, one text after another.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

#: Characters after which a text is cut at the next safe boundary.
CHUNK = 65_536
#: Longest run of white space that is left to the library's regular expression.
LONG_SPACE = 4_096

#: Unicode's White_Space, as the library's \s has it; Python's \s also takes U+001C to U+001F.
_WS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_INNER = re.compile(f"(?<=[^{_WS}])(?=[{_WS}])|(?<=[{_WS}])(?=[{_WS}][^{_WS}])")
_SPACES = re.compile(f"[{_WS}]{{{LONG_SPACE},}}")


class ByteBPE:
    """encode, decode and decode_bytes for one rank file."""

    def __init__(self, ranks: bytes, pattern: str):
        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        self.pattern = pattern
        self.library = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def _split(self, text: str) -> list[int]:
        try:
            return self.library.encode_ordinary(text)
        except BaseException as x:  # the library's regular expression overflows: a panic, which is no Exception
            if not isinstance(x, Exception) and type(x).__name__ != "PanicException":
                raise
            same = self.pattern.replace("\\s", r"\p{White_Space}").replace("\\S", r"\P{White_Space}")
            return [i for m in regex.finditer(same, text) for i in self._one(m[0])]

    def _one(self, match: str) -> list[int]:
        return self.library._core_bpe.encode_single_piece(match.encode())

    def encode(self, text: str | None, chunk: int = CHUNK) -> list[int]:
        ids: list[int] = []
        for part, is_space in safe_parts(text or "", chunk):
            ids += self._one(part) if is_space else self._split(part)
        return ids

    def decode_bytes(self, ids: list[int]) -> bytes:
        return self.library.decode_bytes(ids)

    def decode(self, ids: list[int]) -> str:
        """The text; bytes that are not UTF-8 become the replacement character."""
        return self.decode_bytes(ids).decode("utf-8", errors="replace")


def _cut(text: str, chunk: int) -> Iterator[tuple[str, bool]]:
    start = 0
    while len(text) - start > chunk and (found := _INNER.search(text, start + chunk)):
        yield text[start : found.start()], False
        start = found.start()
    yield text[start:], False


def safe_parts(text: str, chunk: int = CHUNK) -> Iterator[tuple[str, bool]]:
    """The text in parts whose encodings, one after another, are the encoding of the whole; true for a
    long run of white space, which is one match of the pattern."""
    start = 0
    for run in _SPACES.finditer(text):
        # The pattern leaves the last character of a run to what follows it.
        end = run.end() if run.end() == len(text) else run.end() - 1
        if run.start() > start:
            yield from _cut(text[start : run.start()], chunk)
        yield text[run.start() : end], True
        start = end
    yield from _cut(text[start:], chunk)


@lru_cache(maxsize=2)
def _encoder(ranks: bytes, pattern: str) -> ByteBPE:
    return ByteBPE(ranks, pattern)


#: Rows whose ids are held at once.
ROWS = 256


def _mapped(rows: DataFrame, ranks: str, pattern: str, schema: str, columns) -> DataFrame:
    """rows (key, value) by ROWS of an Arrow batch: the key as it is, beside columns(encoder, values)."""
    with open(ranks, "rb") as f:  # the vocabulary lies on the driver
        shared = rows.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(shared.value, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                made = columns(coder, part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), *made.values()], names=[batch.schema.names[0], *made])

    key, kind = rows.dtypes[0]
    return rows.mapInArrow(run, f"`{key}` {kind}, {schema}")


def encode_table(documents: DataFrame, ranks: str, pattern: str, text: str = "text", key: str = "doc_id", ids: bool = True) -> DataFrame:
    """key, n_tokens, ids (array of int; left out if not ids), ids_sha256, and decoded_sha256 (of the bytes that the ids
    decode to) of every row. A text's ids are one buffer; digests are taken beside the encoder, so that bytes needn't travel."""

    def columns(coder: ByteBPE, texts: pa.Array) -> dict[str, pa.Array]:
        n, held, first, second = [], [], [], []
        for t in texts:
            found = coder.encode(t.as_py())
            raw = np.asarray(found, dtype="<u4")
            n.append(len(found))
            if ids:
                held.append(raw.view("<i4"))
            first.append(hashlib.sha256(raw).hexdigest())
            second.append(hashlib.sha256(coder.decode_bytes(found)).hexdigest())
        out = {"n_tokens": pa.array(n, pa.int64())}
        if ids:
            ends = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
            out["ids"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(held)))
        return out | {"ids_sha256": pa.array(first, pa.string()), "decoded_sha256": pa.array(second, pa.string())}

    schema = f"n_tokens long, {'ids array<int>, ' if ids else ''}ids_sha256 string, decoded_sha256 string"
    return _mapped(documents.select(key, text), ranks, pattern, schema, columns)


def digest_table(documents: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row."""
    return encode_table(documents, ranks, pattern, ids=False)


def decode_table(encoded: DataFrame, ranks: str, pattern: str, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """key and text of every row of ids; null ids are none."""

    def columns(coder: ByteBPE, values: pa.Array) -> dict[str, pa.Array]:
        return {"text": pa.array([coder.decode(x.as_py() or []) for x in values], pa.string())}

    return _mapped(encoded.select(key, ids), ranks, pattern, "text string", columns)
