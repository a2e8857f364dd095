"""Repeated byte strings: bucket-pointer refinement of a sparse suffix order.

Free style. Every byte covered by a string of LENGTH bytes that also starts earlier (smaller id, or the same
document further left) is removed; strings never cross documents. Nothing is approximated or capped.

Buckets are refined as in bucket-pointer refinement (Schuermann and Stoye, 2007): a place's 4-byte bucket
is paired with the bucket of a later offset, and the new pointers are used again for the next, doubled
length (repeats.pointers). Bucket names are made from the bytes, so tasks agree on them without a global
order, and all refinement up to 64 bytes happens inside one text. What has to be compared between
documents is only a sample of the places:

1. A window (LENGTH bytes) is filed under its anchor, the place of its least 32-byte bucket. Neighbouring
   windows share anchors, so there is about one run of windows in 32 bytes.
2. Runs are refined: bucket of the core (bytes that all windows of the run hold) first. Cores that stand once
   are finished, as singleton buckets are. The others are refined by the hull (all bytes of the run): of equal
   hulls, all but the earliest run are repeats as a whole. Where one core has several hulls, the earliest run of
   each hull goes on.
3. These runs are split at fixed offsets from the anchor and refined again in the same way, then down to
   single windows, whose bucket is the window itself.

Every refinement is an aggregation (partial sums first, so a bucket with very many copies shrinks before it
travels) and joins of written tables, which adaptive execution can split where a bucket is hot. Texts are
shuffled twice: to the runs that are split, and to the spans that are removed.

Bucket names of 64 bits are compared only between places whose cores agree already; single windows have 128 bits.

Cases: a null text is empty; texts shorter than LENGTH keep all bytes. A null id counts as the largest. If ids
repeat or are null, rows are first numbered by (id, text), and rows with both equal are told apart by that number,
so each row is a document of its own. Texts are read whole; extra columns are not passed on by
remove_repeats(); an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import Scratch
from .common import whole
from .repeats import LENGTH, PLACE, cells, nodes, pointers, window_ids

#: Longest part of a text that is read at once; parts overlap by LENGTH - 1 bytes.
BLOCK = 1 << (PLACE - 1)


def _parts(text: str, block: int = BLOCK) -> Iterator[tuple[int, np.ndarray]]:
    raw = np.frombuffer(text.encode(), np.uint8)
    for at in range(0, len(raw) - LENGTH + 1, block):
        yield at, raw[at : at + block + LENGTH - 1]


def _batch(columns: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in columns], names=names)


def _runs(texts: list[str], block: int = BLOCK) -> Iterator[tuple[int, int, dict, tuple]]:
    """(row, offset of the part, pointers, cells) of all parts."""
    for row, text in enumerate(texts):
        for at, raw in _parts(text, block):
            p = pointers(raw)
            yield row, at, p, cells(p)


def _pack(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """A run's place; places order as their first starts do."""
    return first << 8 | count


def all_cores(rows: DataFrame) -> DataFrame:
    """core and n: how often a batch holds it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [c[0] for _, _, _, c in _runs(batch.column(1).to_pylist())]
            if found:
                core, n = np.unique(np.concatenate(found), return_counts=True)
                yield _batch([core, n], ["core", "n"])

    return rows.mapInArrow(run, "core long, n long")


def all_runs(rows: DataFrame) -> DataFrame:
    """core, hull, doc and place of every run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, out = batch.column(0).to_numpy(), []
            for row, at, _, (core, hull, first, count, _) in _runs(batch.column(1).to_pylist()):
                out.append((core, hull, np.full(len(core), docs[row]), _pack(first + at, count)))
            if out:
                yield _batch([np.concatenate(c) for c in zip(*out)], ["core", "hull", "doc", "place"])

    return rows.mapInArrow(run, "core long, hull long, doc long, place long")


def _struct(*names: str) -> Column:
    return F.struct(*(F.col(n) for n in names))


def refine(scratch: Scratch, runs: DataFrame, repeated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Runs that repeat an earlier one as a whole (doc, place); the earliest run of each hull whose core has others
    (core, hull, doc, place). repeated: the cores that stand twice or more."""
    held = scratch.put(runs.join(repeated, "core", "left_semi"), "held")
    hulls = scratch.put(held.groupBy("core", "hull").agg(F.min(_struct("doc", "place")).alias("least"), F.count("*").alias("n")), "hulls")
    several = scratch.put(hulls.groupBy("core").agg(F.count("*").alias("hulls")).where("hulls > 1").select("core"), "several")
    met = held.join(hulls.where("n > 1").select("core", "hull", "least"), ["core", "hull"])
    whole_runs = scratch.put(met.where(_struct("doc", "place") != F.col("least")).select("doc", "place"), "repeats")
    rest = scratch.put(hulls.join(several, "core", "left_semi").select("core", "hull", "least.doc", "least.place"), "rest")
    scratch.drop(held, hulls, several)
    return whole_runs, rest


def split_runs(rows: DataFrame, rest: DataFrame) -> DataFrame:
    """core, hull, doc, place and bytes of the nodes of the runs in rest."""
    wanted = rest.groupBy("doc").agg(F.collect_list("place").alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, out, raws = batch.column(0).to_numpy(), [], []
            places = batch.column(2).to_pylist()
            texts = batch.column(1).to_pylist()
            encoded: tuple[int, bytes] = (-1, b"")
            for row, at, p, (_, _, first, count, anchor) in _runs(texts):
                mine = np.isin(_pack(first + at, count), np.array(places[row], dtype=np.int64))
                core, hull, start, n = nodes(p, first[mine], count[mine], anchor[mine])
                out.append((core, hull, np.full(len(core), docs[row]), _pack(start + at, n)))
                if encoded[0] != row:
                    encoded = (row, texts[row].encode())
                raws += [encoded[1][s : s + k + LENGTH - 1] for s, k in zip((start + at).tolist(), n.tolist())]
            if out:
                made = _batch([np.concatenate(c) for c in zip(*out)], ["core", "hull", "doc", "place"])
                yield pa.RecordBatch.from_arrays([*made.columns, pa.array(raws, pa.binary())], names=["core", "hull", "doc", "place", "bytes"])

    return rows.join(wanted, "doc").select("doc", "text", "places").mapInArrow(run, "core long, hull long, doc long, place long, bytes binary")


def all_windows(held: DataFrame) -> DataFrame:
    """id, id2, doc and place of every window of the nodes in held (doc, place, bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, places = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(docs):
                continue
            count = places & 255
            raw = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8)
            ends = (count + LENGTH - 1).cumsum()
            step = np.arange(count.sum()) - np.repeat(count.cumsum() - count, count)
            one, two = window_ids(pointers(raw), np.repeat(ends - count - LENGTH + 1, count) + step)
            starts = np.repeat(places >> 8, count) + step
            yield _batch([one, two, np.repeat(docs, count), _pack(starts, np.ones(len(starts), np.int64))], ["id", "id2", "doc", "place"])

    return held.mapInArrow(run, "id long, id2 long, doc long, place long")


def repeated_runs(scratch: Scratch, rows: DataFrame) -> list[DataFrame]:
    """Tables of (doc, place): runs of windows that all start earlier elsewhere too; together, all such windows."""
    twice = lambda t: t.where("n > 1").select("core")
    cores = scratch.put(twice(all_cores(rows).groupBy("core").agg(F.sum("n").alias("n"))), "cores")
    first, rest = refine(scratch, all_runs(rows), cores)
    parts = scratch.put(split_runs(rows, rest), "nodes")
    scratch.drop(cores, rest)
    cores = scratch.put(twice(parts.groupBy("core").agg(F.count("*").alias("n"))), "cores")
    second, rest = refine(scratch, parts.drop("bytes"), cores)
    least = rest.select("doc", "place")
    windows = scratch.put(all_windows(parts.join(least, ["doc", "place"]).select("doc", "place", "bytes")), "windows")
    scratch.drop(cores, rest, parts)
    earliest = scratch.put(windows.groupBy("id", "id2").agg(F.min(_struct("doc", "place")).alias("least"), F.count("*").alias("n")).where("n > 1").drop("n"), "earliest")
    third = scratch.put(windows.join(earliest, ["id", "id2"]).where(_struct("doc", "place") != F.col("least")).select("doc", "place"), "repeats")
    scratch.drop(windows, earliest)
    return [first, second, third]


def numbered(scratch: Scratch, documents: DataFrame) -> DataFrame:
    """doc (distinct, in the order of the ids), doc_id, text."""
    text = whole(F.col("text")).alias("text")
    n, ids = documents.agg(F.count("*"), F.countDistinct("doc_id")).first()
    if n == ids:
        return documents.select(F.col("doc_id").cast("long").alias("doc"), "doc_id", text)
    ordered = documents.select("doc_id", text).orderBy(F.col("doc_id").asc_nulls_last(), "text")
    return scratch.put(ordered.select(F.monotonically_increasing_id().alias("doc"), "doc_id", "text"), "numbered")


def with_spans(documents: DataFrame) -> DataFrame:
    """doc, doc_id, text and places (an array of runs, or null) of every document."""
    scratch = Scratch(documents.sparkSession)
    rows = numbered(scratch, documents)
    tables = repeated_runs(scratch, rows.select("doc", "text"))
    union = tables[0].unionByName(tables[1]).unionByName(tables[2])
    # Runs of one document that come one after another: their places are joined before they travel as lists.
    spans = union.groupBy("doc").agg(F.collect_list("place").alias("places"))
    return rows.join(spans, "doc", "left")


def removed(n: int, places: list[int] | None) -> list[tuple[int, int]]:
    """Maximal runs of removed bytes, from runs of windows."""
    if not places:
        return []
    p = np.sort(np.array(places, dtype=np.int64))
    start, end = p >> 8, (p >> 8) + (p & 255) + LENGTH - 1
    reach = np.maximum.accumulate(end)
    new = np.flatnonzero(np.concatenate(([True], start[1:] > reach[:-1])))
    return list(zip(start[new].tolist(), np.append(reach[new[1:] - 1], reach[-1]).tolist()))


def keep(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for s in spans for x in s), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))


def remove_repeats(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans (byte offsets, end exclusive) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, count, digest, where = [], [], [], [], []
            for text, places in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                raw = text.encode()
                spans = removed(len(raw), places)
                n.append(len(raw))
                gone.append(sum(b - a for a, b in spans))
                count.append(len(spans))
                digest.append(hashlib.sha256(keep(raw, spans)).hexdigest())
                where.append([{"start": a, "end": b} for a, b in spans])
            made = [pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(count, pa.int64()), pa.array(digest, pa.string()), pa.array(where, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    rows = with_spans(documents).select("doc_id", "text", "places")
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>")
