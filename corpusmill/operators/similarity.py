"""Exact vector search and similarity joins, block by block as matrix products inside Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from ..session import Scratch

#: Queries of one block, vectors of one block of a self-join, and index rows that a block of queries meets at once.
QUERY_BLOCK, JOIN_BLOCK, INDEX_BLOCK = 4096, 4096, 16384
#: Rows of one side that are multiplied at once.
SLICE = 512
#: Scores of a search that a worker holds at once; they are also rounded and sorted, at 8 bytes each time.
SCORES = 1 << 20


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of an array<float> column as doubles of length 1; null vectors and zero vectors become zero."""
    sizes = pc.unique(pc.list_value_length(column)) if len(column) and not column.null_count else ()
    if len(sizes) == 1 and sizes[0].as_py():
        out = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    else:
        rows = [np.asarray(v, dtype=np.float64) if v is not None else np.zeros(0) for v in column.to_pylist()]
        out = np.zeros((len(rows), max((len(r) for r in rows), default=0)))
        for k, r in enumerate(rows):
            out[k, : len(r)] = r
    length = np.sqrt((out**2).sum(axis=1, keepdims=True))
    return np.divide(out, length, out=np.zeros_like(out), where=length > 0)


def _best(ids: np.ndarray, rows: np.ndarray, keys: np.ndarray, others: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """The k best of others for each of rows; of equals, the smaller keys."""
    order = np.argsort(keys, kind="stable")
    keys, others = keys[order], others[order]
    step = max(1, min(SLICE, SCORES // max(1, len(others))))
    for at in range(0, len(rows), step):
        score = rows[at : at + step] @ others.T
        rank = np.round(score, 9)
        best = np.argsort(np.negative(rank, out=rank), axis=1, kind="stable")[:, :k]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[at : at + step], best.shape[1])), pa.array(keys[best].ravel()), pa.array(np.take_along_axis(score, best, axis=1).ravel())], names=["query_id", "doc_id", "similarity_score"])


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], pa.Table]]:
    """One table for each (left, right) of batches that are sorted by these: a task holds one unit at a time."""
    held, at = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        left, right = batch.column("left").to_numpy(), batch.column("right").to_numpy()
        edges = [0, *(np.flatnonzero((left[1:] != left[:-1]) | (right[1:] != right[:-1])) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            one = (int(left[a]), int(right[a]))
            if held and one != at:
                yield at, pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            at = one
    if held:
        yield at, pa.Table.from_batches(held)


def _by_unit(rows: DataFrame) -> DataFrame:
    return rows.repartition("left", "right").sortWithinPartitions("left", "right")


def _blocks(rows: DataFrame, key: str, vector: str, parts: int) -> DataFrame:
    """id, v and the number of the block that a row is in."""
    return rows.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), F.pmod(F.xxhash64(key), F.lit(parts)).cast("int").alias("own"))


def top_k(queries: DataFrame, index: DataFrame, k: int = 15, query_key: str = "vec_id", key: str = "vec_id", vector: str = "embedding", block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, doc_id, similarity_score (cosine) and rank of the k nearest rows of index for each query.

    Up to `block` queries go to the executors, which read the index where it lies. More queries meet the index in pairs
    of blocks: nothing passes through the driver, and a task holds one pair. Each batch or pair keeps its own k best,
    and a window ranks these. Ties go to the smaller key. Rows with a null vector are no neighbours and, as queries,
    have none; without queries or index rows, there is no result."""
    queries, index = queries.where(F.col(vector).isNotNull()), index.where(F.col(vector).isNotNull())
    ddl, n = "query_id long, doc_id long, similarity_score double", queries.count()
    if n <= block:
        got = queries.select(F.col(query_key).cast("long"), vector).toArrow()
        shared = index.sparkSession.sparkContext.broadcast((got.column(0).to_numpy(), matrix(got.column(1).combine_chunks() if got.num_rows else pa.array([], pa.list_(pa.float32())))))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, rows = shared.value
            for batch in batches:
                if batch.num_rows and len(ids):
                    yield from _best(ids, rows, batch.column(0).to_numpy(), matrix(batch.column(1)), k)

        out = index.select(F.col(key).cast("long"), vector).mapInArrow(scan, ddl)
    else:
        here, there = -(-n // block), max(1, -(-index.count() // max(INDEX_BLOCK, block)))
        every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
        asked = _blocks(queries, query_key, vector, here).select("id", "v", F.lit(True).alias("asks"), F.col("own").alias("left"), every(there).alias("right"))
        held = _blocks(index, key, vector, there).select("id", "v", F.lit(False).alias("asks"), every(here).alias("left"), F.col("own").alias("right"))

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, t in _units(batches):
                ids, rows = t["id"].to_numpy(), matrix(t["v"].combine_chunks())
                asks = t["asks"].to_numpy()
                if asks.any() and not asks.all():
                    yield from _best(ids[asks], rows[asks], ids[~asks], rows[~asks], k)

        out = _by_unit(asked.unionByName(held)).mapInArrow(meet, ddl)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("similarity_score", 9).desc(), "doc_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k)


def _block_pairs(vectors: DataFrame, key: str, vector: str, block: int) -> DataFrame:
    """Each row once for every pair of blocks that its own block is in."""
    parts = max(1, -(-vectors.count() // block))
    rows = _blocks(vectors, key, vector, parts).withColumn("with", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return _by_unit(rows.select("id", "v", F.col("own").alias("part"), F.least("own", "with").alias("left"), F.greatest("own", "with").alias("right")))


def _near(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, cosine), i < j, of the pairs over the threshold in a task's pairs of blocks."""
    for (left, right), t in _units(batches):
        ids, part, rows = t["id"].to_numpy(), t["part"].to_numpy(), matrix(t["v"].combine_chunks())
        a, b = np.flatnonzero(part == left), np.flatnonzero(part == right)
        for at in range(0, len(a), SLICE):
            score = rows[a[at : at + SLICE]] @ rows[b].T
            i, j = np.nonzero(score > threshold)
            x, y, s = ids[a[at + i]], ids[b[j]], score[i, j]
            keep = x < y if left == right else x != y
            yield np.minimum(x, y)[keep], np.maximum(x, y)[keep], s[keep]


def links(vectors: DataFrame, threshold: float, key: str = "vec_id", vector: str = "embedding", block: int = JOIN_BLOCK) -> DataFrame:
    """i, j (i < j) and cosine of all pairs over the threshold (strictly)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, j, s in _near(batches, threshold):
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(s)], names=["i", "j", "cosine"])

    return _block_pairs(vectors, key, vector, block).mapInArrow(run, "i long, j long, cosine double")


def link_counts(vectors: DataFrame, threshold: float, key: str = "vec_id", vector: str = "embedding", block: int = JOIN_BLOCK) -> DataFrame:
    """key and n_links of every row: how many others are over the threshold. Pairs are counted where they are found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, j, _ in _near(batches, threshold):
            ids, n = np.unique(np.concatenate((i, j)), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n)], names=[key, "n"])

    counted = _block_pairs(vectors, key, vector, block).mapInArrow(run, f"{key} long, n long").groupBy(key).agg(F.sum("n").alias("n"))
    return vectors.select(F.col(key).cast("long").alias(key)).join(counted, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n_links"))


def leaders(vectors: DataFrame, threshold: float, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key and leader of every row: the greedy pass in key order, in which a row joins the first earlier leader over the
    threshold, else leads. That is the lexicographically first maximal independent set (Blelloch, Fineman and Shun, 2012):
    in rounds, a row with no undecided earlier neighbour and no leader among its earlier neighbours leads, and rows with
    a leader before them follow."""
    scratch = Scratch(vectors.sparkSession)
    edges = scratch.put(links(vectors, threshold, key, vector), "edges")
    open_rows = scratch.put(edges.select(F.col("i").alias("id")).unionByName(edges.select(F.col("j").alias("id"))).distinct(), "open")
    lead = None
    while open_rows.limit(1).count():
        live = edges.join(open_rows.withColumnRenamed("id", "i"), "i", "left_semi").join(open_rows.withColumnRenamed("id", "j"), "j", "left_semi")
        blocked = live.select(F.col("j").alias("id")).distinct()
        new = scratch.put(open_rows.join(blocked, "id", "left_anti"), "new")
        lead = new if lead is None else lead.unionByName(new)
        hit = edges.join(new.withColumnRenamed("id", "i"), "i", "left_semi").select(F.col("j").alias("id")).distinct()
        open_rows = scratch.put(open_rows.join(new, "id", "left_anti").join(hit, "id", "left_anti"), "open")
    ids = vectors.select(F.col(key).cast("long").alias(key))
    if lead is None:
        return ids.withColumn("leader", F.col(key))
    lead = scratch.put(lead, "leaders")
    first = edges.join(lead.withColumnRenamed("id", "i"), "i", "left_semi").join(lead.withColumnRenamed("id", "j"), "j", "left_anti").groupBy(F.col("j").alias(key)).agg(F.min("i").alias("l"))
    return ids.join(first, key, "left").select(key, F.coalesce("l", key).alias("leader"))
