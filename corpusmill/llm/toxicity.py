"""Toxicity: cumulative-link ordinal regression over sparse word features.

Free style: an Arrow UDF hashes each text's words and sums weights; one narrow scan, no shuffle of texts. The
model is fitted on the driver on at most `sample` labelled rows (SAMPLE, chosen by the least hash of their ids,
which are broadcast; of their features, those that will be weighed reach the driver) and is an array of a fixed size.

Features are hashed words (lower-cased) and their beginnings of PREFIXES characters, so that inflected and
compound forms share what they begin with: 1 where a text has one; two that share a slot share a weight.
labels.toxic has two grades only, so ordered grades are made from it: 0 for rows that aren't toxic; toxic rows
have grade 1, 2 or 3 by how many marked features (those that stand clearly more often in toxic rows than
chance allows) they have for a hundred different words, cut at fixed densities. The model is
P(grade > k) = logistic(w.x - t_k) with one weight vector and rising thresholds t_0 < t_1 < t_2; expected severity
is the sum of these three probabilities. A text is toxic when P(grade > 0) reaches TOXIC.

Features are weighed only if they stand in several rows of the sample and their share of toxic rows differs by SURE
standard errors from the sample's, and weights are held down by an L2 term, so that one row's rare words
decide nothing. A long text's score is not diluted: one marked word counts alike in texts
of any length.

Cases: null and empty texts have no features and the base score. Labels that are null, not 0 or 1, or
without a document teach nothing; without two classes no text is toxic. Texts are read whole; repeated rows score
alike; extra columns are not passed on; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..session import Scratch

SAMPLE = 20_000
SLOTS = 1 << 18
GRADES = 4
PREFIXES = range(3, 9)
#: Marked features for a hundred different words from which a toxic row has grade 2 and 3.
DENSITIES = (4.0, 16.0)
#: Rows of the sample that must hold a feature, and standard errors it must be off by, before it is weighed.
LEAST_ROWS, SURE = 5, 4.0
TOXIC = 0.3

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def slot(feature: str) -> int:
    return xxhash.xxh64_intdigest(feature.encode("utf-8", "replace"), 7) % SLOTS


class Slots(dict):
    """Words to the slots of their features, each hashed once; emptied before it grows large. With weights, only
    slots that weigh something: for most words, none."""

    def __init__(self, weights: np.ndarray | None = None, most: int = 300_000):
        self.some = None if weights is None else set(np.flatnonzero(weights).tolist())
        self.most = most if weights is not None else most // 6

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > self.most:
            self.clear()
        made = (slot(word), *(slot(f"{word[:k]}*") for k in PREFIXES if k <= len(word)))
        value = self[word] = made if self.some is None else tuple(k for k in made if k in self.some)
        return value


def features(text: str | None, slots: Slots) -> tuple[np.ndarray, int]:
    """The slots of a text in rising order, and how many different words it has."""
    words = set(_WORD.findall((text or "").lower()))
    return np.array(sorted({k for w in words for k in slots[w]}), dtype=np.int64), len(words)


@dataclass(frozen=True)
class Ordinal:
    """One weight vector, and the thresholds between grades in rising order."""

    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, margins: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold."""
        return _logistic(margins[:, None] - self.thresholds[None, :])


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass(frozen=True)
class Sparse:
    """Rows of slots: row r has slots[start[r]:start[r + 1]]."""

    start: np.ndarray
    slots: np.ndarray

    @classmethod
    def of(cls, rows: list[np.ndarray]) -> Sparse:
        sizes = np.array([len(r) for r in rows], dtype=np.int64)
        return cls(np.concatenate(([0], sizes.cumsum())), np.concatenate(rows) if rows else np.zeros(0, np.int64))

    def times(self, w: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0.0], w[self.slots].cumsum()))
        return sums[self.start[1:]] - sums[self.start[:-1]]

    def back(self, v: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.slots, np.repeat(v, np.diff(self.start)), size)


def surplus(x: Sparse, toxic: np.ndarray) -> np.ndarray:
    """By slot: standard errors by which its toxic rows exceed the sample's share; 0 where too few rows have it."""
    rows, base = x.back(np.ones(len(toxic)), SLOTS), toxic.mean()
    error = np.sqrt(np.maximum(rows * base * (1 - base), 1e-9))
    return np.where(rows >= LEAST_ROWS, (x.back(toxic, SLOTS) - rows * base) / error, 0)


def grades(x: Sparse, words: np.ndarray, toxic: np.ndarray, densities: tuple[float, float] = DENSITIES) -> np.ndarray:
    """0 for rows that aren't toxic; 1 to 3 for toxic rows by the density of marked features."""
    marked = (surplus(x, toxic) >= SURE).astype(float)
    share = 100 * x.times(marked) / np.maximum(words, 1)
    return np.where(toxic > 0, 1 + np.searchsorted(np.array(densities), share, side="right"), 0)


def fit(x: Sparse, y: np.ndarray, steps: int = 800, rate: float = 0.05, ridge: float = 2e-5) -> Ordinal:
    """Adam on the mean cumulative-link likelihood; thresholds are a first one plus positive gaps."""
    n = len(y)
    if not (0 < (y > 0).sum() < n):
        return Ordinal(np.zeros(SLOTS), np.array([20.0, 21.0, 22.0]))
    known = np.abs(surplus(x, (y > 0).astype(float))) >= SURE
    # Slots that are not weighed leave; the others are numbered anew.
    number = np.cumsum(known) - 1
    keep = known[x.slots]
    sizes = np.add.reduceat(np.append(keep, False).astype(int), x.start[:-1]) * (np.diff(x.start) > 0)
    small = Sparse(np.concatenate(([0], sizes.cumsum())), number[x.slots[keep]])
    size = int(known.sum())
    share = np.clip([(y > k).mean() for k in range(GRADES - 1)], 1e-3, 1 - 1e-3)
    first = np.log((1 - share) / share)
    theta = np.concatenate((np.zeros(size), [first[0]], np.log(np.maximum(np.diff(first), 0.1))))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    rows = np.arange(n)
    for step in range(1, steps + 1):
        w, gaps = theta[:size], np.exp(theta[size + 1 :])
        t = theta[size] + np.concatenate(([0.0], gaps.cumsum()))
        s = _logistic(small.times(w)[:, None] - t[None, :])
        # P(grade = k) = s[k - 1] - s[k], with 1 before the first and 0 after the last.
        edge = np.concatenate((np.ones((n, 1)), s, np.zeros((n, 1))), axis=1)
        slope = edge * (1 - edge)
        p = np.maximum(edge[rows, y] - edge[rows, y + 1], 1e-9)
        up, down = slope[rows, y] / p, slope[rows, y + 1] / p
        push = np.zeros((n, GRADES + 1))
        push[rows, y] -= up
        push[rows, y + 1] += down
        by_t = push.sum(axis=0)[1:GRADES] / n
        grad = np.concatenate((small.back(down - up, size) / n + ridge * w, [-by_t.sum()], -by_t[::-1].cumsum()[::-1][1:] * gaps))
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    weights = np.zeros(SLOTS)
    weights[known] = theta[:size]
    return Ordinal(weights, theta[size] + np.concatenate(([0.0], np.exp(theta[size + 1 :]).cumsum())))


def training_rows(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[Sparse, np.ndarray, np.ndarray]:
    """The sample's weighed features, numbers of different words, and toxic.

    Features are counted beside the rows; only those that will be weighed (SLOTS at most) reach the driver."""
    marked = labels.where("doc_id is not null and toxic in (0, 1)").select("doc_id", F.col("toxic").alias("y"))
    marked = marked.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample)
    texts = documents.select("doc_id", "text").join(F.broadcast(marked), "doc_id").select("doc_id", "y", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = Slots()
        for batch in batches:
            found = [features(t, slots) for t in batch.column(2).to_pylist()]
            raw = [f[0].astype("<i4").tobytes() for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.int64()), pa.array(raw, pa.binary()), pa.array([f[1] for f in found], pa.int64())], names=["doc_id", "y", "slots", "words"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, hits = np.zeros(SLOTS, np.int64), np.zeros(SLOTS, np.int64)
        for batch in batches:
            for y, raw in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                at = np.frombuffer(raw, "<i4")
                rows[at] += 1
                hits[at] += y
        held = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(rows[held]), pa.array(hits[held])], names=["slot", "n", "hits"])

    scratch = Scratch(documents.sparkSession)
    rows = scratch.put(texts.mapInArrow(run, "doc_id long, y long, slots binary, words long"), "features")
    n, toxic = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    base = toxic / max(1, n)
    counted = rows.mapInArrow(count, "slot long, n long, hits long").groupBy("slot").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
    off = F.abs(F.col("hits") - F.col("n") * base) / F.sqrt(F.greatest(F.col("n") * (base * (1 - base)), F.lit(1e-9)))
    weighed = np.array(sorted(r["slot"] for r in counted.where((F.col("n") >= LEAST_ROWS) & (off >= SURE)).select("slot").collect()), dtype=np.int64)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = np.zeros(SLOTS, bool)
        some[weighed] = True
        for batch in batches:
            each = (np.frombuffer(raw, "<i4") for raw in batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([x[some[x]].tobytes() for x in each], pa.binary()), batch.column(3)], names=batch.schema.names)

    got = rows.mapInArrow(keep, rows.schema).collect()
    scratch.drop(rows)
    got.sort(key=lambda r: (r["doc_id"], r["y"], bytes(r["slots"])))
    x = Sparse.of([np.frombuffer(r["slots"], "<i4").astype(np.int64) for r in got])
    return x, np.array([r["words"] for r in got], dtype=float), np.array([r["y"] for r in got], dtype=float)


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Ordinal:
    x, words, toxic = training_rows(documents, labels, sample)
    if not len(toxic):
        return fit(x, np.zeros(0, int))
    return fit(x, grades(x, words, toxic))


def judge(documents: DataFrame, model: Ordinal, toxic: float = TOXIC) -> DataFrame:
    """doc_id, p_toxic = P(grade > 0), severity (expected grade, 0 to 3), grade (the likeliest) and toxic of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = Slots(model.weights)
        for batch in batches:
            margins = np.array([model.weights[features(t, slots)[0]].sum() for t in batch.column(1).to_pylist()], dtype=float)
            s = model.above(margins)
            each = -np.diff(np.concatenate((np.ones((len(s), 1)), s, np.zeros((len(s), 1))), axis=1), axis=1)
            columns = [pa.array(s[:, 0]), pa.array(s.sum(axis=1)), pa.array(each.argmax(axis=1).astype(np.int32)), pa.array((s[:, 0] >= toxic).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "p_toxic", "severity", "grade", "toxic"])

    rows = documents.select("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {rows.dtypes[0][1]}, p_toxic double, severity double, grade int, toxic int")
