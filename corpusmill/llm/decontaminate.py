"""Benchmark decontamination: latent semantic retrieval, then longest common subsequence and answer checks.

Free style (Arrow batches). The steps, for a block of at most ITEMS benchmark items (more items: more blocks):

1. Terms are the words of the items and their answers, so their number is bounded by the block. One pass over the texts
   writes, for each, the term of every word (or none); everything after it reads these numbers, no text again.
2. Counts of the terms over all texts give idf, by passages of `PASSAGE` words; terms that stand in more than a hundredth of
   the passages get no weight.
3. Randomised SVD, distributed: with A the TF-IDF rows (length 1) of all corpus passages and, weighing as much in
   sum, of the items, tasks add up A'A M for a thin random M, and the driver takes the leading axes of A'A from that product
   (randomised Nystroem). Tasks' sums meet block by block of terms in two salted steps, so no task takes in all of them.
4. Every half-passage of every text is projected, two neighbours make a window, and a window's cosine to every item passage
   is taken. Those from `COSINE` on are candidates.
5. Items that the latent space can't hold, being short or having a passage most of whose words have no weight (a leak in a
   large group of copies makes its own words common), have an exact way: a window is a candidate if it holds as many of
   the item's words, and of its answer words, as the checks below ask for at least. That loses none.
6. A candidate's surroundings are checked against the item's words: the longest common subsequence as a share
   of the item, over windows a little longer than the item, and which of the item's answer words (a column
   `answer` if the benchmark has one, else its rarest words) stand there. Near-verbatim text is a leak by the
   subsequence alone; a paraphrase needs the answer words too.

Texts are never shuffled and no passage is left out. Only sums of bounded size reach the driver. Long texts are searched in
overlapping pieces, so memory doesn't follow the longest.

Cases: null and empty texts have no passage and no leak; null or wordless items are never found; items with equal text are
found together; ids of either table have any type, may repeat and be null; repeated rows give equal results each. Extra
columns are kept by clean() and dropped by leaks(). An empty table, or an empty benchmark, gives no leaks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import Scratch
from .common import whole

PASSAGE = 64
RANK, EXTRA = 192, 32
COSINE = 0.4
VERBATIM, PARAPHRASE, ANSWER = 0.75, 0.45, 0.6
ANSWER_WORDS = 5
#: Terms in more than this share of the passages (and in more than FEW passages) get no weight.
COMMON, FEW = 0.01, 20
#: Items with a passage of which less than this share of the words has weight, or with fewer than SHORT words, have an exact way.
WEIGHED, SHORT = 0.5, 16
#: Items of one block; they and their terms are sent to the executors.
ITEMS = 2_000
#: Term weights that are multiplied at once.
CHUNK = 40_000
#: Half-passages of one piece of a text, and of all pieces that are searched at once.
PIECE = 4_096
#: Texts of an Arrow batch that are worked on at once.
TEXTS = 512
#: Different leaking texts whose hashes are broadcast; beyond, a shuffle join.
BROADCAST_TEXTS = 500_000
_SALTS, _SLICE = 8, 512

#: ASCII letters and digits and everything beyond ASCII make words.
_BREAKS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
#: Stands between texts that are split together; no word holds it.
_END = b"\0"

Item = tuple[object, list[bytes], list[bytes]]


def words(text: str | None) -> list[bytes]:
    return _spaced(text).split()


def _spaced(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "replace").translate(_BREAKS)


@dataclass
class Model:
    """What the search needs: terms, items (id, words, answer's words), weights, latent axes, and the items' projections."""

    terms: dict[bytes, int]
    items: list[Item]
    weights: np.ndarray | None = None
    axes: np.ndarray | None = None
    queries: np.ndarray | None = None
    owners: list[int] = field(default_factory=list)
    exact: list[int] = field(default_factory=list)


def term_arrays(texts: list[str | None], terms: dict[bytes, int]) -> list[np.ndarray]:
    """For each text, the term of every word, or -1."""
    if not texts:
        return []
    found = b" \0 ".join(map(_spaced, texts)).split()
    get = {**terms, _END: -2}.get
    ids = np.fromiter(map(get, found, repeat(-1)), np.int32, len(found))
    ends = np.flatnonzero(ids == -2)
    return [ids[a:b] for a, b in zip([0, *(ends + 1)], [*ends, len(ids)])]


def number(rows: DataFrame, terms: dict[bytes, int]) -> DataFrame:
    """The columns of rows but the last, a text, and `words`: the term of each of its words, as bytes."""
    spark, names = rows.sparkSession, rows.columns[:-1]
    shared = spark.sparkContext.broadcast(terms)
    kind = _kind(len(terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                made = [x.astype(kind).tobytes() for x in term_arrays(part.column(part.num_columns - 1).to_pylist(), shared.value)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(made, pa.binary())], names=[*names, "words"])

    kept = rows.select(*names)
    return rows.mapInArrow(run, ", ".join([*(f"`{c}` {k}" for c, k in kept.dtypes), "words binary"]))


def _kind(terms: int) -> str:
    return "<i2" if terms < 1 << 15 else "<i4"


def _arrays(column: pa.Array, kind: str) -> list[np.ndarray]:
    _, ends, data = column.buffers()
    at = np.frombuffer(ends, np.int32)[column.offset : column.offset + len(column) + 1] // np.dtype(kind).itemsize if len(column) else []
    held = np.frombuffer(data, kind, count=int(at[-1])) if len(at) and at[-1] else np.zeros(0, kind)
    return [held[a:b] for a, b in zip(at[:-1], at[1:])]


def term_counts(numbers: DataFrame, many: int, size: int = PASSAGE) -> tuple[np.ndarray, int]:
    """How often each term stands in the texts, and the number of passages; one sum a task and term is shuffled."""
    kind = _kind(many)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, total = np.zeros(many + 1, np.int64), 0
        for batch in batches:
            for x in _arrays(batch.column(0), kind):
                counts += np.bincount(x + 1, minlength=many + 1)
                total += -(-len(x) // size)
        held = np.flatnonzero(counts[1:])
        yield pa.RecordBatch.from_arrays([pa.array(np.append(held, -1)), pa.array(np.append(counts[1:][held], total))], names=["term", "n"])

    got = numbers.select("words").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    counts, total = np.zeros(many, np.int64), 0
    for r in got:
        if r["term"] >= 0:
            counts[r["term"]] = r["n"]
        else:
            total = r["n"]
    return counts, total


def project(start: np.ndarray, term: np.ndarray, value: np.ndarray | None, matrix: np.ndarray) -> np.ndarray:
    """Sparse rows (first entry of each, terms, values) times matrix, some rows at a time; without values, all are 1."""
    out = np.empty((len(start), matrix.shape[1]), matrix.dtype)
    ends = np.append(start[1:], len(term))
    at = 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(ends, start[at] + CHUNK, "right")))
        part = slice(start[at], ends[to - 1])
        rows = matrix[term[part]]
        if value is not None:
            rows *= value[part, None]
        np.add.reduceat(rows, start[at:to] - start[at], axis=0, dtype=matrix.dtype, out=out[at:to])
        at = to
    return out


def gram_times(start: np.ndarray, term: np.ndarray, value: np.ndarray, matrix: np.ndarray, out: np.ndarray) -> None:
    """Adds A'A matrix to out, for the sparse rows A."""
    if not len(start):
        return
    thin = project(start, term, value, matrix)
    row = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(term))))
    for at in range(0, len(term), CHUNK):
        part = slice(at, at + CHUNK)
        order = np.argsort(term[part], kind="stable")
        t, first = np.unique(term[part][order], return_index=True)
        rows = thin[row[part][order]]
        rows *= value[part][order][:, None]
        out[t] += np.add.reduceat(rows, first, axis=0)


def unit_rows(row: np.ndarray, term: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows of length 1 from entries in the order of their rows: (names of rows, first entry of each, terms, values). Each
    place of a term is an entry of its own; terms without weight, and -1, have none."""
    some = np.append(weights > 0, False)[term]
    r, t = row[some], term[some]
    value = weights[t]
    first = np.flatnonzero(np.diff(r, prepend=-1))
    if len(first):
        length = np.sqrt(np.add.reduceat(value**2, first))
        value = value / np.repeat(length, np.diff(np.append(first, len(r))))
    return r[first], first, t, value.astype(np.float32)


def corpus_gram(numbers: DataFrame, weights: np.ndarray, matrix: np.ndarray, size: int = PASSAGE) -> tuple[np.ndarray, int]:
    """A'A matrix and the number of rows of A, over all passages."""
    width, kind = matrix.shape[1], _kind(len(weights))
    shared = numbers.sparkSession.sparkContext.broadcast((weights, matrix.astype(np.float32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        weights, matrix = shared.value
        out, n = np.zeros((len(weights), width)), 0
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                held = _arrays(batch.column(0).slice(at, TEXTS), kind)
                base = np.cumsum([0, *(-(-len(x) // size) for x in held)])
                row = np.concatenate([b + np.arange(len(x)) // size for b, x in zip(base, held)])
                names, start, term, value = unit_rows(row, np.concatenate(held), weights)
                gram_times(start, term, value, matrix, out)
                n += len(names)
        if n:
            slices = range(0, len(weights), _SLICE)
            salt = TaskContext.get().partitionId() % _SALTS
            yield _sums([*slices], salt, [n if s == 0 else 0 for s in slices], [out[s : s + _SLICE].astype(np.float32) for s in slices])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        count: dict[int, int] = {}
        for batch in batches:
            for s, n, raw in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                sums[s] = sums.get(s, 0.0) + np.frombuffer(raw, np.float32).astype(float)
                count[s] = count.get(s, 0) + n
        if sums:
            yield _sums([*sums], 0, [count[s] for s in sums], [x.astype(np.float32) for x in sums.values()])

    schema = "slice long, salt long, n long, sums binary"
    sums = numbers.select("words").mapInArrow(run, schema).repartition("slice", "salt").mapInArrow(add, schema).repartition("slice").mapInArrow(add, schema)
    out, n = np.zeros((len(weights), width)), 0
    for r in sums.collect():
        part = np.frombuffer(r["sums"], np.float32).reshape(-1, width)
        out[r["slice"] : r["slice"] + len(part)] += part
        n += r["n"]
    shared.unpersist()
    return out, n


def _sums(slices: list[int], salt: int, n: list[int], sums: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(slices, pa.int64()), pa.array([salt] * len(slices), pa.int64()), pa.array(n, pa.int64()), pa.array([x.tobytes() for x in sums], pa.binary())], names=["slice", "salt", "n", "sums"])


def leading_axes(product: np.ndarray, test: np.ndarray, rank: int) -> np.ndarray:
    """The leading eigenvectors of a positive matrix G from product = G test, test having orthonormal columns: randomised
    Nystroem (Tropp, Yurtsever, Udell and Cevher, 2017), which reads the rows behind G once."""
    shift = 1e-7 * max(np.linalg.norm(product), 1e-30)
    shifted = product + shift * test
    core = test.T @ shifted
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    root = vectors / np.sqrt(np.maximum(values, shift))
    left, _, _ = np.linalg.svd(shifted @ root, full_matrices=False)
    return left[:, :rank].astype(np.float32)


def item_passages(items: list[Item], terms: dict[bytes, int], size: int) -> tuple[list[int], np.ndarray, np.ndarray]:
    """(owner of each passage, rows, terms) of the items' half-overlapping passages."""
    owners, row, term = [], [], []
    for k, (_, found, _) in enumerate(items):
        for start in range(0, max(1, len(found) - size // 2), size // 2):
            term += [terms[w] for w in found[start : start + size]]
            row += [len(owners)] * (len(term) - len(row))
            owners.append(k)
    return owners, np.array(row, np.int64), np.array(term, np.int64)


def unlike(items: list[Item], owners: list[int], row: np.ndarray, term: np.ndarray, weights: np.ndarray) -> list[int]:
    """Items that the latent space doesn't hold: short ones, and those with a passage of whose different words too few have weight."""
    r, t = np.divmod(np.unique(row * len(weights) + term), len(weights))
    share = np.bincount(r, weights[t] > 0) / np.maximum(np.bincount(r), 1)
    return sorted({owners[p] for p in np.flatnonzero(share < WEIGHED)} | {k for k, x in enumerate(items) if len(x[1]) < SHORT})


def fit(numbers: DataFrame, terms: dict[bytes, int], items: list[Item], size: int = PASSAGE, rank: int = RANK, extra: int = EXTRA, seed: int = 7) -> Model:
    """Weights, latent axes and the items' projections; numbers is the written result of number()."""
    model = Model(terms, items)
    counts, total = term_counts(numbers, len(terms), size)
    idf = np.log((1 + total) / (1 + np.minimum(counts, total)))
    model.weights = np.where(counts > max(FEW, COMMON * total), 0.0, idf) if total else np.ones(len(terms))
    owners, row, term = item_passages(items, terms, size)
    model.exact = unlike(items, owners, row, term, model.weights)
    if not model.weights.any():
        model.weights = np.maximum(idf, 1e-3)
    names, start, t, value = unit_rows(row, term, model.weights)
    model.owners = [owners[k] for k in names]
    test, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(terms), min(rank + extra, len(terms)))))
    product, n = corpus_gram(numbers, model.weights, test, size)
    own = np.zeros_like(product)
    gram_times(start, t, value, test.astype(np.float32), own)
    model.axes = leading_axes(product + own * (n / max(1, len(names)) if n else 1.0), test, rank)
    queries = project(start, t, model.weights[t].astype(np.float32), model.axes)
    model.queries = queries / np.maximum(np.sqrt((queries**2).sum(axis=1, keepdims=True)), 1e-9)
    return model


def places_of(a: list) -> dict:
    """For each word, its places in a as bits of a number."""
    places: dict = {}
    for k, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << k
    return places


def subsequence(places: dict, length: int, b: list) -> int:
    """Words of the longest common subsequence of a sequence, given by places_of() and its length, and b, whose words all stand in
    it; the rows of the table are bits of one number."""
    full = (1 << length) - 1
    v = full
    for w in b:
        u = v & places[w]
        v = ((v + u) | (v - u)) & full
    return length - v.bit_count()


def reach(length: int) -> int:
    """Words of a window that an item is matched with."""
    return length + length // 4 + 2


def best_match(item: list, around: list) -> tuple[float, int, int]:
    """The largest share of item that is a subsequence of a window of around, and that window."""
    places = places_of(item)
    own = [k for k, w in enumerate(around) if w in places]
    width, step = reach(len(item)), max(1, len(item) // 4)
    best, first, last = (0.0, 0, 0), 0, 0
    for at in range(0, max(1, len(around) - width + step), step):
        while first < len(own) and own[first] < at:
            first += 1
        while last < len(own) and own[last] < at + width:
            last += 1
        # No subsequence is longer than the item's words that stand in the window.
        if last - first > best[0] * len(item):
            share = subsequence(places, len(item), [around[k] for k in own[first:last]]) / len(item)
            best = max(best, (share, at, at + width), key=lambda x: x[0])
    return best


class Searcher:
    """A model on a worker."""

    def __init__(self, model: Model, size: int = PASSAGE, cosine: float = COSINE):
        self.model, self.half, self.size, self.cosine = model, size // 2, size, cosine
        ids = lambda found: [model.terms[w] for w in found]
        self.items = [ids(found) for _, found, _ in model.items]
        self.answers = []
        for own, (_, _, answer) in zip(self.items, model.items):
            rare = sorted(set(own), key=lambda t: (-model.weights[t], t))[:ANSWER_WORDS]
            self.answers.append(set(ids(answer)) if answer else set(rare))
        self.latent = (model.weights[:, None] * model.axes).astype(np.float32)
        self.weighed = np.append(model.weights > 0, False)
        # What a window has to hold for the checks: words of the item, and of the answer.
        e = len(model.exact)
        self.marks = np.zeros((len(model.terms), 2 * e), np.uint8)
        for h, i in enumerate(model.exact):
            self.marks[self.items[i], h] = 1
            self.marks[list(self.answers[i]), e + h] = 1
        length = np.array([len(self.items[i]) for i in model.exact])
        self.some, self.most = PARAPHRASE * length, VERBATIM * length
        self.asked = np.array([ANSWER * len(self.answers[i]) for i in model.exact])
        self.span = np.array([-(-reach(n) // self.half) + 1 for n in length.tolist()], np.int64)
        self.marked = np.append(self.marks.any(axis=1), False)
        self.overlap = max([2, *self.span.tolist()])

    def pieces(self, texts: list[np.ndarray]) -> Iterator[list[tuple[int, int, np.ndarray]]]:
        """Groups of (text, first half-passage, words); pieces of one text overlap by the longest window."""
        group, held, most = [], 0, max(PIECE, 4 * self.overlap)
        for k, x in enumerate(texts):
            many = -(-len(x) // self.half)
            for at in range(0, max(0, many - self.overlap) + 1 if many else 0, most - self.overlap):
                piece = x[at * self.half : (at + most) * self.half]
                group.append((k, at, piece))
                held += -(-len(piece) // self.half)
                if held >= PIECE:
                    yield group
                    group, held = [], 0
        if group:
            yield group

    def candidates(self, group: list[tuple[int, int, np.ndarray]]) -> Iterator[tuple[int, int, float, int]]:
        """(text, item, cosine or 0, place) of the windows that have to be checked."""
        many = [-(-len(x) // self.half) for _, _, x in group]
        base = np.cumsum([0, *many])
        n = int(base[-1])
        half = np.concatenate([b + np.arange(len(x)) // self.half for b, (_, _, x) in zip(base, group)])
        term = np.concatenate([x for _, _, x in group]).astype(np.int64)
        end = np.repeat(base[1:], many)
        text = np.repeat([k for k, _, _ in group], many)
        place = (np.arange(n) - np.repeat(base[:-1], many) + np.repeat([at for _, at, _ in group], many)) * self.half
        rows = self._sum(half, term, self.weighed, self.latent, n)
        alone = np.flatnonzero(np.arange(n) + 1 >= end)
        follow = np.append(rows[1:], rows[:1], axis=0)
        follow[alone] = 0
        rows += follow
        length = np.sqrt(np.einsum("ij,ij->i", rows, rows))
        near = rows @ self.model.queries.T
        for r, q in zip(*np.nonzero((near >= self.cosine * length[:, None]) & (length[:, None] > 0))):
            yield int(text[r]), self.model.owners[q], float(near[r, q] / length[r]), int(place[r])
        if self.model.exact:
            e = len(self.model.exact)
            sums = np.zeros((n + 1, 2 * e), np.int32)
            np.cumsum(self._sum(half, term, self.marked, self.marks, n), axis=0, dtype=np.int32, out=sums[1:])
            for span in np.unique(self.span):
                h = np.flatnonzero(self.span == span)
                to = np.minimum(np.arange(n) + span, end)
                held, answers = (sums[to][:, c] - sums[:-1][:, c] for c in (h, e + h))
                for r, c in zip(*np.nonzero((held >= self.some[h]) & ((held >= self.most[h]) | (answers >= self.asked[h])))):
                    yield int(text[r]), self.model.exact[h[c]], 0.0, int(place[r])

    @staticmethod
    def _sum(half: np.ndarray, term: np.ndarray, wanted: np.ndarray, matrix: np.ndarray, n: int) -> np.ndarray:
        """For each of n half-passages, the sum of its wanted terms' rows of matrix."""
        some = wanted[term]
        own = half[some]
        first = np.flatnonzero(np.diff(own, prepend=-1))
        out = np.zeros((n, matrix.shape[1]), matrix.dtype)
        out[own[first]] = project(first, term[some], None, matrix)
        return out

    def leaks(self, texts: list[np.ndarray]) -> list[list[tuple[object, float, float, float]]]:
        """For each text, (item id, cosine, subsequence share, answer share) of the items that it leaks."""
        places: dict[tuple[int, int], list[tuple[float, int]]] = {}
        for group in self.pieces(texts):
            for k, i, cosine, place in self.candidates(group):
                places.setdefault((k, i), []).append((cosine, place))
        out: list[list[tuple[object, float, float, float]]] = [[] for _ in texts]
        for (k, i), found in sorted(places.items()):
            if checked := self.check(texts[k], i, found):
                out[k].append(checked)
        return out

    def check(self, text: np.ndarray, i: int, places: list[tuple[float, int]]) -> tuple[object, float, float, float] | None:
        item, top, seen = self.items[i], (0.0, 0.0), -1
        leaky = lambda x: x[0] >= VERBATIM or (x[0] >= PARAPHRASE and x[1] >= ANSWER)
        for _, place in sorted(places, key=lambda p: p[1]):
            a, b = max(0, place - len(item), seen - len(item)), place + self.size + reach(len(item))
            seen = b
            around = text[a:b].tolist()
            near = set(around)
            # No subsequence is longer than the item's words that stand here at all.
            if sum(w in near for w in item) < PARAPHRASE * len(item):
                continue
            share, s, e = best_match(item, around)
            answer = len(self.answers[i].intersection(around[s:e])) / max(1, len(self.answers[i]))
            top = max(top, (share, answer), key=lambda x: (leaky(x), x))
        if not leaky(top):
            return None
        # Without a cosine of the latent space, that of the counts of words.
        cosine = max(c for c, _ in places) or max(self.likeness(item, text[p : p + self.size]) for _, p in places)
        return self.model.items[i][0], cosine, *top

    def likeness(self, item: list[int], window: np.ndarray) -> float:
        """Cosine of the counts of words; words of no item count as different ones."""
        x, y = (np.bincount(v, minlength=len(self.model.terms)) for v in (item, window[window >= 0]))
        return float(x @ y / math.sqrt((x @ x) * (y @ y + (window < 0).sum()))) if (x @ y) else 0.0


def _blocks(benchmark: DataFrame, block: int = ITEMS) -> Iterator[list[Item]]:
    """The items that have words, at most about `block` at a time."""
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    rows = benchmark.select("item_id", "text", answer.alias("answer")).where("text is not null")
    many = -(-rows.count() // block)
    for k in range(many):
        part = rows if many == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(many)) == k)
        got = sorted(part.collect(), key=lambda r: (r["item_id"] is None, r["item_id"], r["text"]))
        items = [(r["item_id"], words(r["text"]), words(r["answer"])) for r in got]
        if items := [x for x in items if x[1]]:
            yield items


def search(rows: DataFrame, benchmark: DataFrame) -> DataFrame | None:
    """rows (any columns, then a text) that leak an item: the columns before the text, then item_id, cosine, subsequence and answer; None
    if the benchmark has no words."""
    spark, scratch, out = rows.sparkSession, Scratch(rows.sparkSession), None
    kept, kind = rows.columns[:-1], to_arrow_type(benchmark.schema["item_id"].dataType)
    schema = ", ".join([*(f"`{c}` {k}" for c, k in rows.select(*kept).dtypes), f"item_id {dict(benchmark.dtypes)['item_id']}", "cosine double, subsequence double, answer double"])
    for items in _blocks(benchmark):
        terms = {w: k for k, w in enumerate(sorted({w for _, found, answer in items for w in (*found, *answer)}))}
        numbers = scratch.put(number(rows, terms), "numbers")
        shared, size = spark.sparkContext.broadcast(fit(numbers, terms, items)), _kind(len(terms))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, size=size) -> Iterator[pa.RecordBatch]:
            searcher = Searcher(shared.value)
            for batch in batches:
                for at in range(0, batch.num_rows, TEXTS):
                    part = batch.slice(at, TEXTS)
                    found = searcher.leaks(_arrays(part.column(part.num_columns - 1), size))
                    row = pa.array([k for k, x in enumerate(found) for _ in x], pa.int64())
                    columns = [pa.array([y[c] for x in found for y in x], kind if c == 0 else pa.float64()) for c in range(4)]
                    yield pa.RecordBatch.from_arrays([*(c.take(row) for c in part.columns[:-1]), *columns], names=[*kept, "item_id", "cosine", "subsequence", "answer"])

        found = scratch.put(numbers.mapInArrow(run, schema), "found")
        scratch.drop(numbers)
        shared.unpersist()
        out = found if out is None else out.unionByName(found)
    return out


def leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, cosine, subsequence and answer of every leak."""
    found = search(documents.select("doc_id", "text"), benchmark)
    if found is None:
        own = F.lit(None).cast(benchmark.schema["item_id"].dataType).alias("item_id")
        return documents.select("doc_id", own, *(F.lit(None).cast("double").alias(c) for c in ("cosine", "subsequence", "answer"))).limit(0)
    return found


def clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of documents that leak no item, with their own columns. Equal texts leak alike, so a leaky text is known by 128 bits."""
    columns, text = documents.columns, whole(F.col("text"))
    names = ["_leak_h", "_leak_h2"]
    keys = [F.xxhash64(text).alias(names[0]), F.xxhash64(text, F.lit(1)).alias(names[1])]
    found = search(documents.select(*keys, text.alias("text")), benchmark)
    if found is None:
        return documents
    gone = Scratch(documents.sparkSession).put(found.select(*names).distinct(), "gone")
    if gone.count() <= BROADCAST_TEXTS:
        gone = F.broadcast(gone)
    return documents.select(*columns, *keys).join(gone, names, "left_anti").select(*columns)
