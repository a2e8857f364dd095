"""Quality classifier: histogram gradient-boosted trees over document statistics.

Free style: a pandas UDF computes each text's statistics and walks the trees for a whole batch at once;
one narrow scan, no shuffle of texts. The trees are fitted on the driver, on at most `sample` labelled
rows (SAMPLE, chosen by the least hash of their ids; these ids are broadcast, and their statistics, a few
hundred bytes a row, reach the driver); the fitted trees are flattened into arrays of a fixed size.

Cases: null and empty texts have statistics of zero and get a score; repeated labels count as often as they
stand; labels that are null, not 0 or 1, or without a document teach nothing; with one class only, every
score is that class's share (no labels: 0.5). Texts are read whole, ties go to the smaller bin, repeated
rows score alike. Extra columns are passed on by score_column. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

#: Labelled rows that the trees are fitted on, at most.
SAMPLE = 20_000
KEEP = 0.7

#: Statistics of a text, in the order of statistics().
NAMES = [
    "log_bytes", "log_words", "mean_word", "log_longest", "log_lines", "mean_line", "upper_of_letters", "digits", "letters", "high_bytes", "spaces",
    "symbols", "bangs", "bars", "stops", "commas", "quotes", "other_marks", "byte_entropy", "distinct_words", "top_word", "repeated_neighbours", "repeated_lines", "short_words",
]


def _classes() -> np.ndarray:
    groups = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " \t\n\x0b\x0c\r", "#*$%&<>", "!", "|", ".?", ",;:", "\"'`", "@/\\()[]{}+-=_~^"]
    table = np.zeros((256, len(groups) + 1))
    for k, g in enumerate(groups):
        table[[ord(c) for c in g], k] = 1
    table[128:, len(groups)] = 1
    return table


_CLASSES = _classes()


def statistics(text: str | None) -> list[float]:
    raw = (text or "").encode("utf-8", "replace")
    n = len(raw)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, lower, digits, spaces, symbols, bangs, bars, stops, commas, quotes, marks, high = (counts @ _CLASSES).tolist()
    words = raw.split()
    m = len(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    seen = Counter(words)
    share = counts[counts > 0] / max(1, n)
    per = 1 / max(1, n)
    lengths = list(map(len, words))
    letters = upper + lower
    return [
        math.log1p(n), math.log1p(m), sum(lengths) / max(1, m), math.log1p(max(lengths, default=0)), math.log1p(len(lines)), n / max(1, len(lines)), upper / max(1, letters), digits * per, letters * per, high * per, spaces * per,
        symbols * per, bangs * per, bars * per, stops * per, commas * per, quotes * per, marks * per, float(-(share * np.log(share)).sum()), len(seen) / max(1, m), max(seen.values(), default=0) / max(1, m),
        sum(map(eq, words, words[1:])) / max(1, m), 1 - len(set(lines)) / max(1, len(lines)), sum(x <= 2 for x in lengths) / max(1, m),
    ]


@dataclass(frozen=True)
class Trees:
    """All trees in flat arrays; a leaf is its own child. score = logistic(base + sum of the leaves' values)."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def score(self, x: np.ndarray, block: int = 4096) -> np.ndarray:
        out = np.empty(len(x))
        for at in range(0, len(x), block):
            part = x[at : at + block]
            rows = np.arange(len(part))[:, None]
            node = np.broadcast_to(self.roots, (len(part), len(self.roots)))
            for _ in range(self.depth):
                node = np.where(part[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            out[at : at + block] = self.base + self.value[node].sum(axis=1)
        return 1 / (1 + np.exp(-out))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.1, ridge: float = 1.0, least: int = 20) -> Trees:
    """Second-order boosting of the logistic loss; splits are sought over quantile bins."""
    n = len(y)
    share = min(max(float(y.mean()) if n else 0.5, 1e-6), 1 - 1e-6)
    base = math.log(share / (1 - share))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(1) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1) if n else np.zeros(x.shape, int)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def node(v: float) -> int:
        k = len(value)
        feature.append(0), threshold.append(0.0), left.append(k), right.append(k), value.append(v)
        return k

    margin = np.full(n, base)
    offset = np.arange(x.shape[1]) * (bins + 1)
    for _ in range(trees if 0 < y.sum() < n else 0):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        leaf = lambda r: -rate * g[r].sum() / (h[r].sum() + ridge)  # noqa: E731, B023
        everything = np.arange(n)
        roots.append(node(leaf(everything)))
        front = [(roots[-1], everything)]
        for level in range(depth + 1):
            below = []
            for k, rows in front:
                best = (1e-9, 0, 0)
                if level < depth and len(rows) >= 2 * least:
                    flat = (binned[rows] + offset).ravel()
                    size = x.shape[1] * (bins + 1)
                    hist = [np.bincount(flat, np.repeat(w, x.shape[1]), size).reshape(-1, bins + 1).cumsum(axis=1) for w in (g[rows], h[rows], np.ones(len(rows)))]
                    gl, hl, nl = (c[:, :-1] for c in hist)
                    gt, ht, nt = (c[:, -1:] for c in hist)
                    gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                    gain[(nl < least) | (nt - nl < least)] = -1
                    for f, e in enumerate(edges):
                        gain[f, len(e) :] = -1
                    at = int(gain.argmax())
                    best = max(best, (float(gain.flat[at]), *divmod(at, bins)), key=lambda b: b[0])
                if best[0] > 1e-9:
                    _, f, b = best
                    goes = binned[rows, f] <= b
                    kids = [(node(leaf(r)), r) for r in (rows[goes], rows[~goes])]
                    feature[k], threshold[k], left[k], right[k], value[k] = f, float(edges[f][b]), kids[0][0], kids[1][0], 0.0
                    below += kids
                else:
                    margin[rows] += value[k]
            front = below
    as_array = lambda v, kind: np.array(v, dtype=kind)
    if not roots:
        node(0.0)
        roots.append(0)
    return Trees(base, as_array(roots, int), as_array(feature, int), as_array(threshold, float), as_array(left, int), as_array(right, int), as_array(value, float), depth)


def held_out(key: Column) -> Column:
    """Rows that labels aren't learnt from."""
    return F.crc32(key.cast("string")) % 4 == 2


def training_rows(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of the sample."""
    marked = labels.where("doc_id is not null and quality in (0, 1)").where(~held_out(F.col("doc_id"))).select("doc_id", F.col("quality").alias("y"))
    marked = marked.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample)
    texts = documents.select("doc_id", "text").join(F.broadcast(marked), "doc_id")

    @F.pandas_udf("array<double>")
    def stats(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(statistics, na_action=None)

    rows = texts.select("doc_id", "y", stats("text").alias("x")).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["y"], r["x"]))
    return np.array([r["x"] for r in rows], dtype=float).reshape(-1, len(NAMES)), np.array([r["y"] for r in rows], dtype=float)


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    return fit(*training_rows(documents, labels, sample))


def score_column(model: Trees, text: Column) -> Column:
    """The score of a text, 0 to 1; higher: label 1 is likelier."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            x = np.array([statistics(t) for t in batch], dtype=float).reshape(-1, len(NAMES))
            yield pd.Series(model.score(x))

    return score(text)


def judge(documents: DataFrame, model: Trees, keep: float = KEEP) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    scored = documents.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), score_column(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= keep).cast("int"))


def accepted(documents: DataFrame, model: Trees, keep: float = KEEP) -> DataFrame:
    """The rows that the classifier doesn't reject, with their own columns."""
    return documents.where(score_column(model, F.col("text")) >= keep)
