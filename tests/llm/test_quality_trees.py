"""Boosted trees: a naive walk, a naive split search, and held-out accuracy."""

import numpy as np
import pytest

from corpusmill.llm import quality_trees as Q, queries
from tests.llm import fixtures

SF = "/root/testdata/sf0.01"


def walk(model, x):
    total = model.base
    for k in model.roots:
        while model.left[k] != k:
            k = model.left[k] if x[model.feature[k]] <= model.threshold[k] else model.right[k]
        total += model.value[k]
    return 1 / (1 + np.exp(-total))


def data(n=600):
    r = np.random.default_rng(3)
    x = r.normal(size=(n, 5)).round(1)
    return x, ((x[:, 1] > 0.2) ^ (x[:, 3] > 0)).astype(float)


def test_flat_traversal_is_the_naive_walk():
    x, y = data()
    model = Q.fit(x, y, trees=30)
    assert np.allclose(model.score(x, block=100), [walk(model, row) for row in x])
    assert ((model.score(x) >= 0.5) == y).mean() > 0.97


def test_first_split_is_the_best_one():
    x, y = data()
    model = Q.fit(x, y, trees=1, depth=1, bins=256, least=20)
    p = y.mean()
    g, h = p - y, np.full(len(y), p * (1 - p))

    def gain(f, t):
        a = x[:, f] <= t
        if min(a.sum(), (~a).sum()) < 20:
            return -1
        part = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1)
        return part(a) + part(~a) - part(a | ~a)

    best = max(gain(f, t) for f in range(5) for t in np.unique(x[:, f]))
    root = model.roots[0]
    assert gain(model.feature[root], model.threshold[root]) == pytest.approx(best, rel=0.05)


def test_degenerate_labels():
    x, y = data(50)
    assert np.allclose(Q.fit(x, np.ones(50)).score(x), 1, atol=1e-5)
    assert np.allclose(Q.fit(np.zeros((0, 24)), np.zeros(0)).score(np.zeros((2, 24))), 0.5)


def test_awkward_documents(spark):
    docs = fixtures.documents(spark)
    labels = spark.createDataFrame([(5, 1, 0), (6, 1, 0), (16, 0, 0), (None, 1, 0), (7, None, 0), (999, 1, 0), (3, 5, 0)], "doc_id long, quality int, toxic int")
    model = Q.train(docs, labels)
    rows = Q.judge(docs, model).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(len(fixtures.TEXTS)))
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    by = {r["doc_id"]: r["score"] for r in rows}
    assert by[5] == by[6] and by[0] == by[1]
    assert Q.judge(fixtures.empty(spark), Q.train(fixtures.empty(spark), labels.limit(0))).collect() == []
    assert Q.accepted(docs, model).columns == docs.columns


def test_held_out_accuracy(spark):
    import zlib

    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = queries.QUERIES["op2_quality_trees"](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in held) / len(held) > 0.95


def test_labels_of_held_out_rows_are_not_read(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(300)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    from pyspark.sql import functions as F

    flipped = labels.withColumn("quality", F.when(Q.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = Q.train(docs, labels), Q.train(docs, flipped)
    assert np.array_equal(a.value, b.value) and np.array_equal(a.threshold, b.threshold)
