"""Ordinal regression: its gradient by differences, planted words, and held-out accuracy."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from corpusmill.llm import queries, toxicity as X
from tests.llm import fixtures

SF = "/root/testdata/sf0.1"


def planted(n=600, seed=0):
    """Rows of features; marked ones 1, 2 and 3 raise the grade."""
    r = np.random.default_rng(seed)
    rows, y = [], []
    for i in range(n):
        grade = int(r.integers(0, 4)) if i % 3 == 0 else 0
        rows.append(np.array(sorted({*r.integers(100, 160, 12).tolist(), *range(1, grade + 1)})))
        y.append(grade)
    return X.Sparse.of(rows), np.array(y)


def test_sparse_products():
    x, _ = planted(40)
    dense = np.zeros((40, X.SLOTS))
    for r in range(40):
        dense[r, x.slots[x.start[r] : x.start[r + 1]]] = 1
    w = np.random.default_rng(1).normal(size=X.SLOTS)
    assert np.allclose(x.times(w), dense @ w) and np.allclose(x.back(np.arange(40.0), X.SLOTS), np.arange(40.0) @ dense)


def test_grades_and_order_are_learnt():
    x, y = planted()
    model = X.fit(x, y)
    s = model.above(x.times(model.weights))
    assert (np.diff(s, axis=1) <= 0).all() and (np.diff(model.thresholds) > 0).all()
    severity = s.sum(axis=1)
    means = [severity[y == k].mean() for k in range(4)]
    assert means == sorted(means) and means[0] < 0.2 and means[3] > 2.5


def test_fit_is_at_a_minimum():
    """No small step along any kind of parameter lowers the loss by much."""
    x, y = planted()
    model = X.fit(x, y, steps=3000, rate=0.02)

    def loss(m):
        s = np.concatenate((np.ones((len(y), 1)), m.above(x.times(m.weights)), np.zeros((len(y), 1))), axis=1)
        p = s[np.arange(len(y)), y] - s[np.arange(len(y)), y + 1]
        return -np.log(np.maximum(p, 1e-9)).mean() + 1e-5 * (m.weights**2).sum()

    best = loss(model)
    for k in (1, 2, 3):
        for step in (-0.2, 0.2):
            w = model.weights.copy()
            w[k] += step
            assert loss(X.Ordinal(w, model.thresholds)) > best - 1e-3
            t = model.thresholds.copy()
            t[k - 1] += step / 4
            assert loss(X.Ordinal(model.weights, t)) > best - 1e-3


def test_one_class():
    x, y = planted(30)
    model = X.fit(x, np.zeros(30, int))
    assert (model.above(x.times(model.weights)) < 1e-6).all()


def test_awkward_documents(spark):
    docs = fixtures.documents(spark, ["You IDIOT", "idiot"])
    labels = spark.createDataFrame([(5, 1, 0), (None, 1, 1), (7, 1, None), (999, 1, 1), (8, 1, 3)], "doc_id long, quality int, toxic int")
    rows = X.judge(docs, X.train(docs, labels)).collect()
    assert len(rows) == docs.count() and not any(r["toxic"] for r in rows) and all(0 <= r["severity"] <= 3 for r in rows)
    assert X.judge(fixtures.empty(spark), X.train(fixtures.empty(spark), labels.limit(0))).collect() == []


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = X.train(docs, labels.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2))
    got = {r["doc_id"]: r["toxic"] for r in X.judge(docs, model).collect()}
    held = [(r["toxic"], got[r["doc_id"]]) for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert len(got) == docs.count() and sum(a == b for a, b in held) / len(held) > 0.94
    assert sum(a == b == 1 for a, b in held) / sum(a for a, _ in held) > 0.6
    assert sum(b for a, b in held if not a) / sum(not a for a, _ in held) < 0.02


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    assert queries.QUERIES["op1_toxicity"](spark, sf).count() == spark.read.parquet(f"{sf}/documents.parquet").count()
