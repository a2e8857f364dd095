"""Latent retrieval: products and axes against dense numpy, matches against plain dynamic programming."""

import numpy as np
from hypothesis import given, settings, strategies as st

from corpusmill.llm import decontaminate as D, queries
from corpusmill.session import cut
from tests.llm import fixtures

SF = "/root/testdata/sf0.01"


def slow_subsequence(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=12), st.lists(st.sampled_from("abcd"), max_size=90))
def test_subsequence(a, b):
    assert D.subsequence(D.places_of(a), len(a), [w for w in b if w in a]) == slow_subsequence(a, b)


def numbers(documents, terms):
    return cut(D.number(documents.select("text"), terms))


def terms_of(items):
    return {w: k for k, w in enumerate(sorted({w for _, found, answer in items for w in (*found, *answer)}))}


def test_term_arrays():
    texts = ["One two\0 three", None, "", "two.ONE é É x", "\0", " two "]
    terms = {b"one": 0, b"two": 1, "é".encode(): 2}
    assert [x.tolist() for x in D.term_arrays(texts, terms)] == [[terms.get(w, -1) for w in D.words(t)] for t in texts] and D.term_arrays([], terms) == []


def test_sparse_products(monkeypatch):
    monkeypatch.setattr(D, "CHUNK", 7)
    r = np.random.default_rng(0)
    row, term, weights = np.sort(r.integers(0, 12, 80)), r.integers(-1, 20, 80), np.where(np.arange(20) % 5 == 0, 0, 1.5)
    names, start, t, v = D.unit_rows(row, term, weights)
    dense = np.zeros((len(names), 20))
    for k in range(len(names)):
        part = slice(start[k], np.append(start, len(t))[k + 1])
        np.add.at(dense[k], t[part], v[part])
        own = term[(row == names[k]) & (term >= 0)]
        want = np.bincount(own, minlength=20) * weights
        assert np.allclose(dense[k], want / np.sqrt((weights[own] ** 2).sum()), atol=1e-6)
    m = r.normal(size=(20, 3)).astype(np.float32)
    out = np.zeros((20, 3))
    D.gram_times(start, t, v, m, out)
    assert np.allclose(D.project(start, t, v, m), dense @ m, atol=1e-5) and np.allclose(out, dense.T @ dense @ m, atol=1e-4)


def corpus():
    r = np.random.default_rng(4)
    vocabulary = ["".join(chr(97 + int(c)) for c in str(k)) for k in range(10_000, 13_000)]
    text = lambda n: " ".join(r.choice(vocabulary, n))
    items = [text(25) for _ in range(6)]
    docs = [text(int(r.integers(5, 300))) for _ in range(60)]
    docs += [text(100) + " " + items[0] + " " + text(90), items[1].upper(), text(30) + ", " + items[2].replace(" ", ",\n") + "."]
    w = items[3].split()
    docs.append(text(50) + " " + " ".join(x if k % 5 else "filler" for k, x in enumerate(w)) + " " + text(50))
    docs.append(text(40) + " " + " ".join(w[:6]) + " " + text(40))
    return docs, items


def test_axes_span_the_leading_directions(spark):
    docs, items = corpus()
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(3)
    parsed = [(k, D.words(t), []) for k, t in enumerate(items)]
    terms = terms_of(parsed)
    model = D.fit(numbers(frame, terms), terms, parsed, rank=4, extra=30)
    rows = []
    for d in docs:
        (found,) = D.term_arrays([d], terms)
        for at in range(0, len(found), D.PASSAGE):
            t = found[at : at + D.PASSAGE]
            t = t[t >= 0]
            x = np.bincount(t, minlength=len(terms)) * model.weights
            rows += [x / np.sqrt((model.weights[t] ** 2).sum())] if x.any() else []
    owners, row, term = D.item_passages(parsed, terms, D.PASSAGE)
    names, start, t, v = D.unit_rows(row, term, model.weights)
    own = np.zeros((len(names), len(terms)))
    for k in range(len(names)):
        part = slice(start[k], np.append(start, len(t))[k + 1])
        np.add.at(own[k], t[part], v[part])
    a = np.array(rows)
    gram = a.T @ a + own.T @ own * (len(a) / len(own))
    values, vectors = np.linalg.eigh(gram)
    best = values[::-1][:4].sum()
    got = np.trace(model.axes.T.astype(float) @ gram @ model.axes)
    assert got > 0.97 * best
    assert np.allclose(model.axes.T @ model.axes, np.eye(4), atol=1e-4)


def test_planted_leaks(spark):
    docs, items = corpus()
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(items)] + [(90, None), (91, " .")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in D.leaks(frame, bench).collect()}
    assert got == {(60, 0), (61, 1), (62, 2), (63, 3)}
    kept = D.clean(frame.withColumn("extra", frame["doc_id"]), bench)
    assert kept.columns == ["doc_id", "text", "extra"] and sorted(r["doc_id"] for r in kept.collect()) == [*range(60), 64]


def test_leak_copied_to_a_third_of_the_rows(spark):
    """All words of the item are common then; copies, leaks among other words, and leaks of other items are found all the same."""
    docs, items = corpus()
    lone = len(docs)
    docs += [" ".join(docs[1].split()[:70]) + " " + items[4] + " " + docs[2], items[4].upper()]
    copies = range(len(docs), len(docs) + len(docs) // 2)
    docs += [" ".join(docs[0].split()[:40]) + " " + items[4] + " " + " ".join(docs[3].split()[:40])] * len(copies)
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in D.leaks(frame, bench).collect()}
    assert got == {(60, 0), (61, 1), (62, 2), (63, 3), (lone, 4), (lone + 1, 4), *((k, 4) for k in copies)}
    assert {r["doc_id"] for r in D.clean(frame, bench).collect()} == {*range(60), 64}


def brute_leaks(texts, items):
    """Pairs that the checks accept at any window of any text, by plain dynamic programming; an item is (words, answers)."""
    out = set()
    for d, text in enumerate(texts):
        found = [w.decode() for w in D.words(text)]
        for i, (item, answers) in enumerate(items):
            width = D.reach(len(item))
            if sum(w in set(found) for w in item) < D.PARAPHRASE * len(item):
                continue
            for at in range(max(1, len(found) - width + 1)):
                window = found[at : at + width]
                if sum(w in window for w in item) < D.PARAPHRASE * len(item):
                    continue
                share = slow_subsequence(item, window) / len(item)
                if share >= D.VERBATIM or (share >= D.PARAPHRASE and len(answers & set(window)) >= D.ANSWER * len(answers)):
                    out.add((d, i))
                    break
    return out


def reworded(r, item, share, vocabulary):
    """A paraphrase: a share of the words, in order, goes on; others are replaced."""
    return " ".join(w if k % 10 < 10 * share else r.choice(vocabulary) for k, w in enumerate(item.split()))


def test_recall_against_all_pairs(spark):
    """Verbatim, short, common-worded and reworded items, against the checks by dynamic programming at every window of every text."""
    r = np.random.default_rng(11)
    vocabulary = ["".join(chr(97 + int(c)) for c in str(k)) for k in range(10_000, 13_000)]
    common = vocabulary[:25]
    text = lambda n, of: " ".join(r.choice(of, n))
    items = [text(30, vocabulary) for _ in range(6)] + [text(n, vocabulary) for n in (4, 4, 8, 12)] + [text(30, common) for _ in range(2)]
    docs = [text(int(r.integers(60, 200)), vocabulary + common * 300) for _ in range(50)]
    for k, item in enumerate(items):
        docs.append(text(50, vocabulary) + " " + item + " " + text(45, vocabulary))
        if k < 6:
            docs += [text(33, vocabulary) + " " + reworded(r, item, share, vocabulary) + " " + text(70, vocabulary) for share in (0.9, 0.8, 0.7, 0.6)]
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    bench = spark.createDataFrame([(f"item {k}", t) for k, t in enumerate(items)], "item_id string, text string")
    got = {(r["doc_id"], int(r["item_id"].split()[1])) for r in D.leaks(frame, bench).collect()}
    (parsed,) = D._blocks(bench)
    parsed = sorted(parsed, key=lambda x: int(x[0].split()[1]))
    terms = terms_of(parsed)
    searcher = D.Searcher(D.fit(numbers(frame, terms), terms, parsed))
    names = {k: w.decode() for w, k in terms.items()}
    want = brute_leaks(docs, [([w.decode() for w in own], {names[t] for t in searcher.answers[i]}) for i, (_, own, _) in enumerate(parsed)])
    exact = {(d, i) for d, t in enumerate(docs) for i, x in enumerate(items) if f" {x} " in f" {t} "}
    assert len(exact) >= len(items) and exact <= got <= want
    assert len(want) > len(items) + 10 and len(want & got) >= 0.9 * len(want)


def test_search_misses_no_verified_pair(spark):
    """Every pair that the check alone would accept, over all places of all texts, is found by the search."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(400)
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = next(D._blocks(bench))
    terms = terms_of(items)
    searcher = D.Searcher(D.fit(numbers(docs, terms), terms, items))
    rows = docs.collect()
    texts = D.term_arrays([r["text"] for r in rows], terms)
    want = set()
    for r, found in zip(rows, texts):
        have = set(found.tolist())
        for i, (name, _, _) in enumerate(items):
            if len(have & set(searcher.items[i])) >= 0.4 * len(set(searcher.items[i])) and searcher.check(found, i, [(1.0, p) for p in range(0, max(1, len(found)), 32)]):
                want.add((r["doc_id"], name))
    got = {(r["doc_id"], x[0]) for r, found in zip(rows, searcher.leaks(texts)) for x in found}
    exact = {(r["doc_id"], b["item_id"]) for r in rows for b in bench.collect() if b["text"] in r["text"]}
    assert exact <= got and len(want - got) <= 0.1 * len(want) and got <= want


def test_long_texts_are_searched_in_pieces(spark, monkeypatch):
    docs, items = corpus()
    parsed = [(k, D.words(t), []) for k, t in enumerate(items)]
    terms = terms_of(parsed)
    model = D.fit(numbers(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), terms), terms, parsed)
    joined = [" ".join(docs[k] for k in (0, 60, 1, 62, 63, 2)), docs[61], "", " ".join(docs[3:9])]
    whole = D.Searcher(model).leaks(D.term_arrays(joined, terms))
    assert [[x[0] for x in y] for y in whole] == [[0, 2, 3], [1], [], []]
    monkeypatch.setattr(D, "PIECE", 5)
    cut_up = D.Searcher(model).leaks(D.term_arrays(joined, terms))
    assert [[x[0] for x in y] for y in cut_up] == [[x[0] for x in y] for y in whole]


def test_ids_of_any_kind(spark):
    docs, items = corpus()
    frame = spark.createDataFrame([(None if k == 60 else str(k % 61), t) for k, t in enumerate(docs)], "doc_id string, text string")
    bench = spark.createDataFrame([("a", items[0]), ("a", items[1]), (None, items[2])], "item_id string, text string")
    got = sorted((r["doc_id"] or "-", r["item_id"] or "-") for r in D.leaks(frame, bench).collect())
    assert got == [("-", "a"), ("0", "a"), ("1", "-")]
    extra = frame.selectExpr("*", "1 as item_id", "2 as words", "3 as _h", "4 as cosine")
    assert D.clean(extra, bench).count() == len(docs) - 3 and D.clean(extra, bench).columns == extra.columns


def test_answers_column(spark):
    docs, items = corpus()
    frame = spark.createDataFrame([(0, docs[63])], "doc_id long, text string")
    for answer, n in ((items[3].split()[1], 1), ("absent words", 0)):
        bench = spark.createDataFrame([(3, items[3], answer)], "item_id long, text string, answer string")
        share = D.best_match(D.words(items[3]), D.words(docs[63]))[0]
        assert D.PARAPHRASE <= share < 0.9 and (n == 1 or share >= D.VERBATIM or D.leaks(frame, bench).collect() == [])


def test_awkward_documents(spark):
    bench = spark.createDataFrame([(0, fixtures.PROSE), (None, "one two three")], "item_id long, text string")
    docs = fixtures.documents(spark)
    got = {(r["doc_id"], r["item_id"]) for r in D.leaks(docs, bench).collect()}
    assert {(5, 0), (6, 0), (4, None)} <= got and {d for d, _ in got} <= {4, 5, 6}
    assert D.leaks(docs, bench.limit(0)).collect() == [] and D.leaks(fixtures.empty(spark), bench).collect() == []
    assert D.clean(docs, bench.limit(0)).count() == docs.count() and D.clean(docs, bench).columns == docs.columns


def test_query(spark):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    got = {(r["doc_id"], r["item_id"]) for r in queries.QUERIES["op6_benchmark_leaks"](spark, SF).collect()}
    assert {(d["doc_id"], b["item_id"]) for d in docs for b in bench if b["text"] in d["text"]} <= got
