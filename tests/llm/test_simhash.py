"""SimHash: fingerprints bit by bit, all pairs by brute force, and components by a plain search."""

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings, strategies as st

from corpusmill.llm import queries, simhash as S
from corpusmill.session import cut
from tests.llm import brute, fixtures


def slow_fingerprint(text, k=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = brute.words(low)
    if not w:
        return 0
    grams = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or [" ".join(w)]
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(prints, budget=4):
    """Smallest position that each can reach."""
    n = len(prints)
    v = np.array(prints, dtype=np.uint64)
    near = np.bitwise_count(v[:, None] ^ v[None, :]) <= budget
    low = np.arange(n)
    while True:
        new = np.where(near, low[None, :], n).min(axis=1)
        if (new == low).all():
            return low.tolist()
        low = new


def clusters(seed, groups, size, flips):
    """Prints around a few centres, some of them chains."""
    r = np.random.default_rng(seed)
    out = []
    for _ in range(groups):
        x = int(r.integers(0, 1 << 63))
        for _ in range(size):
            y = x
            for b in r.integers(0, 64, r.integers(0, flips + 1)):
                y ^= 1 << int(b)
            out.append(y)
            if r.random() < 0.3:
                x = y
    return out


@pytest.mark.parametrize("top", [0, 13])
@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.integers(0, 5))
def test_trie_join_finds_all_pairs(top, seed, budget):
    v = np.unique(np.array(clusters(seed, 4, 25, 4), dtype=np.uint64))
    top = max(top, 1)
    same = lambda x, y: int(x) >> (64 - top) == int(y) >> (64 - top)
    want = {(i, j) for i in range(len(v)) for j in range(i + 1, len(v)) if same(v[i], v[j]) and bin(int(v[i]) ^ int(v[j])).count("1") <= budget}
    got = [(int(x), int(y)) for i, j in S.trie_join(v, None, top, budget) for x, y in zip(i, j)]
    assert sorted(got) == sorted(want)
    a, b = v[::2], v[1::2]
    want = {(i, j) for i in range(len(a)) for j in range(len(b)) if same(a[i], b[j]) and bin(int(a[i]) ^ int(b[j])).count("1") <= budget}
    got = [(int(x), int(y)) for i, j in S.trie_join(a, b, top, budget) for x, y in zip(i, j)]
    assert sorted(got) == sorted(want)


def test_small_frontier(monkeypatch):
    v = np.unique(np.array(clusters(1, 3, 60, 3), dtype=np.uint64))
    want = sorted((int(x), int(y)) for i, j in S.trie_join(v, None, 1, 4) for x, y in zip(i, j))
    monkeypatch.setattr(S, "FRONTIER", 8)
    assert sorted((int(x), int(y)) for i, j in S.trie_join(v, None, 1, 4) for x, y in zip(i, j)) == want


def test_fingerprints():
    for t in [*fixtures.TEXTS, "A b C d e", "a b c d", "a b c", "A a A a A a a", "é É x y z"]:
        if len(t or "") < 20_000:
            assert S.fingerprint(t) == slow_fingerprint(t)
    assert S.fingerprint("w " * 20_000) == S.fingerprint("w w w w")


def test_arrangements_lose_no_pair():
    """Pairs within the budget agree on the top bits of one arrangement at least, however many blocks have to agree."""
    v = np.array(clusters(3, 8, 20, 4), dtype=np.uint64)
    near = [(i, j) for i in range(len(v)) for j in range(i) if bin(int(v[i]) ^ int(v[j])).count("1") <= 4]
    for total, many in ((10, 5), (1 << 20, 15), (1 << 30, 35), (1 << 40, 70)):
        cuts = S.arrangements(4, total, 1 << 8)
        assert len(cuts) == many and all(sorted(x for b, w in blocks for x in range(b, b + w)) == list(range(64)) for blocks, _ in cuts)
        tops = [S.arrange(v, blocks) >> np.uint64(64 - top) for blocks, top in cuts]
        assert all(any(t[i] == t[j] for t in tops) for i, j in near)
        assert all((np.bitwise_count(S.arrange(v, blocks)) == np.bitwise_count(v)).all() for blocks, _ in cuts)


@pytest.mark.parametrize("split, total", [(4096, None), (7, None), (2, 1 << 20)])
def test_components(spark, monkeypatch, split, total):
    if total:  # as in a table of that many, where more blocks have to agree
        monkeypatch.setattr(S, "arrangements", lambda budget, _, size, f=S.arrangements: f(budget, total, size))
    prints = clusters(5, 30, 12, 3) + clusters(6, 1, 80, 2) + [0, 0, 1, 3, (1 << 64) - 1]
    low = slow_components(prints)
    signed = np.array(prints, dtype=np.uint64).view(np.int64).tolist()
    marked = spark.createDataFrame([(i, f) for i, f in enumerate(signed)], "key long, fp long")
    got = {r["key"]: r["component"] for r in S.classes(marked, split=split).collect()}
    assert got == dict(enumerate(low))


def test_long_chain(spark):
    x, prints = 0, []
    for i in range(60):
        prints.append(x)
        x ^= 0b1111 << (i % 61)
    low = slow_components(prints)
    signed = np.array(prints, dtype=np.uint64).view(np.int64).tolist()
    marked = spark.createDataFrame([(59 - i, f) for i, f in enumerate(signed)], "key long, fp long")
    got = {r["key"]: r["component"] for r in S.classes(marked).collect()}
    groups = {}
    for i, g in enumerate(low):
        groups.setdefault(g, []).append(59 - i)
    assert got == {k: min(v) for v in groups.values() for k in v}


def test_awkward_documents(spark):
    docs = fixtures.documents(spark)
    rows = {r["doc_id"]: r for r in S.near_duplicates(docs).collect()}
    prints = [slow_fingerprint(t) if len(t or "") < 100_000 else S.fingerprint(t) for t in fixtures.TEXTS]
    low = slow_components(prints)
    assert {k: (r["fingerprint"], r["component_id"]) for k, r in rows.items()} == {i: (f"{f:016x}", low[i]) for i, f in enumerate(prints)}
    assert S.near_duplicates(fixtures.empty(spark)).collect() == []
    nulls = spark.createDataFrame([(None, "a b c d e"), (4, "a b c d e"), (None, "x y")], "doc_id long, text string")
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in S.near_duplicates(nulls).collect()) == [(-1, -1), (-1, 4), (4, 4)]


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = sorted(spark.read.parquet(f"{sf}/documents.parquet").collect(), key=lambda r: r["doc_id"])
    prints = [S.fingerprint(r["text"]) for r in docs]
    low = [docs[i]["doc_id"] for i in slow_components(prints)]
    got = sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in queries.QUERIES["op10_simhash_dedup"](spark, sf).collect())
    assert got == [(r["doc_id"], f"{f:016x}", c) for r, f, c in zip(docs, prints, low)]


def slow_sets(texts, k=5):
    out = []
    for t in texts:
        w = brute.words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        out.append(({" ".join(w[i : i + k]) for i in range(len(w) - k + 1)} or {" ".join(w)}, tuple(w)))
    return out


def slow_groups(texts, least=0.8):
    """Smallest position that each text can reach over texts of equal words and over similarities, and the similar pairs of different texts."""
    sets, pairs, up = slow_sets(texts), [], list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, (a, w) in enumerate(sets):
        for j in range(i):
            b = sets[j][0]
            if min(len(a), len(b)) >= least * max(len(a), len(b)) and len(a & b) >= least * len(a | b):
                up[max(root(i), root(j))] = min(root(i), root(j))
                if w != sets[j][1]:
                    pairs.append((j, i))
    return [root(i) for i in range(len(texts))], pairs


def edited(r, text, many):
    """The text with some words put in, left out or replaced."""
    w = text.split()
    for _ in range(many):
        k = int(r.integers(0, len(w)))
        w[k : k + int(r.integers(0, 2))] = [f"new{r.integers(0, 99)}"] * int(r.integers(0, 2))
    return " ".join(w)


def test_representatives(spark):
    docs = fixtures.documents(spark)
    low, _ = slow_groups(fixtures.TEXTS)
    kept = S.representatives(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(low))
    rows = [(None, "a b c d e"), (4, "a b c d e"), (4, "a b c d e"), (4, "z y x w v"), (None, None)]
    got = S.representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"] or 0), r["text"] or "") for r in got) == [(0, ""), (4, "a b c d e"), (4, "z y x w v")]
    assert S.representatives(fixtures.empty(spark)).collect() == []
    extra = docs.selectExpr("*", "1 as key", "2 as bucket", "3 as h", "4 as prints", "5 as shingles")
    assert S.representatives(extra).columns == extra.columns and S.representatives(extra).count() == kept.count()


def test_similar_texts_against_all_pairs(spark):
    """Copies with edits, a hot group of them, chains and unlike texts: pairs of 0.8 or more are found, others are not."""
    r = np.random.default_rng(8)
    vocabulary = [f"w{k}" for k in range(2_000)]
    base = [" ".join(r.choice(vocabulary, int(r.integers(30, 400)))) for _ in range(40)]
    texts = list(base)
    for t in base[:25]:
        texts += [edited(r, t, max(1, int(len(t.split()) * share))) for share in (0.005, 0.01, 0.02, 0.03, 0.06)]
    texts += [edited(r, base[30], int(r.integers(0, 12))) for _ in range(120)]
    for _ in range(10):
        texts.append(edited(r, texts[-1], 3))
    texts = [t.upper() if k % 7 == 0 else t.replace(" ", "\n", 1) if k % 5 == 0 else t for k, t in enumerate(texts)]
    low, pairs = slow_groups(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    kept = {x["doc_id"] for x in S.representatives(docs).collect()}
    assert set(low) <= kept and len(kept - set(low)) <= 0.02 * len(texts)
    both_stay = [(i, j) for i, j in pairs if i in kept and j in kept]
    assert len(pairs) > 500 and len(both_stay) <= 0.01 * len(pairs)


def test_recall_on_documents(spark):
    rows = sorted(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect(), key=lambda x: x["doc_id"])
    low, pairs = slow_groups([x["text"] for x in rows])
    kept = {x["doc_id"] for x in S.representatives(spark.createDataFrame(rows)).collect()}
    want = {rows[k]["doc_id"] for k in set(low)}
    missed = [(i, j) for i, j in pairs if rows[i]["doc_id"] in kept and rows[j]["doc_id"] in kept]
    assert want <= kept and len(kept - want) <= 3 and len(missed) <= 0.1 * len(pairs)


def test_units_are_read_whole():
    """Sorted rows come in tables that never cut a unit, whatever the batches; a unit longer than a table stays whole."""
    r = np.random.default_rng(5)
    n = 4000
    rows = sorted(zip(r.integers(0, 3, n).tolist(), r.integers(0, 2, n).tolist(), r.integers(0, 2, n).tolist(), r.integers(0, 30, n).tolist()))
    rows += [(9, 0, 0, 7)] * 500
    table = pa.table({c: [x[k] for x in rows] for k, c in enumerate(S._UNIT)})
    for batch, size in ((1, 100), (64, 100), (1000, 300), (10_000, 100)):
        parts = [p.to_pylist() for p in S.whole_units(iter(table.to_batches(max_chunksize=batch)), size)]
        units = [{tuple(x.values()) for x in p} for p in parts]
        assert [tuple(x.values()) for p in parts for x in p] == rows
        assert all(not a & b for k, a in enumerate(units) for b in units[:k])
        assert batch > 1000 or len(parts) > 5
    assert list(S.whole_units(iter([]))) == []


def test_no_link_is_left_out(spark):
    """Pairs at 0.804, of which fingerprints alone miss some, and links between texts that both follow others."""
    r = np.random.default_rng(11)
    texts = []
    for k in range(2_000):
        w = [f"t{k}w{i}" for i in range(50)]
        texts.append(" ".join(w))
        w[int(r.integers(4, 46))] = "other"
        texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {x["doc_id"] for x in S.representatives(docs).collect()} == set(range(0, len(texts), 2))


@pytest.mark.parametrize("split, sample", [(4096, 4096), (5, 4096), (5, 1)])
def test_missing_finds_every_link(spark, monkeypatch, split, sample):
    """All links of ungrouped texts, hot groups and lines among them, however units are cut and whichever shingles count as frequent."""
    monkeypatch.setattr(S, "TEXTS", sample)
    r = np.random.default_rng(9)
    vocabulary = [f"w{k}" for k in range(300)]
    line = " ".join(r.choice(vocabulary, 30))
    base = [" ".join(r.choice(vocabulary, int(r.integers(6, 90)))) for _ in range(25)]
    texts = base + [edited(r, base[0] + " " + line, int(r.integers(0, 4))) for _ in range(60)] + [edited(r, t + " " + line, k) for t in base for k in (0, 1, 1, 2)]
    texts += ["one", "One", "one two", "", "a b c d e a b c d e a b", "a b c d e a b c d e a"]
    sets = [x for x, _ in slow_sets(texts)]
    want = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if texts[i] and texts[j] and len(a & b) >= 0.8 * len(a | b)}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    marked = cut(S.marks(docs, "doc_id", 0.8, S.frequent_shingles(docs, "doc_id", len(texts))))
    found = S.missing(docs, marked, None, "doc_id", 0.8, split).collect()
    assert {(x["a"], x["b"]) for x in found} == want and len(want) > 300
    groups = spark.createDataFrame([(k, 0) for k in range(1, 60)], "a long, b long")
    group = lambda k: 0 if k < 60 else k
    found = S.missing(docs, marked, groups, "doc_id", 0.8, split).collect()
    assert {(x["a"], x["b"]) for x in found} == {(i, j) for i, j in want if group(i) != group(j)}


def test_parities_never_exceed_the_difference():
    r = np.random.default_rng(2)
    for n in (1, 5, 200, 20_000):
        a = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: n // 2 + 1], r.integers(0, 1 << 63, n // 3).astype(np.uint64)]))
        apart = int(np.bitwise_count(S.parity(a).view(np.uint64) ^ S.parity(b).view(np.uint64)).sum())
        assert apart <= len(np.setxor1d(a, b)) and not (S.parity(a) ^ S.parity(a[::-1])).any()
        assert len(S.parity(a)) == S.PARITY // 64


def test_similar_sets_share_as_many_first_shingles_as_are_asked():
    """Of any two sets that are similar enough, must_share() common shingles are among the first of both and where unit_pairs() looks."""
    r, none, seen = np.random.default_rng(4), (np.zeros(0, np.uint64), np.zeros(0, np.int64)), set()
    for similarity in (0.8, 0.5):
        for _ in range(1_500):
            common, more, others = r.integers(1, 1 << 63, int(r.integers(1, 400))).astype(np.uint64), int(r.integers(0, 50)), int(r.integers(0, 50))
            sets = [np.unique(np.concatenate([common, r.integers(1, 1 << 63, k).astype(np.uint64)])) for k in (more, others)]
            small, large = sorted(sets, key=len)
            both = len(np.intersect1d(small, large))
            if both < similarity * (len(small) + len(large) - both):
                continue
            least = int(S.must_share(np.array([len(small)]), np.array([len(large)]), similarity)[0])
            after = int(S.least_common(np.array([len(small) + len(large)]), similarity)[0]) - least + 1
            near = [{x for place, x in enumerate(S.prefix(own, similarity, none).tolist()) if len(own) - place >= after} for own in (small, large)]
            assert len(near[0] & near[1]) >= least
            seen.add(least)
    assert seen == set(range(1, S.COUNTED + 1))


@pytest.mark.parametrize("split", [4096, 7])
def test_long_unlike_texts_are_not_checked(spark, monkeypatch, split):
    """Long texts that meet at a line: sizes, places and parities allow them all, and their sets would travel once a pair. Links stay."""
    monkeypatch.setattr(S, "TEXTS", 1)  # no shingle counts as frequent
    r, checked, alike = np.random.default_rng(3), [], S.alike
    line, texts = " ".join(f"line{k}" for k in range(11)), []
    for k in range(40):
        texts.append(" ".join([line, *(f"t{k}w{i}" for i in range(2_600))]))
    texts += [edited(r, t, 30) for t in texts[:5]]

    def counted(pairs, sets, similarity):
        checked.append(sorted((x["key"], x["leader"]) for x in pairs.collect()))
        return alike(pairs, sets, similarity)

    monkeypatch.setattr(S, "alike", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    marked = cut(S.marks(docs, "doc_id", 0.8, (np.zeros(0, np.uint64), np.zeros(0, np.int64))))
    links = [(40 + k, k) for k in range(5)]
    assert sorted((x["a"], x["b"]) for x in S.missing(docs, marked, None, "doc_id", 0.8, split).collect()) == links
    assert checked == [links]
