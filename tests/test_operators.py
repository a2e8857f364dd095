"""Search, joins, clusters, concepts and retention against plain Python."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import chunking, clustering, concepts, overlap, presence, rdf, retention, retrieval, similarity
from corpusmill.plans import catalog


def vectors(spark, n=90, width=5, seed=0):
    x = np.random.default_rng(seed).normal(size=(n, width))
    x[7] = 0
    x[11] = x[3]
    rows = [(i, [float(np.float32(c)) for c in v], i % 4) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3), x.astype(np.float32).astype(float)


def cosines(x):
    n = np.linalg.norm(x, axis=1, keepdims=True)
    u = np.divide(x, n, out=np.zeros_like(x), where=n > 0)
    return u @ u.T


def test_top_k(spark):
    df, x = vectors(spark)
    c = cosines(x)
    for block in (4096, 3):
        got = {}
        for r in similarity.top_k(df.where("vec_id < 9"), df, 4, block=block).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["doc_id"]))
        assert {q: [d for _, d in sorted(v)] for q, v in got.items()} == {q: sorted(range(90), key=lambda d: (-round(c[q, d], 9), d))[:4] for q in range(9)}
    assert similarity.top_k(df.limit(0), df).collect() == [] and similarity.top_k(df, df.limit(0)).collect() == []


@pytest.mark.parametrize("block", [4096, 20])
def test_links_and_counts(spark, block):
    df, x = vectors(spark)
    c = cosines(x)
    want = {(i, j) for i in range(90) for j in range(i + 1, 90) if c[i, j] > 0.7}
    assert {(r["i"], r["j"]) for r in similarity.links(df, 0.7, block=block).collect()} == want
    counts = {r["vec_id"]: r["n_links"] for r in similarity.link_counts(df, 0.7, block=block).collect()}
    assert counts == {i: sum(i in p for p in want) for i in range(90)}


def greedy(c, threshold):
    lead, out = [], {}
    for i in range(len(c)):
        out[i] = next((j for j in lead if c[i, j] > threshold), i)
        if out[i] == i:
            lead.append(i)
    return out


@pytest.mark.parametrize("threshold", [0.3, 0.7, 0.999999, 1.5])
def test_leaders(spark, threshold):
    df, x = vectors(spark, 60)
    assert {r["vec_id"]: r["leader"] for r in similarity.leaders(df, threshold).collect()} == greedy(cosines(x), threshold)


def test_leaders_are_not_transitive(spark):
    s = np.sqrt
    rows = [(1, [1.0, 0.0]), (2, [0.9, float(s(1 - 0.81))]), (3, [0.62, float(s(1 - 0.62**2))])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert {r["vec_id"]: r["leader"] for r in similarity.leaders(df, 0.85).collect()} == {1: 1, 2: 1, 3: 3}


def slow_moves(sizes, least, most):
    """Round by round over lists of members, the farthest last."""
    members = {c: [(c, k) for k in range(n, 0, -1)] for c, n in sizes.items()}
    for _ in range(10):
        moved = False
        small = [c for c in sorted(members) if len(members[c]) < least]
        for c in [c for c in sorted(members) if len(members[c]) > most]:
            if not small:
                break
            n = min(len(members[c]) - most, least - len(members[small[0]]))
            for _ in range(n):
                members[small[0]].append(members[c].pop())
            moved = moved or n > 0
            small = [c for c in sorted(members) if len(members[c]) < least]
        if not moved:
            break
    return {c: len(m) for c, m in members.items()}


def test_move_plan():
    r = np.random.default_rng(0)
    for _ in range(300):
        sizes = dict(enumerate(r.integers(0, 30, 6).tolist()))
        least = int(r.integers(0, 12))
        most = least + int(r.integers(0, 10))
        after = dict(sizes)
        for c, a, b, t in clustering.move_plan(sizes, least, most):
            after[c] -= b - a + 1
            after[t] += b - a + 1
        assert after == slow_moves(sizes, least, most)
    assert clustering.move_plan({0: 9, 1: 1, 2: 5}, 3, 6) == [(0, 1, 2, 1)]


def test_rebalance(spark):
    x = [[float(i), 0.0] for i in range(9)] + [[50.0, 0.0]] + [[100.0 + i, 1.0] for i in range(5)]
    df = spark.createDataFrame([(i, v, 0 if i < 9 else 1 if i == 9 else 2) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: (r["cluster_id"], r["moved"]) for r in clustering.rebalance(df, "label", 3, 6).collect()}
    assert {k for k, v in got.items() if v[1]} == {0, 8} and got[0][0] == 1 and sorted(v[0] for v in got.values()) == [0] * 7 + [1] * 3 + [2] * 5
    with pytest.raises(ValueError):
        clustering.rebalance(df, "label", 7, 6)


def test_cluster_sizes_and_counts(spark):
    df, _ = vectors(spark, 30)
    assert tuple(clustering.size_stats(df, "label").first()) == (30, 4, 7, 8, 7.5)
    assert tuple(clustering.size_stats(df.limit(0), "label").first()) == (0, 0, 0, 0, 0.0)
    assert [r["n"] for r in clustering.histogram(df, "label", 6).orderBy("cluster_id").collect()] == [8, 8, 7, 7, 0, 0]
    assert [clustering.cluster_count(n) for n in (3, 30, 200)] == [5, 5, 20] and clustering.cluster_count(100, 7) == 7 and clustering.cluster_count(1000, max_size=5) == 200
    assert clustering.size_limits(100, 10) == (5, 15)


def test_kmeans_and_assignment(spark):
    rows = [(i, [float(i % 2) * 10, float(i)]) for i in range(0, 20, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r["vec_id"]: r["cluster_id"] for r in clustering.kmeans(df, 2).collect()}
    assert len(got) == 20 and len(set(got.values())) == 2
    labelled = df.withColumn("label", (F.col("vec_id") % 2).cast("int"))
    near = {r["vec_id"]: r["cluster_id"] for r in clustering.assign(df, clustering.centers(labelled, "label")).collect()}
    assert near == {i: i % 2 for i in range(20)}


RESPONSES = [
    ('{"ontologies":[{"name":"A","description":"d","relationships":[{"relation":"A -> eats -> B","type":"other"}]}]}', None),
    ('```json\n{"ontologies":[{"name":"A","description":"d","relationships":[]}]}\n```', None),
    ("sorry", "not a JSON object"), ("[1]", "not a JSON object"), ('{"ontologies":[]}', "no ontologies"), ('{"x":1}', "no ontologies"), ('{"ontologies":[{"name":" ","description":"d","relationships":[]}]}', "a name or description is missing"),
    *((f'{{"ontologies":[{{"name":"A","description":"d","relationships":[{{"relation":"{r}","type":"{t}"}}]}}]}}', "a relationship is malformed") for r, t in (("A -> is related to -> B", "TYPE"), ("A -> A -> B", "TYPE"), ("A -> x", "TYPE"), ("A -> x -> B", "KIND"), ("A ->  -> B", "TYPE"), ("", "TYPE"))),
]


def test_responses(spark):
    rows = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(RESPONSES)], "cluster_id long, response string")
    got = rows.select("cluster_id", concepts.response_error(F.col("response")).alias("e")).orderBy("cluster_id").collect()
    assert [r["e"] for r in got] == [e for _, e in RESPONSES]
    assert [(r["source_cluster"], r["name"]) for r in concepts.parse_responses(rows).orderBy("source_cluster").collect()] == [(0, "A"), (1, "A")]


def test_merge_and_summaries(spark):
    rel = "array<struct<relation:string,type:string>>"
    rows = spark.createDataFrame([(2, "b", " X ", "two", [("X -> p -> Y", "OTHER")], 5), (1, "a", "x", "one", [], 4), (3, "c", "z", "", [], None)], f"ord int, k string, name string, description string, relationships {rel}, source_cluster int")
    rows = rows.withColumn("key", concepts.name_key(F.col("name")))
    merged = {r["key"]: r for r in concepts.merge_groups(rows, "key").collect()}
    assert merged["x"]["description"] == "one\ntwo" and merged["x"]["source_clusters"] == [4, 5] and merged["x"]["merged_from_count"] == 2 and merged["z"]["source_clusters"] == [-1]
    s = concepts.summaries(concepts.merge_groups(rows, "key").withColumn("ord", F.col("key"))).orderBy(F.col("cluster_id").desc()).collect()
    assert [r["cluster_id"] for r in s] == [-1, -2] and s[0]["ontology_summary"] == "x：one\ntwo\n关系：\n- X -> p -> Y" and s[1]["ontology_summary"] == "z："
    answer = spark.createDataFrame([('{"description":"d"}',), ("junk",)], "x string").select(concepts.merge_response(F.col("x")).alias("m")).collect()
    assert answer[0]["m"]["description"] == "d" and answer[1]["m"]["description"] == "" and answer[1]["m"]["relationships"] == []


def test_rdf(spark):
    rel = "array<struct<relation:string,type:string>>"
    rows = spark.createDataFrame([("Big Cat", 'a "cat"\nRelations: x', 2, 7, 1, [("Big Cat -> hunts in -> Night", "OTHER"), ("Big Cat -> is -> Animal", "type")]), ("big cat", "longer description", 1, 8, 2, [("broken", "OTHER")])], f"ontology_name string, description string, document_count int, cluster_id int, ord int, relationships {rel}")
    edges = rdf.triples(rows)
    assert {tuple(r) for r in edges.collect()} == {("BigCat", "huntsIn", "Night", "OTHER"), ("BigCat", "subClassOf", "Animal", "TYPE")}
    nodes = {r["name"]: r for r in rdf.classes(rows, edges).collect()}
    assert nodes["BigCat"]["document_count"] == 3 and nodes["BigCat"]["description"] == "longer description" and nodes["BigCat"]["original_name"] == "Big Cat" and nodes["BigCat"]["cluster_id"] == 7
    assert nodes["Night"]["cluster_id"] == -999 and set(nodes) == {"BigCat", "Night", "Animal"}
    lines = [r["line"] for r in rdf.turtle(rdf.classes(rows, edges), rdf.properties(edges), edges, "http://x.example/a").orderBy("section", "key").collect()]
    assert lines[0] == "@prefix mill: <http://x.example/a#> ." and "mill:BigCat rdfs:subClassOf mill:Animal ." in lines and "mill:BigCat mill:huntsIn mill:Night ." in lines
    import xml.etree.ElementTree as E

    xml = "\n".join(r["line"] for r in rdf.rdf_xml(rdf.classes(rows, edges), rdf.properties(edges), edges).orderBy("section", "key").collect())
    assert len(E.fromstring(xml.encode())) == 1 + 3 + 5 + 1 + 2


def pack(text, least, most):
    import re

    done, cur, n = [], [], 0
    for s in (x.strip() for x in re.split(r"[.!?]+", text)):
        if not s:
            continue
        k = len(s.split())
        if n + k > most and n >= least:
            done.append(" ".join(cur))
            cur, n = [], 0
        cur.append(s)
        n += k
    return done + ([" ".join(cur)] if cur else [])


def test_chunks(spark):
    texts = ["", "one. two! three?", "a b c d. " * 9, "x " * 30 + ". y. z z z. " * 4, "w " * 150, "w " * 151]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    got = [r["c"] for r in rows.select("id", chunking.chunks(F.col("t"), 6, 10).alias("c")).orderBy("id").collect()]
    assert got == [pack(t, 6, 10) for t in texts]
    made = {(r["key"], r["part"]): r["title"] for r in chunking.corpus_rows(rows, "id", "t").collect()}
    assert made[4, 0] == "Document 4" and made[5, 0] == "Document 5 - Part 1"


def test_texts_are_cut_up_once(spark):
    """The size of the chunks was tested before they were exploded, and each test made them again; ranges were sampled from rows made for it."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = chunking.corpus_rows(docs, "doc_id", "text")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[.!?]+") == 1
    made = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    rows = docs.select("doc_id").mapInArrow(seen, "doc_id long")
    numbered = chunking.running_ids(rows, ["doc_id"])
    assert numbered.agg(F.max("idx")).first()[0] == docs.count() - 1 == made.value - 1


def test_retention(spark):
    rows = spark.createDataFrame([(f"a_202401{d:02d}_000000.json", "a") for d in range(1, 9)] + [("a_x.json", "a"), ("b_20240101_000000.txt", "b")], "name string, kind string").withColumn("time", retention.stamp(F.col("name")))
    gone = {r["name"] for r in retention.beyond_newest(rows.where("time is not null"), "kind", "time", "name").collect()}
    assert gone == {f"a_202401{d:02d}_000000.json" for d in (1, 2, 3)}
    old = retention.older_than(rows, "time", 3, F.to_timestamp(F.lit("2024-01-08"))).count()
    assert old == 5
    calls = spark.createDataFrame([(1.0, "success"), (3.0, "success"), (9.0, "error")], "duration double, status string")
    assert tuple(retention.call_stats(calls, "duration", F.col("status") == "success", 10.0).first()) == pytest.approx((3, 2, 200 / 3, 0.3, 2.0, 3.0, 1.0))


def test_retrieval(spark):
    rows = spark.createDataFrame([(1, 2, "original_document", "T", "c2", 0.5, "d"), (1, 1, "ontology_summary", "S", "c1", 0.75, "e"), (2, 1, "ontology_summary", "S", "c1", 0.25, "e")], "query_id long, rank int, doc_type string, title string, content string, similarity_score double, doc_id string")
    assert retrieval.prompt_context(rows).where("query_id = 1").first()["context"] == "[ONTOLOGY_SUMMARY] S\nc1\n(Relevance: 0.750)\n\n[ORIGINAL_DOCUMENT] T\nc2\n(Relevance: 0.500)"
    assert tuple(retrieval.run_summary(rows).first()) == (2, 3, 1.5, 2, 1, 2.0)
    assert retrieval.run_summary(rows.where("query_id = 2")).first()["ontology_ratio"] == float("inf") and retrieval.run_summary(rows.limit(0)).first()["total_queries"] == 0
    docs = retrieval.document_rows(spark.createDataFrame([("1", None, "x")], "id string, title string, context string"))
    both = retrieval.index_rows(docs, retrieval.summary_rows(spark.createDataFrame([(-1, "s")], "cluster_id int, ontology_summary string"))).collect()
    assert [tuple(r) for r in both] == [("original_document", "x", "", "1", None), ("ontology_summary", "s", "Cluster -1 Summary", "summary_-1", -1)]


def test_relevance_is_rounded_as_the_double_is(spark):
    scores = [k / 2000 for k in range(-2001, 2002)] + [1234.5675, 0.0, -0.0, -0.0001, 1e-9]
    rows = spark.createDataFrame([(k, 1, "document", "t", "c", s) for k, s in enumerate(scores)], "query_id int, rank int, doc_type string, title string, content string, similarity_score double")
    got = {r["query_id"]: r["context"] for r in retrieval.prompt_context(rows).collect()}
    assert got == {k: f"[DOCUMENT] t\nc\n(Relevance: {s:.3f})" for k, s in enumerate(scores)}


def test_prompt_context_query_holds_whole_texts(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    hits = catalog._typed_hits(spark, sf).collect()
    got = {r["query_id"]: r["context"] for r in catalog.QUERIES["prompt_context"](spark, sf).collect()}
    want = {}
    for h in sorted(hits, key=lambda h: h["rank"]):
        if h["doc_id"] in docs:
            want.setdefault(h["query_id"], []).append(f"[{h['doc_type'].upper()}] Document {h['doc_id']}\n{docs[h['doc_id']]}\n(Relevance: {round(h['similarity_score'], 6):.3f})")
    assert any(len(docs[h["doc_id"]]) > 200 for h in hits if h["doc_id"] in docs)
    assert got == {q: "\n\n".join(parts) for q, parts in want.items()}


def test_null_vectors(spark):
    """Null vectors are no neighbours, have no cluster, and crash nothing, also where a batch holds no other."""
    rows = spark.createDataFrame([(0, None), (1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, None), (4, [0.0, 1.0])], "vec_id long, embedding array<double>").repartition(5)
    got = {(r["query_id"], r["doc_id"]) for r in similarity.top_k(rows, rows, 2).collect()}
    assert got == {(1, 1), (1, 2), (2, 2), (2, 1), (4, 4), (4, 2)}
    assert {r["vec_id"] for r in clustering.kmeans(rows, 2).collect()} == {1, 2, 4}


def test_kmeans_separates(spark):
    """Three far groups: labels are the groups, and the inertia is that of their means."""
    r = np.random.default_rng(0)
    x = np.concatenate([r.normal(c, 0.1, (40, 2)) for c in ((0, 0), (8, 0), (0, 8))])
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    label = np.array([c["cluster_id"] for c in sorted(clustering.kmeans(df, 3).collect(), key=lambda c: c["vec_id"])])
    assert [len(set(label[a : a + 40])) for a in (0, 40, 80)] == [1, 1, 1] and len(set(label)) == 3
    joined = df.join(clustering.kmeans(df, 3), "vec_id")
    far = clustering.center_distance(joined, clustering.centers(joined, "cluster_id"), "cluster_id")
    want = sum(((x[a : a + 40] - x[a : a + 40].mean(axis=0)) ** 2).sum() for a in (0, 40, 80))
    assert abs(sum(d["distance"] ** 2 for d in far.collect()) - want) < 1e-6 * want


def test_exact_presence(spark):
    """Against plain `in`: items inside longer words at their ends, short items, repeats, nulls, empties; and in several blocks."""
    texts = ["xone two threey", "one two three", "two", "one  two", None, "", "a one two three four", "onetwo three", "one two three"]
    items = [(1, "one two three"), (2, "two"), (3, "ne two thr"), (4, "one  two"), (5, None), (6, ""), (7, "zero"), (1, "a one")]
    want = sorted((k, sum(bool(x) and x in (t or "") for t in texts)) for k, x in items)
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    bench = spark.createDataFrame(items, "item_id long, item string")
    for limit in (100, 3):
        assert sorted(map(tuple, presence.exact_presence(docs, bench, limit).collect())) == want
    assert presence.exact_presence(docs, bench.limit(0)).collect() == [] and {r["n_docs"] for r in presence.exact_presence(docs.limit(0), bench).collect()} == {0}
    plan = presence.exact_presence(docs, bench.where("item_id in (1, 3)").where("item != 'a one'"))._jdf.queryExecution().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_search_holds_few_scores_at_once():
    """512 queries met all rows of a batch or block at once: their scores, rounded and sorted, were 330 MB a worker."""
    import tracemalloc

    rng = np.random.default_rng(1)
    rows, others, keys = rng.normal(size=(600, 4)), rng.normal(size=(16384, 4)), rng.permutation(16384)
    others[100:200] = others[:100]
    tracemalloc.start()
    got = [b.to_pandas() for b in similarity._best(np.arange(600), rows, keys, others, 15)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20
    score = rows @ others.T
    found = {q: list(zip(g["doc_id"], g["similarity_score"].round(9))) for b in got for q, g in b.groupby("query_id")}
    assert len(found) == 600
    for q in range(0, 600, 37):
        best = sorted(zip(-score[q].round(9), keys))[:15]
        assert found[q] == [(key, -s) for s, key in best]


@pytest.mark.parametrize("distinct", [False, True])
def test_common_with_next(spark, distinct):
    rows = [(k, " ".join(f"w{(k * j * j) % 17}" for j in range(k % 23))) for k in range(-200, 300) if k % 11] + [(5, "w1 w1 x"), (64, "x  w1"), (64, None), (None, "x"), (None, "x"), (1000, "a"), (1002, "a"), (2000, ""), (2001, "b")]
    held = {}
    for k, text in rows:
        held.setdefault(k, Counter()).update(w for w in (text or "").split(" ") if w)
    want = {k: len(w.keys() & held[k + 1].keys()) if distinct else (w & held[k + 1]).total() for k, w in held.items() if k is not None and k + 1 in held}
    made = overlap.common_with_next(spark.createDataFrame(rows, "doc_id int, words string").repartition(3), "doc_id", "words", distinct)
    assert [c for c, _ in made.dtypes] == ["doc_id", "common"]
    got = [tuple(r) for r in made.collect()]
    assert len(got) == len(dict(got)) and dict(got) == {k: n for k, n in want.items() if n}
    assert overlap.common_with_next(spark.createDataFrame([], "doc_id long, words string"), "doc_id", "words", distinct).count() == 0


@pytest.mark.parametrize("name", ["token_intersect_all", "keyword_intersect"])
def test_words_are_not_shuffled_one_by_one(spark, name):
    """Each word of each text was a row that two shuffles carried, with its document's id."""
    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 0 and plan.count("Join") == 0 and plan.count("RepartitionByExpression") == 1


def test_object_inside_prose(spark):
    made = '{"ontologies": [{"name": "A", "description": "b", "relationships": [{"relation": "A -> is -> B", "type": "TYPE"}]}]}'
    rows = spark.createDataFrame([(1, f"Of course: {made} Anything else?"), (2, f"```json\n{made}\n```"), (3, made), (4, "no object")], "cluster_id long, response string")
    got = {r["cluster_id"]: r["error"] for r in rows.select("cluster_id", concepts.response_error(F.col("response")).alias("error")).collect()}
    assert got == {1: None, 2: None, 3: None, 4: "not a JSON object"}


def test_pairs_of_blocks_hold_one_unit(spark):
    """Several units share a task, and a batch may hold parts of several."""
    import pyarrow as pa

    made = pa.RecordBatch.from_pydict({"left": [0, 0, 0, 1], "right": [0, 1, 1, 1], "id": [1, 2, 3, 4]})
    units = [(at, t["id"].to_pylist()) for at, t in similarity._units(iter([made, made.slice(3), made.slice(0, 0)]))]
    assert units == [((0, 0), [1]), ((0, 1), [2, 3]), ((1, 1), [4, 4])]


def test_running_ids(spark):
    rows = spark.range(1000, numPartitions=7).select((F.col("id") * 7919 % 1000).alias("k"))
    assert all(r["k"] == r["idx"] for r in chunking.running_ids(rows, ["k"]).collect())
    assert chunking.running_ids(rows.limit(0), ["k"]).count() == 0


def test_algorithms(spark):
    df, _ = vectors(spark)
    assert clustering.kmeans(df, 3, algorithm="bisecting").select("cluster_id").distinct().count() == 3
    with pytest.raises(ValueError):
        clustering.kmeans(df, 3, algorithm="other")


def test_written_relations(spark):
    rows = spark.createDataFrame([(["{'relation': 'A -> is -> B', 'type': 'TYPE'}", '{"relation": "C -> has -> D", "type": "OTHER"}', "x", None],), ([],), (None,)], "r array<string>")
    got = [r["s"] for r in rows.select(rdf.written_relations(F.col("r")).alias("s")).collect()]
    assert [x and tuple(x) for x in got[0]] == [("A -> is -> B", "TYPE"), ("C -> has -> D", "OTHER"), (None, None), None]
    assert got[1:] == [[], None]
