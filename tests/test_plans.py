"""Sources, sinks, providers, pipelines, streams and the driver entry."""

import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from corpusmill.operators import evaluation
from corpusmill.plans import catalog, cli, pipelines, providers
from corpusmill.sources import readers, writers
from corpusmill.streaming import ingest

SF = "/root/testdata/sf0.001"
ROWS = [{"id": "1", "title": "A", "context": "red fox. jumps"}, {"id": "2", "context": "blue whale swims"}]


def put(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


@pytest.mark.parametrize("text", [json.dumps(ROWS), json.dumps(ROWS, indent=1), json.dumps({"x": ROWS[0], "y": ROWS[1]}), json.dumps({"x": ROWS[0], "y": ROWS[1]}, indent=2), "\n".join(map(json.dumps, ROWS)), "\n\n" + "\n".join(map(json.dumps, ROWS)) + "\n"])
def test_json_forms(spark, tmp_path, text):
    got = sorted(tuple(r) for r in readers.corpus(spark, put(tmp_path, "c.json", text)).collect())
    assert got == [("1", "A", "red fox. jumps"), ("2", "", "blue whale swims")]


def test_json_edges(spark, tmp_path):
    assert [tuple(r) for r in readers.corpus(spark, put(tmp_path, "one.json", json.dumps(ROWS[0]))).collect()] == [("1", "A", "red fox. jumps")]
    assert readers.corpus(spark, put(tmp_path, "empty.json", " \n")).count() == 0
    for name, text in (("a.json", "[]"), ("b.json", "42")):
        with pytest.raises(ValueError):
            readers.corpus(spark, put(tmp_path, name, text)).count()
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        readers.corpus(spark, str(tmp_path / "missing.json")).count()
    with pytest.raises(Exception):
        readers.corpus(spark, put(tmp_path, "bad.json", json.dumps(ROWS[0]) + "\nnot json\n" + json.dumps(ROWS[1]))).collect()
    rows = readers.questions(spark, put(tmp_path, "q.json", '[{"id":"1","question":"q","answers":["a","b"]},{"id":"2","question":"r","answer":"c"}]')).orderBy("id").collect()
    assert [r["answer"] for r in rows] == ["a|b", "c"]
    kept = readers.long_context(spark, put(tmp_path, "l.json", '{"input":"q","answers":["a"],"context":"c"}\nbroken\n{"input":" ","context":"c"}\n'))
    assert kept.count() == 1


def test_writers(spark, tmp_path):
    rel = "array<struct<relation:string,type:string>>"
    rows = spark.createDataFrame([("Cat", "a cat", 1, 3, 1, [("Cat -> eats -> Fish", "OTHER")])], f"ontology_name string, description string, document_count int, cluster_id int, ord int, relationships {rel}")
    made = writers.write_rdf(rows, str(tmp_path / "rdf"))
    assert len(made) == 2 and "mill:Cat mill:eats mill:Fish ." in spark.read.text(made[0]).agg(F.array_join(F.collect_list("value"), "\n")).first()[0]
    with pytest.raises(ValueError):
        writers.write_rdf(rows, str(tmp_path / "rdf"), formats="pdf")
    writers.write_concepts(rows, str(tmp_path / "o"), {"corpus_file": "x"})
    assert "Cat" in spark.read.text(str(tmp_path / "o/text")).first()[0]
    writers.save_index(rows, str(tmp_path / "i"))
    assert writers.load_index(spark, str(tmp_path / "i")).count() == 1 and writers.load_index(spark, str(tmp_path / "none")) is None
    writers.point_latest(spark, str(tmp_path), "run_1")
    assert spark.read.json(str(tmp_path / "latest")).first()["path"] == "run_1"
    assert writers.index_path("d", "nq", "ab") == "d/nq_documents_only_ab" and writers.index_path("d", "nq", "ab", 3) == "d/nq_clusters_3_ab"


def test_clean_up(spark, tmp_path):
    for d in range(1, 8):
        (tmp_path / f"run_2024010{d}_000000").mkdir()
    (tmp_path / "notes.txt").write_text("x")
    listed = readers.artifacts(spark, str(tmp_path))
    assert writers.clean_up(listed, 5).count() == 2 and len(list(tmp_path.iterdir())) == 8
    gone = writers.clean_up(listed, 5, dry_run=False)
    assert len(list(tmp_path.iterdir())) == 6 and gone is not None
    assert writers.clean_up(readers.artifacts(spark, str(tmp_path)), days=1).count() == 5


def test_generators(spark):
    rows = readers.prompts(spark, 5, ["a", "b"]).orderBy("index").collect()
    assert [r["prompt"] for r in rows] == ["a (#1)", "b (#2)", "a (#3)", "b (#4)", "a (#5)"]
    assert readers.sample_clusters(spark, 3, 2).groupBy("cluster_id").count().count() == 3


def test_providers(spark):
    rows = spark.createDataFrame([(1, "red fox"), (2, "red fox"), (3, "")], "id long, t string")
    got = {r["id"]: r["embedding"] for r in providers.embed(rows, "t", providers.HashEmbedder(8), batch=2).collect()}
    assert got[1] == got[2] and got[3] == [0.0] * 8
    with pytest.raises(ValueError):
        providers.checked([[1.0], [1.0, 2.0]], 2)

    def model(p):
        if "bad" in p:
            raise RuntimeError("no")
        return p.upper()

    out = providers.generate(spark.createDataFrame([(1, "x"), (2, "bad"), (3, "y")], "id long, p string"), "p", model, base=0).orderBy("id").collect()
    assert [(r["output"], r["status"]) for r in out] == [("X", "success"), ("Error: no", "error"), ("Y", "success")]
    tries = []
    assert providers.with_retries(lambda: tries.append(1) or len(tries), 5, lambda n: n == 3, 0)() == 3
    assert providers.delay(50, jitter=lambda: 0) == 66.0


def concept_model(prompt):
    if prompt.startswith("Name the concepts"):
        word = "Whale" if "whale" in prompt else "Fox"
        return json.dumps({"ontologies": [{"name": word, "description": f"a {word}", "relationships": [{"relation": f"{word} -> is kind of -> Animal", "type": "TYPE"}]}]})
    return "blue whale" if "whale" in prompt.lower() else "red fox"


def test_pipelines(spark):
    corpus = spark.createDataFrame([(str(i), f"T{i}", ("blue whale swims deep" if i % 2 else "red fox runs fast") + f" {i}") for i in range(12)], "id string, title string, context string")
    questions = spark.createDataFrame([("q1", "what swims deep like a whale", "blue whale"), ("q2", "what runs fast like a fox", "red fox|fox")], "id string, question string, answer string")
    s = pipelines.Settings(clusters=2, max_cluster_size=8, model=concept_model, top_k=3)
    for mode in ("rag", "ablation", "zeroshot"):
        scored, means = pipelines.evaluate(corpus, questions, s, mode)
        assert scored.count() == 2 and means.first()["accuracy"] == 100.0, mode
    with pytest.raises(ValueError):
        pipelines.evaluate(corpus, questions, s, "other")
    records = spark.createDataFrame([("q", ["a", "b"], "one two. " * 100)], "input string, answers array<string>, context string")
    chunks, asked = pipelines.ingest(records)
    assert chunks.count() == 1 and asked.first()["answer"] == "a|b"
    stats = pipelines.load_test(readers.prompts(spark, 6, ["x"]), s, 4).first()
    assert stats["total"] == 6 and stats["success_rate"] == 100.0


def test_suites(spark):
    """Every suite runs over answers that have only the questions' columns, also when their names clash with scores."""
    asked = spark.createDataFrame([("q1", "what swims like a whale", "blue whale", 0.5), ("q2", "what runs like a fox", "red fox|fox", 0.5)], "id string, question string, answer string, accuracy double")
    s = pipelines.Settings(clusters=2, max_cluster_size=8, model=concept_model, top_k=3)
    for suite, names in evaluation.SCORES.items():
        scored, means = pipelines.evaluate(None, asked, s, "zeroshot", suite)
        assert scored.count() == 2 and {"n", *names} <= set(means.columns) and means.first()["n"] == 2, suite
    assert pipelines.evaluate(None, asked, s, "zeroshot", "long_asqa")[1].first()["str_em"] == 100.0
    assert pipelines.evaluate(None, asked, s, "zeroshot", "close_set")[1].first()["em"] == 50.0


def merging_model(prompt):
    if "describe one concept" in prompt:
        return 'Here it is: ```json\n{"description": "merged", "relationships": [{"relation": "Whale -> is kind of -> Animal", "type": "TYPE"}]}\n```'
    return concept_model(prompt)


def test_ontology_is_merged_written_and_read(spark, tmp_path):
    """The model merges concepts of one name; the written file is read back, and becomes Turtle."""
    corpus = spark.createDataFrame([(str(i), f"T{i}", ("blue whale swims deep" if i % 2 else "red fox runs fast") + f" {i}") for i in range(12)], "id string, title string, context string")
    s = pipelines.Settings(clusters=4, max_cluster_size=4, model=merging_model, top_k=3)
    made = pipelines.ontology(pipelines.cluster(corpus, s), s)
    rows = made.collect()
    assert rows and any("merged" in r["ontology_summary"] for r in rows)
    path = str(tmp_path / "o")
    writers.write_concepts(made.withColumnRenamed("ontology_summary", "description"), path, {"corpus_file": "x"})
    back = readers.concept_file(spark, path)
    assert sorted(r["ontology_name"] for r in back.collect()) == sorted(r["ontology_name"] for r in rows)
    writers.write_rdf(back.withColumn("ord", F.xxhash64("ontology_name", "cluster_id")), str(tmp_path / "rdf"), formats="turtle")
    lines = "\n".join(r["value"] for r in spark.read.text(str(tmp_path / "rdf/turtle")).collect())
    assert "rdfs:subClassOf" in lines and all(f'"{r["ontology_name"]}"' in lines for r in rows)


@pytest.mark.parametrize("name", ["ontology_validate", "ontology_concepts", "required_keys", "multi_answer_best", "merge_answers", "string_em", "class_names"])
def test_parts_are_dealt_over_all_cores(spark, name):
    """A small file of one row group is one task, which did all the work of the rows made from it."""
    rows = catalog.QUERIES[name](spark, SF).select(F.spark_partition_id().alias("p")).distinct()
    assert rows.count() >= spark.sparkContext.defaultParallelism


def test_scope_drops_tables(spark):
    """Queries that write tables leave none behind once their scope ends."""
    import glob

    from corpusmill.session import scope, shared_dir

    held = lambda: set(glob.glob(shared_dir(spark).removeprefix("file:").replace("//", "/", 1) + "/corpusmill-*"))
    before = held()
    for name in ("leader_dedup", "turtle_lines"):
        with scope(spark):
            assert catalog.QUERIES[name](spark, SF).count() and held() - before, name
        assert held() == before, name


def test_empty_corpus(spark):
    empty = spark.createDataFrame([], "id string, title string, context string")
    assert pipelines.cluster(empty, pipelines.Settings()).collect() == []


def test_embedding_survives_bad_texts(spark):
    def fussy(texts):
        if "bad" in texts:
            raise OSError("refused")
        return [[float(len(t))] for t in texts]

    rows = spark.createDataFrame([(k, "bad" if k == 5 else "x" * k) for k in range(9)], "id long, t string").coalesce(1)
    got = {r["id"]: r["embedding"] for r in providers.embed(rows, "t", fussy, attempts=2, base=0).collect()}
    assert got == {k: None if k == 5 else [float(k)] for k in range(9)}


def test_cli(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cli, "local_session", lambda: spark)
    path = put(tmp_path, "l.json", '{"input":"q","answers":["a"],"context":"some text here"}')
    assert cli.main(["ingest", path, str(tmp_path / "out")]) == 0 and spark.read.json(str(tmp_path / "out/corpus.json")).count() == 1
    with pytest.raises(SystemExit):
        cli.main(["qa", "--questions", "x", "--output", "y"])


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    put(tmp_path / "in", "a.json", '{"input":"q","answers":["a"],"context":"' + "word two. " * 200 + '"}')
    ingest.write_stream(ingest.chunk_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() >= 1
    calls = spark.createDataFrame([("2024-01-01 00:00:10", 1.0, "success"), ("2024-01-01 00:00:50", 3.0, "error"), ("2024-01-01 00:01:10", 5.0, "success")], "ts string, duration double, status string").withColumn("ts", F.to_timestamp("ts"))
    got = sorted((r["total"], r["succeeded"], r["avg_duration"]) for r in ingest.call_windows(calls).collect())
    assert got == [(1, 1, 5.0), (2, 1, 1.0)]


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES) and set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["rebalance_labels", "kmeans"])
def test_queries_without_sql(spark, name):
    rows = catalog.QUERIES[name](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/embeddings.parquet").count()


def test_queries_with_sql(spark):
    """A few of the queries on the smallest tables; the driver compares all."""
    import os

    import duckdb

    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"create view {t[:-8]} as select * from '{SF}/{t}'")
    for name in ("cluster_stats", "token_count", "owl_classes", "keep_newest", "qa_em"):
        want = con.execute(catalog.ORACLE_SQL[name])
        columns = [c[0] for c in want.description]
        got = catalog.QUERIES[name](spark, SF).select(*columns).collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall())), name


@pytest.fixture
def server():
    """A local HTTP server whose answers a test sets: (status, body) by path, and the requests it got."""
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            self.server.got.append((self.path, body, self.headers["Authorization"]))
            answers = self.server.answers
            status, text = answers.pop(0) if len(answers) > 1 else answers[0]
            self.send_response(status)
            self.end_headers()
            self.wfile.write(text.encode())

        def log_message(self, *_):
            pass

    made = HTTPServer(("127.0.0.1", 0), Handler)
    made.got, made.url = [], f"http://127.0.0.1:{made.server_port}"
    threading.Thread(target=made.serve_forever, daemon=True).start()
    yield made
    made.shutdown()


def test_http_model(server):
    good = json.dumps({"choices": [{"message": {"content": "a fox"}}]})
    server.answers = [(500, "x"), (429, "x"), (400, "x"), (200, good)]
    ask = providers.with_retries(providers.HttpModel(server.url, "k", "m", temperature=0.0), 5, base=0)
    assert ask("who?") == "a fox" and len(server.got) == 4
    path, body, key = server.got[-1]
    assert path == "/chat/completions" and body == {"model": "m", "messages": [{"role": "user", "content": "who?"}], "temperature": 0.0} and key == "Bearer k"
    for status, text, tries in ((404, "x", 1), (200, "no json", 1), (200, "{}", 1), (200, json.dumps({"choices": [{"message": {"content": None}}]}), 1), (503, "x", 5), (401, "x", 5)):
        server.got.clear()
        server.answers = [(status, text)]
        with pytest.raises(providers.CallError):
            ask("who?")
        assert len(server.got) == tries, (status, text)
    with pytest.raises(providers.CallError, match="no connection"):
        providers.HttpModel("http://127.0.0.1:9", timeout=1)("x")


def test_http_embedder(server):
    embedder = providers.HttpEmbedder(f"{server.url}/embed")
    server.answers = [(200, json.dumps({"data": [{"embedding": [1, 2]}, {"embedding": [3, 4]}]}))]
    assert embedder(["a", "b"]) == [[1.0, 2.0], [3.0, 4.0]] and server.got[0][1]["input"] == ["a", "b"]
    with pytest.raises(ValueError):
        embedder(["a"])
    for status, text, said in ((429, "", "rate limit"), (401, "", "authentication"), (413, "", "too large"), (500, "", "server error"), (200, '{"data": [{}]}', "no vectors"), (200, '{"data": [{"embedding": ["x"]}]}', "no vectors")):
        server.answers = [(status, text)]
        with pytest.raises(providers.CallError, match=said):
            embedder(["a"])


def test_pace():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    pace = providers.Pace(32, rate=4, adaptive=True, clock=lambda: now[0], sleep=sleep)
    for _ in range(10):
        assert pace.size() == 32 and pace.run(lambda: 7) == 7
    assert slept[1:] == [0.25] * 9 and pace.size() == 64
    for _ in range(5):
        with pytest.raises(ValueError):
            pace.run(lambda: int("x"))
    assert pace.size() == 16
    assert providers.Pace(32).size() == 32 and providers.width(providers.HashEmbedder(8)) == 8


def test_embedding_stats(spark):
    def embedder(texts):
        if "bad" in texts:
            raise RuntimeError("no")
        return [[1.0]] * len(texts)

    rows = spark.createDataFrame([(1, "a"), (2, "bad"), (3, None), (4, "b")], "id long, t string").coalesce(1)
    calls = providers.embed(rows, "t", embedder, attempts=1, base=0, timed=True)
    from corpusmill.operators.retention import call_stats

    one = call_stats(calls, "duration", F.col("status") == "success").first()
    assert (one["total"], one["succeeded"], one["success_rate"]) == (4, 3, 75.0)


def test_stages_and_index_are_read_again(spark, tmp_path):
    asked = []
    corpus = spark.createDataFrame([(str(i), f"T{i}", f"red fox runs fast {i}") for i in range(6)], "id string, title string, context string").withColumn("cluster_id", F.lit(0))

    def model(prompt):
        (tmp_path / f"asked{len(list(tmp_path.glob('asked*')))}").write_text(prompt)
        return concept_model(prompt)

    s = pipelines.Settings(model=model, cache=str(tmp_path / "cache"))
    first = sorted(map(str, pipelines.ontology(corpus, s).collect()))
    asked = len(list(tmp_path.glob("asked*")))
    assert asked and sorted(map(str, pipelines.ontology(corpus, s).collect())) == first and len(list(tmp_path.glob("asked*"))) == asked
    index = pipelines.saved_index(corpus, s)
    assert index.count() == 6 and pipelines.corpus_signature(corpus.orderBy(F.col("id").desc())) == pipelines.corpus_signature(corpus)
    changed = corpus.withColumn("context", F.lit("other"))
    assert pipelines.corpus_signature(changed) != pipelines.corpus_signature(corpus) and pipelines.saved_index(changed, s).first()["content"] == "other"
    assert pipelines.corpus_signature(corpus.limit(0)) and pipelines.saved_index(corpus, s).inputFiles()[0].count("cache") == 1
    (tmp_path / "cache" / "broken").mkdir()
    assert writers.cached(spark, str(tmp_path / "cache" / "broken"), lambda: corpus).count() == 6


def test_details(spark, tmp_path):
    rows = spark.createDataFrame([("1", "A", "x" * 250, 0), ("2", "B", None, 0), ("3", "C", "yy", 2)], "id string, title string, context string, cluster_id int")
    writers.write_cluster_details(rows, str(tmp_path / "c"))
    docs = {r["doc_id"]: r for r in spark.read.json(str(tmp_path / "c/documents")).collect()}
    assert docs["1"]["content_preview"] == "x" * 200 + "..." and docs["1"]["full_content_length"] == 250 and docs["2"]["full_content_length"] == 0 and docs["3"]["original_document"]["title"] == "C"
    assert spark.read.json(str(tmp_path / "c/summary")).first().asDict() == {"total_documents": 3, "num_clusters": 2, "total_length": 252}
    writers.write_cluster_details(rows.limit(0), str(tmp_path / "none"))
    assert spark.read.json(str(tmp_path / "none/summary")).first()["num_clusters"] == 0

    raw = spark.createDataFrame([(0,), (0,), (0,)], "source_cluster int")
    merged = spark.createDataFrame([("Fox", "d", [("A -> is -> B", "TYPE")], [0], 3)], "name string, description string, relationships array<struct<relation:string,type:string>>, source_clusters array<int>, merged_from_count int")
    writers.write_processing_details(rows, raw, merged, str(tmp_path / "p"), 0.85)
    one = spark.read.json(str(tmp_path / "p/summary")).first()
    assert (one["original_clusters"], one["raw_ontologies_extracted"], one["merged_ontologies"], one["duplicates_removed"]) == (2, 3, 1, 2) and one["deduplication_ratio"] == pytest.approx(2 / 3)
    assert {r["cluster_id"]: r["n"] for r in spark.read.json(str(tmp_path / "p/clusters")).collect()} == {0: 3, 2: 0}
    writers.write_processing_details(rows.limit(0), raw.limit(0), merged.limit(0), str(tmp_path / "p0"), 0.85)
    assert spark.read.json(str(tmp_path / "p0/summary")).first()["original_clusters"] == 0

    hits = spark.createDataFrame([(1, 2, 0.5, "original_document", "z" * 150, "d2", None, "T2"), (1, 1, 0.75, "ontology_summary", "s", "summary_0", 0, "T1")], "query_id long, rank int, similarity_score double, doc_type string, content string, doc_id string, cluster_id int, title string")
    answered = spark.createDataFrame([(1, "q", "a"), (2, "r", "b")], "query_id long, question string, output string")
    writers.write_retrieval_details(answered, hits, str(tmp_path / "r"))
    found = {r["query_id"]: r["retrieved_documents_analysis"] for r in spark.read.json(str(tmp_path / "r/questions")).collect()}
    assert [(d["rank"], d["is_ontology_text"], d["content_preview"]) for d in found[1]] == [(1, True, "s"), (2, False, "z" * 100 + "...")] and found[2] is None
    assert spark.read.json(str(tmp_path / "r/summary")).first().asDict() == {"total_questions": 2, "total_retrievals": 1, "avg_docs_per_query": 2.0}

    calls = spark.createDataFrame([(i, "Error: no" if i % 2 else "ok", "error" if i % 2 else "success", 1.0) for i in range(20)], "index long, output string, status string, duration double")
    assert writers.write_calls(calls, calls.agg(F.count("*").alias("n")), str(tmp_path / "l")) == [f"{i}: Error: no" for i in (1, 3, 5, 7, 9)]
    assert spark.read.json(str(tmp_path / "l/errors")).count() == 10

    from datetime import datetime

    means = spark.createDataFrame([(2, 50.0, 25.0)], "n long, accuracy double, f1 double")
    results, text = writers.write_report(rows, means, str(tmp_path / "e"), "nq", "rag", {"Top-K": 15}, datetime(2024, 1, 31, 23, 59, 59))
    assert results.endswith("evaluation_results_nq_rag_20240131_235959") and text.endswith("evaluation_summary_nq_rag_20240131_235959")
    lines = [r["value"] for r in spark.read.text(text).collect()]
    assert "Total Questions: 2" in lines and "Accuracy: 50.00%" in lines and "F1 Score: 25.00%" in lines and lines[-1] == "Top-K: 15"
    listed = readers.artifacts(spark, str(tmp_path / "e"))
    assert listed.where("time is not null").count() == 2 and writers.totals(listed).first()["bytes"] > 0


def test_evaluation_rows(spark, tmp_path):
    path = put(tmp_path, "e.jsonl", '{"question": "q", "output": "o", "num_retrieved": 2, "retrieved_documents": [{"doc_id": "1"}]}\n{"question": "r"}\n')
    rows = readers.evaluation_rows(spark, path).orderBy("question").collect()
    assert rows[0]["num_retrieved"] == 2 and json.loads(rows[0]["retrieved_documents"]) == [{"doc_id": "1"}] and rows[1]["retrieved_documents"] is None
