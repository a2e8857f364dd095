"""Ingest, concept extraction and question answering, end to end, with any providers."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from ..functions import text as T
from ..operators import chunking, clustering, concepts, evaluation, retrieval, similarity
from ..session import cut
from ..sources import writers
from . import providers


@dataclass
class Settings:
    """What the pipelines can be told; names and defaults in one place."""

    clusters: int = 5
    max_cluster_size: int | None = 20
    min_cluster_size: int | None = None
    top_k: int = 15
    threshold: float = 0.85
    algorithm: str = "auto"
    #: Folder of stages and indexes that later runs over the same content read again; none without one.
    cache: str | None = None
    embedder: providers.Embedder = field(default_factory=providers.HashEmbedder)
    model: providers.Model = field(default_factory=providers.TemplateModel)


def ingest(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Corpus chunks and questions of long-context records (input, answers, context)."""
    keyed = cut(records.withColumn("key", F.md5(F.concat_ws("\u0001", "input", "context"))), "records")
    asked = keyed.select(F.col("key").alias("id"), F.col("input").alias("question"), F.array_join("answers", "|").alias("answer"), "answers", F.lit("bridge").alias("type"))
    rows = chunking.corpus_rows(keyed, "key", "context").withColumnRenamed("key", "corresponding_question_md5")
    return rows.withColumn("id", F.concat_ws("-", "corresponding_question_md5", "part")), asked


def cluster(corpus: DataFrame, settings: Settings) -> DataFrame:
    """Corpus rows with vector and cluster, balanced in size."""
    vectors = cut(providers.embed(corpus, "context", settings.embedder), "vectors")
    n = vectors.count()
    if not n:
        return vectors.withColumn("cluster_id", F.lit(0))
    k = min(n, clustering.cluster_count(n, settings.clusters, settings.max_cluster_size))
    labels = cut(clustering.kmeans(vectors, k, "id", algorithm=settings.algorithm), "labels")
    joined = cut(vectors.join(labels, "id"), "clusters")
    least = settings.min_cluster_size or max(1, n // k // 2)
    most = max(least, settings.max_cluster_size or n // k * 3 // 2)
    moved = clustering.rebalance(joined, "cluster_id", least, most, "id").select("id", "cluster_id")
    return joined.drop("cluster_id").join(moved, "id")


def extraction_prompt(rows: DataFrame) -> DataFrame:
    """cluster_id and prompt: the cluster's documents, numbered, and the form of the answer. Clusters have a largest size."""
    listed = F.array_sort(F.collect_list(F.struct("id", "title", "context")))
    each = F.transform("docs", lambda d, k: F.concat(F.lit("Document "), (k + 1).cast("string"), F.lit(": "), d["title"], F.lit("\n"), d["context"]))
    task = 'Name the concepts of these documents. Answer with JSON only: {"ontologies": [{"name": "", "description": "", "relationships": [{"relation": "S -> P -> O", "type": "TYPE or OTHER"}]}]}\n\n'
    return rows.groupBy("cluster_id").agg(listed.alias("docs")).select("cluster_id", F.concat(F.lit(task), F.array_join(each, "\n\n")).alias("prompt"))


def clusters_signature(clusters: DataFrame) -> str:
    """What the stages of these clusters are saved under: their content, cluster by cluster."""
    return concepts.whole_signature(concepts.signature(clusters, "cluster_id", F.col("title"), F.col("context"))).first()["signature"]


def corpus_signature(corpus: DataFrame) -> str:
    """The same for documents in any order: their number and a sum over their rows, so that no group is gathered."""
    r = corpus.select(F.xxhash64("id", "title", "context").alias("h")).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("h").cast("decimal(20,0)")), F.lit(0)).cast("string").alias("s")).first()
    return hashlib.md5(f"{r['n']}:{r['s']}".encode()).hexdigest()[:12]


def ontology(clusters: DataFrame, settings: Settings) -> DataFrame:
    """Summaries of the clusters' concepts, in two stages that settings.cache keeps: extracted; then merged."""
    place = (lambda stage: f"{settings.cache}/{stage}_{clusters_signature(clusters)}") if settings.cache else (lambda stage: None)
    spark = clusters.sparkSession
    rows = writers.cached(spark, place("stage1"), lambda: extracted(clusters, settings))
    return writers.cached(spark, place(f"stage2_{settings.threshold}"), lambda: merged_summaries(rows, settings))


def extracted(clusters: DataFrame, settings: Settings) -> DataFrame:
    """Concepts that the model names for each cluster, validated."""
    answers = cut(providers.generate(extraction_prompt(clusters), "prompt", settings.model), "answers")
    rows = concepts.parse_responses(answers, "output").withColumn("at", F.col("ord"))
    rows = rows.withColumn("ord", F.concat_ws("-", F.lpad(F.col("source_cluster").cast("string"), 12, "0"), F.lpad(F.col("at").cast("string"), 6, "0"))).withColumn("key", concepts.name_key(F.col("name")))
    return cut(rows, "concepts")


def merged_summaries(rows: DataFrame, settings: Settings) -> DataFrame:
    """Summaries of concepts: merged by name and by nearness of names."""
    names = rows.groupBy("key").agg(F.min("ord").alias("ord"), F.min_by("name", "ord").alias("name"))
    numbered = cut(names.withColumn("vec_id", F.xxhash64("ord")), "names")
    vectors = cut(providers.embed(numbered, "name", settings.embedder), "name_vectors")
    lead = similarity.leaders(vectors, settings.threshold)
    groups = numbered.join(lead, "vec_id").select("key", "leader")
    merged = cut(concepts.merge_groups(rows.join(groups, "key"), "leader"), "merged")
    single, several = concepts.singles_and_several(merged)
    answered = providers.generate(concepts.merge_prompt(several), "prompt", settings.model)
    merged = single.unionByName(concepts.merged_answers(answered).select(*single.columns))
    first = rows.join(groups, "key").groupBy("leader").agg(F.min("ord").alias("ord"))
    return concepts.summaries(merged.join(first, "leader"))


def saved_index(corpus: DataFrame, settings: Settings, summaries: DataFrame | None = None, dataset: str = "corpus") -> DataFrame:
    """The index that settings.cache holds for this content, else a new one, which is saved there."""
    if not settings.cache:
        return build_index(corpus, settings, summaries)
    content = corpus_signature(corpus)
    if summaries is not None:
        named = summaries.select(F.col("cluster_id").alias("id"), F.col("ontology_name").alias("title"), F.col("ontology_summary").alias("context"))
        content += corpus_signature(named)
    path = writers.index_path(settings.cache, dataset, content, None if summaries is None else settings.clusters)
    return writers.cached(corpus.sparkSession, path, lambda: build_index(corpus, settings, summaries))


def build_index(corpus: DataFrame, settings: Settings, summaries: DataFrame | None = None) -> DataFrame:
    """Index rows with vectors; with the summaries, if there are any."""
    rows = retrieval.document_rows(corpus)
    if summaries is not None:
        rows = retrieval.index_rows(rows, retrieval.summary_rows(summaries))
    return cut(providers.embed(rows.withColumn("vec_id", F.xxhash64("doc_type", "doc_id")), "content", settings.embedder), "index")


def answer(questions: DataFrame, settings: Settings, index: DataFrame | None = None) -> DataFrame:
    """Questions with output, status and retrieved rows; without an index, zero-shot."""
    if index is None:
        asked = questions.withColumn("prompt", retrieval.answer_prompt(F.col("question"), F.lit(None).cast("string")))
        return providers.generate(asked, "prompt", settings.model)
    keyed = questions.withColumn("query_id", F.xxhash64("id"))
    vectors = cut(providers.embed(keyed, "question", settings.embedder).withColumn("vec_id", F.col("query_id")), "questions")
    hits = similarity.top_k(vectors, index, settings.top_k).withColumnRenamed("doc_id", "vec_id")
    context = retrieval.prompt_context(hits.join(index.drop("embedding"), "vec_id"))
    asked = keyed.join(context, "query_id", "left").withColumn("prompt", retrieval.answer_prompt(F.col("question"), F.coalesce("context", F.lit(""))))
    return providers.generate(asked, "prompt", settings.model)


def evaluate(corpus: DataFrame, questions: DataFrame, settings: Settings, mode: str = "rag", suite: str = "short") -> tuple[DataFrame, DataFrame]:
    """Scored rows and their means; mode: rag (documents and concepts), ablation (documents), zeroshot."""
    if mode == "rag":
        grouped = cut(cluster(corpus, settings), "grouped")
        index = saved_index(corpus, settings, cut(ontology(grouped, settings), "summaries"))
    elif mode == "ablation":
        index = saved_index(corpus, settings)
    elif mode == "zeroshot":
        index = None
    else:
        raise ValueError(f"unknown mode {mode}")
    answered = cut(answer(questions, settings, index).withColumn("mode", F.lit(mode)), "answered")
    scored = cut(evaluation.SUITES[suite](prepared(answered, suite, settings)), "scored")
    return scored, evaluation.means(scored, evaluation.SCORES[suite])


def prepared(answered: DataFrame, suite: str, settings: Settings) -> DataFrame:
    """Answers with the columns that a suite asks for: the option that the model reads out of its answer, or lists of short answers."""
    if suite == "close_set" and "extract_output" not in answered.columns:
        task = "Which option does this answer choose? Reply with the option only, or with nothing if it chooses none.\n\nQuestion: "
        asked = answered.drop("status", "duration").withColumn("prompt", F.concat(F.lit(task), "question", F.lit("\n\nAnswer: "), F.col("output")))
        answered = providers.generate(asked, "prompt", settings.model, out="extract_output")
    if suite == "close_set" and "answer_idx" not in answered.columns:
        answered = answered.withColumn("answer_idx", F.col("answer"))
    if suite == "long_asqa" and "qa_pairs" not in answered.columns:
        answered = answered.withColumn("qa_pairs", F.array(F.struct(F.split("answer", "[|]").alias("short_answers"))))
    if suite == "long_asqa" and "prediction" not in answered.columns:
        answered = answered.withColumn("prediction", F.col("output"))
    return answered


def load_test(rows: DataFrame, settings: Settings, workers: int = 200) -> DataFrame:
    """Statistics of one call a prompt (column prompt)."""
    from ..operators.retention import call_stats

    calls = cut(providers.generate(rows, "prompt", settings.model, workers=workers, attempts=1), "calls")
    return call_stats(calls, "duration", F.col("status") == "success")


def preview(rows: DataFrame, n: int = 5) -> DataFrame:
    """The first few rows, as a check of what was read."""
    return rows.select(*(T.preview(F.col(c).cast("string"), 100).alias(c) for c in rows.columns)).limit(n)
