"""Sinks: JSON and Parquet tables, text files whose lines have an order, pointers to the latest run, deletions."""

from __future__ import annotations

import logging
from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..operators import concepts, rdf, retention, retrieval
from ..session import cut

log = logging.getLogger(__name__)


def write_lines(rows: DataFrame, path: str, order: list[str], line: str = "line") -> None:
    """One text file in the given order. Range partitions are written in order, so rows needn't fit into one task."""
    rows.orderBy(*order).select(F.col(line).alias("value")).write.mode("overwrite").text(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_concepts(concepts: DataFrame, path: str, metadata: dict[str, str]) -> None:
    """A folder with the concepts as JSON lines, their metadata, and a text for people."""
    spark = concepts.sparkSession
    write_json(concepts, f"{path}/ontologies")
    write_json(spark.createDataFrame([(k, str(v)) for k, v in metadata.items()], "key string, value string"), f"{path}/metadata")
    relations = F.array_join(F.transform("relationships", lambda r: F.concat(F.lit("  - "), r["relation"])), "\n")
    text = F.concat_ws("\n", "ontology_name", "description", relations, F.lit(""))
    write_lines(concepts.select(F.col("ontology_name").alias("key"), text.alias("line")), f"{path}/text", ["key"])


def write_rdf(concepts: DataFrame, path: str, uri: str = rdf.NAMESPACE, formats: str = "all") -> list[str]:
    """Turtle, RDF/XML or both; what was written."""
    edges = rdf.triples(concepts).distinct()
    nodes, links = rdf.classes(concepts, edges), rdf.properties(edges)
    makers = {"turtle": rdf.turtle, "xml": rdf.rdf_xml}
    chosen = [f for f in makers if formats in (f, "all")]
    if not chosen:
        raise ValueError(f"unknown format {formats}")
    for f in chosen:
        write_lines(makers[f](nodes, links, edges, uri), f"{path}/{f}", ["section", "key"])
    return [f"{path}/{f}" for f in chosen]


def write_corpus(chunks: DataFrame, questions: DataFrame, path: str) -> None:
    write_json(chunks, f"{path}/corpus.json")
    write_json(questions, f"{path}/questions.json")


def write_cluster_details(rows: DataFrame, path: str, cluster: str = "cluster_id", key: str = "id", title: str = "title", text: str = "context") -> None:
    """Three JSON tables: documents (start and length of each text, and the row itself), clusters (their sizes and lengths), summary."""
    length = F.length(T.blank(F.col(text))).cast("long").alias("full_content_length")
    documents = rows.select(F.col(cluster).alias("cluster_id"), F.col(key).alias("doc_id"), F.col(title).alias("title"), T.preview(F.col(text)).alias("content_preview"), length, F.struct("*").alias("original_document"))
    clusters = documents.groupBy("cluster_id").agg(F.count("*").alias("document_count"), F.sum("full_content_length").alias("total_length"))
    write_json(documents, f"{path}/documents")
    write_json(clusters, f"{path}/clusters")
    write_json(clusters.agg(F.coalesce(F.sum("document_count"), F.lit(0)).alias("total_documents"), F.count("*").alias("num_clusters"), F.coalesce(F.sum("total_length"), F.lit(0)).alias("total_length")), f"{path}/summary")


def write_processing_details(clusters: DataFrame, raw: DataFrame, merged: DataFrame, path: str, threshold: float) -> None:
    """Three JSON tables: summary (counts before and after merging), clusters (concepts of each, those without any too), concepts.
    clusters: cluster_id of every document; raw: source_cluster; merged: as merge_groups() makes them."""
    ids = clusters.select("cluster_id").distinct()
    kinds = {"original_clusters": ids, "raw_ontologies_extracted": raw, "merged_ontologies": merged}
    every = reduce(DataFrame.unionByName, (t.select(F.lit(c).alias("kind")) for c, t in kinds.items()))
    counted = every.agg(*(F.count_if(F.col("kind") == c).alias(c) for c in kinds))
    before, after = F.col("raw_ontologies_extracted"), F.col("merged_ontologies")
    write_json(counted.select("*", (1 - after / F.greatest(before, F.lit(1))).alias("deduplication_ratio"), (before - after).alias("duplicates_removed"), F.lit(threshold).alias("similarity_threshold")), f"{path}/summary")
    write_json(concepts.per_cluster(ids, raw.select(F.col("source_cluster").alias("cluster_id"))), f"{path}/clusters")
    write_json(merged.select("name", T.preview(F.col("description")).alias("description"), F.size("relationships").alias("relationship_count"), "source_clusters", "merged_from_count"), f"{path}/concepts")


def write_retrieval_details(answered: DataFrame, results: DataFrame, path: str) -> None:
    """Two JSON tables: questions (query_id, question, output, and what was retrieved for each, in rank order) and their summary."""
    found = retrieval.retrieval_details(results)
    rows = answered.select("query_id", "question", F.col("output").alias("answer")).join(found, "query_id", "left")
    write_json(rows, f"{path}/questions")
    n = F.coalesce(F.size("retrieved_documents_analysis"), F.lit(0))
    write_json(rows.agg(F.count("*").alias("total_questions"), F.count("retrieved_documents_analysis").alias("total_retrievals"), F.coalesce(F.try_divide(F.sum(n), F.count("retrieved_documents_analysis")), F.lit(0.0)).alias("avg_docs_per_query")), f"{path}/summary")


def write_calls(calls: DataFrame, stats: DataFrame, path: str, first: int = 5) -> list[str]:
    """Statistics of a load test and its failed calls as JSON; the first few failures, as lines for people."""
    failed = calls.where("status <> 'success'").select("index", F.col("output").alias("error"), "duration")
    write_json(stats, f"{path}/stats")
    write_json(failed, f"{path}/errors")
    return [f"{r['index']}: {r['error']}" for r in failed.orderBy("index").limit(first).collect()]


#: How reports name the modes, and the scores that they list.
MODES = {"zeroshot": "Zero-shot", "rag": "Documents and concepts", "ablation": "Documents only"}
LISTED = {"accuracy": "Accuracy", "f1": "F1 Score", "precision": "Precision", "recall": "Recall", "em": "Exact Match"}


def write_report(scored: DataFrame, summary: DataFrame, folder: str, dataset: str, mode: str, config: dict[str, str] | None = None, now: datetime | None = None) -> tuple[str, str]:
    """Scored rows and means as JSON, and a summary text; their names hold the data set, the mode and the time."""
    stamp = (now or datetime.now()).strftime("%Y%m%d_%H%M%S")
    results, text = (f"{folder}/evaluation_{kind}_{dataset}_{mode}_{stamp}" for kind in ("results", "summary"))
    write_scores(scored, summary, results)
    one = summary.first().asDict()  # a row of means
    scores = [f"{label}: {one[c]:.2f}%" for c, label in LISTED.items() if c in one] + [f"{c}: {v:.2f}%" for c, v in one.items() if c not in (*LISTED, "n", "correct_answers")]
    lines = [f"{MODES.get(mode, mode)}: evaluation summary", "", f"Timestamp: {stamp}", f"Mode: {mode.upper()}", "", "Results:", f"Total Questions: {one['n']}", *scores, "", "Configuration:", *(f"{k}: {v}" for k, v in (config or {}).items())]
    write_lines(summary.sparkSession.createDataFrame(list(enumerate(lines)), "at long, line string").coalesce(1), text, ["at"])
    return results, text


def write_scores(scored: DataFrame, summary: DataFrame, path: str) -> None:
    write_json(scored, f"{path}/rows")
    write_json(summary, f"{path}/summary")


def point_latest(spark: SparkSession, folder: str, run: str) -> None:
    """A row that names the latest run."""
    spark.createDataFrame([(run,)], "path string").coalesce(1).write.mode("overwrite").json(f"{folder}/latest")


def save_index(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)


def load_index(spark: SparkSession, path: str) -> DataFrame | None:
    """The saved index; null where there is none."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
    return spark.read.parquet(path) if there else None


def cached(spark: SparkSession, path: str | None, make: Callable[[], DataFrame]) -> DataFrame:
    """The table of a stage that is saved at path; without one that can be read, make()'s, which is saved there. A save that
    fails is logged only. Without a path, nothing is saved. Stages name their content in the path."""
    if path is None:
        return make()
    try:
        found = load_index(spark, path)
        if found is not None:
            return found
    except Exception as x:  # noqa: BLE001
        log.warning("%s can't be read, and is made again: %s", path, x)
    made = cut(make(), "stage")
    try:
        save_index(made, path)
    except Exception as x:  # noqa: BLE001
        log.warning("%s can't be saved: %s", path, x)
    return made


def index_path(folder: str, dataset: str, signature: str, clusters: int | None = None) -> str:
    """A place that changes with the data set, the clusters and the content."""
    kind = "documents_only" if clusters is None else f"clusters_{clusters}"
    return f"{folder}/{dataset}_{kind}_{signature}"


def clean_up(listed: DataFrame, keep: int = 5, days: int | None = None, dry_run: bool = True) -> DataFrame:
    """The artifacts beyond the newest `keep` (or older than `days`, if given); they are deleted unless dry_run. Listings
    are as long as a folder, and names only reach the driver."""
    timed = listed.where(F.col("time").isNotNull()).withColumn("kind", F.regexp_replace("name", "[0-9]{8}_[0-9]{6}.*$", ""))
    gone = retention.older_than(timed, "time", days) if days else retention.beyond_newest(timed, "kind", "time", "name", keep)
    gone = gone.select("name", "path", "size", "time")
    if not dry_run:
        spark = listed.sparkSession
        for r in gone.toLocalIterator():
            where = spark._jvm.org.apache.hadoop.fs.Path(r["path"])
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return gone


def totals(gone: DataFrame) -> DataFrame:
    """How many artifacts clean_up() names, and their bytes."""
    return gone.agg(F.count("*").alias("artifacts"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
