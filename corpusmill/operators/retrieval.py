"""Index rows, ranked results, prompts, and what a retrieval run looked like."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as T

#: The two kinds of index rows.
DOCUMENT, SUMMARY = "original_document", "ontology_summary"


def document_rows(corpus: DataFrame, key: str = "id", title: str = "title", content: str = "context") -> DataFrame:
    """Index rows of the corpus: doc_type, content, title, doc_id."""
    return corpus.select(F.lit(DOCUMENT).alias("doc_type"), T.blank(F.col(content)).alias("content"), T.blank(F.col(title).cast("string")).alias("title"), F.col(key).cast("string").alias("doc_id"))


def summary_rows(summaries: DataFrame, cluster: str = "cluster_id", content: str = "ontology_summary") -> DataFrame:
    """Index rows of cluster summaries, with their cluster."""
    name = F.col(cluster).cast("string")
    return summaries.select(F.lit(SUMMARY).alias("doc_type"), T.blank(F.col(content)).alias("content"), F.concat(F.lit("Cluster "), name, F.lit(" Summary")).alias("title"), F.concat(F.lit("summary_"), name).alias("doc_id"), F.col(cluster).cast("long").alias("cluster_id"))


def index_rows(corpus: DataFrame, summaries: DataFrame) -> DataFrame:
    """Both kinds in one table; documents have no cluster."""
    return corpus.unionByName(summaries, allowMissingColumns=True)


def query_summary(results: DataFrame) -> DataFrame:
    """For each query: how many rows, of which kind, and the range of their similarity."""
    return results.groupBy("query_id").agg(
        F.count("*").alias("total_retrieved"),
        F.count_if(F.col("doc_type") == SUMMARY).alias("ontology_count"),
        F.count_if(F.col("doc_type") != SUMMARY).alias("original_count"),
        F.avg("similarity_score").alias("avg_similarity"),
        F.min("similarity_score").alias("min_similarity"),
        F.max("similarity_score").alias("max_similarity"),
    )


def run_summary(results: DataFrame) -> DataFrame:
    """Of all queries: counts, rows a query, and summaries for each document (infinite without documents)."""
    totals = results.groupBy("query_id").agg(F.count("*").alias("n"), F.count_if(F.col("doc_type") == SUMMARY).alias("s")).agg(F.count("*").alias("total_queries"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_retrieved"), F.coalesce(F.sum("s"), F.lit(0)).alias("total_ontology"))
    original = F.col("total_retrieved") - F.col("total_ontology")
    return totals.select(
        "total_queries",
        "total_retrieved",
        F.coalesce(F.try_divide(F.col("total_retrieved"), F.col("total_queries")), F.lit(0.0)).alias("avg_per_query"),
        "total_ontology",
        original.alias("total_original"),
        F.when(original == 0, F.lit(float("inf"))).otherwise(F.col("total_ontology") / original).alias("ontology_ratio"),
    )


def prompt_context(results: DataFrame) -> DataFrame:
    """For each query, its rows in rank order as one text: kind and title, content, relevance."""
    # format_string() rounds the shortest decimal form, half up; format_number() rounds the double itself, as C and Python do,
    # but takes 0.0005 for a tie, which as a double is over it.
    value = F.col("similarity_score").cast("double")
    value = F.when(F.abs(value).between(0.0005, 0.001), F.signum(value) * 0.001).otherwise(value)
    score = F.coalesce(F.replace(F.format_number(value, 3), F.lit(","), F.lit("")), F.lit("null"))
    block = F.concat(F.lit("["), F.upper("doc_type"), F.lit("] "), "title", F.lit("\n"), "content", F.lit("\n(Relevance: "), score, F.lit(")"))
    ordered = F.array_sort(F.collect_list(F.struct("rank", block.alias("block"))))
    return results.groupBy("query_id").agg(F.array_join(F.transform(ordered, lambda x: x["block"]), "\n\n").alias("context"))


def answer_prompt(question, context):
    """The prompt of a question with its context; without context (null), the question alone."""
    head = F.when(context.isNull(), F.lit("Answer the question briefly.\n\n")).otherwise(F.concat(F.lit("Answer the question from these passages.\n\n"), context, F.lit("\n\n")))
    return F.concat(head, F.lit("Question: "), question, F.lit("\nAnswer:"))


def retrieval_details(results: DataFrame) -> DataFrame:
    """query_id and an array of its rows in rank order: score, kind, the first 100 characters, and where it comes from."""
    cluster = F.col("cluster_id").cast("long") if "cluster_id" in results.columns else F.lit(None).cast("long")
    title = F.col("title") if "title" in results.columns else F.lit("")
    one = F.struct("rank", "similarity_score", (F.col("doc_type") == SUMMARY).alias("is_ontology_text"), "doc_type", T.preview(F.col("content"), 100).alias("content_preview"), cluster.alias("source_cluster_id"), "doc_id", title.alias("title"))
    return results.groupBy("query_id").agg(F.array_sort(F.collect_list(one)).alias("retrieved_documents_analysis"))


def retrieval_log(results: DataFrame) -> DataFrame:
    """One row a result: rank, score, kind, and the start of its content."""
    return results.select("query_id", "rank", "similarity_score", (F.col("doc_type") == SUMMARY).alias("is_ontology_text"), "doc_type", T.preview(F.col("content"), 200).alias("content_preview"), "doc_id")
