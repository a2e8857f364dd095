"""The registered queries of the engine's own operators, and DuckDB SQL for each.

Every query runs over its whole tables. Search queries are the rows whose id is divisible by 100.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T, vectors as V
from ..operators import chunking, clustering, concepts, evaluation, overlap, presence, rdf, retention, retrieval, similarity
from ..session import cut, spread

THRESHOLD = 0.3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _parts(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spread(table(spark, sf_dir, "part").select("p_partkey", *columns), "p_partkey")


def _rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*(F.round(c, places).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return similarity.top_k(vectors.where("vec_id % 100 = 0"), vectors, 15)


def _typed_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.when(F.col("label") % 2 == 0, retrieval.SUMMARY).otherwise(retrieval.DOCUMENT).alias("doc_type"))
    return _hits(spark, sf_dir).join(kinds, "doc_id")


def knn_topk(spark, sf_dir):
    return _rounded(_hits(spark, sf_dir).select("query_id", "doc_id", "similarity_score", "rank"))


def retrieval_summary(spark, sf_dir):
    return _rounded(retrieval.query_summary(_typed_hits(spark, sf_dir)))


def retrieval_stats(spark, sf_dir):
    return _rounded(retrieval.run_summary(_typed_hits(spark, sf_dir)))


def prompt_context(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"), F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("title"))
    rows = _typed_hits(spark, sf_dir).withColumn("similarity_score", F.round("similarity_score", 6)).join(docs, "doc_id")
    return retrieval.prompt_context(rows)


def sim_self_join(spark, sf_dir):
    return similarity.link_counts(table(spark, sf_dir, "embeddings"), THRESHOLD)


def leader_dedup(spark, sf_dir):
    return similarity.leaders(table(spark, sf_dir, "embeddings"), THRESHOLD)


def name_dedup(spark, sf_dir):
    rows = concepts.groups_by_name(table(spark, sf_dir, "documents"), "text", "doc_id")
    return rows.select(F.md5("key").alias("name_key"), F.col("first").alias("first_id"), "members")


def nearest_centroid(spark, sf_dir):
    points = table(spark, sf_dir, "embeddings")
    return _rounded(clustering.assign(points, clustering.centers(points, "label")))


def cluster_stats(spark, sf_dir):
    return _rounded(clustering.size_stats(table(spark, sf_dir, "embeddings"), "label"))


def cluster_hist_zero_fill(spark, sf_dir):
    points = table(spark, sf_dir, "embeddings")
    return clustering.histogram(points, "label", max(16, 1 + (points.agg(F.max("label")).first()[0] or 0)))


def rebalance_labels(spark, sf_dir):
    points = table(spark, sf_dir, "embeddings")
    n, k = points.count(), 10
    return clustering.rebalance(points, "label", max(1, n // k), max(1, n // k) + 1)


def kmeans(spark, sf_dir):
    return clustering.kmeans(table(spark, sf_dir, "embeddings"), 10)


def cluster_report(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return clustering.report(docs, "source", "text", "doc_id").withColumn("context_preview", F.md5("context_preview"))


def normalize_answer(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.normalize_answer(F.col("text"))).alias("normalized_md5"))


def normalize_loose(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.normalize_loose(F.col("text"))).alias("normalized_md5"))


def token_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.token_count(F.col("text")).alias("n_tokens"))


def sentence_chunks(spark, sf_dir):
    rows = chunking.corpus_rows(table(spark, sf_dir, "documents"), "doc_id", "text")
    return rows.select(F.col("key").alias("doc_id"), "part", "parts", "title", F.md5("context").alias("context_md5"), "is_supporting")


def _answers(spark, sf_dir) -> DataFrame:
    """An assistant's turn as prediction, its next one as gold."""
    said = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    later = said.select("conv_id", (F.col("turn") - 2).alias("turn"), F.col("text").alias("answer"))
    return said.select("conv_id", "turn", F.col("text").alias("output")).join(later, ["conv_id", "turn"])


def qa_accuracy(spark, sf_dir):
    return evaluation.short_scores(_answers(spark, sf_dir)).select("conv_id", "turn", "accuracy")


def qa_f1(spark, sf_dir):
    return _rounded(evaluation.short_scores(_answers(spark, sf_dir)).select("conv_id", "turn", "f1", "precision", "recall"))


def qa_em(spark, sf_dir):
    return evaluation.short_scores(_answers(spark, sf_dir)).select("conv_id", "turn", "em")


def qa_metric_means(spark, sf_dir):
    return _rounded(evaluation.means(evaluation.short_scores(_answers(spark, sf_dir))))


def qa_fallback(spark, sf_dir):
    return _rounded(evaluation.fallback_means(_answers(spark, sf_dir)))


def bleu(spark, sf_dir):
    return _rounded(evaluation.bleu_scores(_answers(spark, sf_dir)).select("conv_id", "turn", "bleu_1", "bleu_4", "bleu", "bleu_smoothed"))


def multi_answer_best(spark, sf_dir):
    rows = _parts(spark, sf_dir, "p_name", "p_type").select("p_partkey", F.concat_ws(" ", F.substring_index("p_name", " ", 1), F.lower("p_type")).alias("output"), F.replace("p_name", F.lit(" "), F.lit("|")).alias("answer"))
    return _rounded(evaluation.best_scores(rows).select("p_partkey", "accuracy", "f1", "em"))


def exact_presence(spark, sf_dir):
    """Items found word for word."""
    return presence.exact_presence(table(spark, sf_dir, "documents").select("text"), table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("item")))


def index_union(spark, sf_dir):
    docs = retrieval.document_rows(table(spark, sf_dir, "documents"), "doc_id", "source", "text")
    groups = table(spark, sf_dir, "embeddings").groupBy(F.col("label").alias("cluster_id")).agg(F.concat(F.lit("rows: "), F.count("*").cast("string")).alias("ontology_summary"))
    rows = retrieval.index_rows(docs, retrieval.summary_rows(groups))
    return rows.select("doc_type", F.md5("content").alias("content_md5"), "title", "doc_id", "cluster_id")


def token_intersect_all(spark, sf_dir):
    """Tokens that a document shares with the one of the next id, as multisets."""
    docs = table(spark, sf_dir, "documents").select("doc_id", T.normalize_answer(F.col("text")).alias("words"))
    return overlap.common_with_next(docs, "doc_id", "words")


def keyword_intersect(spark, sf_dir):
    """Words of three letters or more that a document shares with the one of the next id, as sets."""
    words = F.array_distinct(F.regexp_extract_all(T.normalize_answer(F.col("text")), F.lit("[\\p{L}\\p{N}_]{3,}"), 0))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.array_join(words, " ").alias("words"))
    return overlap.common_with_next(docs, "doc_id", "words", distinct=True)


def _responses(spark, sf_dir) -> DataFrame:
    """A model's answers made from nations and parts: valid ones, vague ones, and some that aren't JSON."""
    nations = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    verb = F.when(F.col("n_nationkey") % 5 == 0, "is related to").otherwise("located in")
    body = F.concat(F.lit('{"ontologies":[{"name":"'), "n_name", F.lit('","description":"A nation","relationships":[{"relation":"'), "n_name", F.lit(" -> "), verb, F.lit(" -> "), "r_name", F.lit('","type":"other"}]}]}'))
    first = nations.select(F.col("n_nationkey").cast("long").alias("cluster_id"), F.when(F.col("n_nationkey") % 7 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body).alias("response"))
    parts = _parts(spark, sf_dir, "p_name", "p_type")
    name = F.when(F.col("p_partkey") % 11 == 0, "").otherwise(F.col("p_name"))
    text = F.concat(F.lit('{"ontologies":[{"name":"'), name, F.lit('","description":"A part","relationships":[{"relation":"'), "p_name", F.lit(" -> is type of -> "), "p_type", F.lit('","type":"TYPE"}]}]}'))
    second = parts.select((F.col("p_partkey") + 1000).alias("cluster_id"), F.when(F.col("p_partkey") % 13 == 0, "sorry").otherwise(text).alias("response"))
    return first.unionByName(second)


def ontology_validate(spark, sf_dir):
    return _responses(spark, sf_dir).select("cluster_id", concepts.response_error(F.col("response")).alias("error"))


def ontology_concepts(spark, sf_dir):
    rows = concepts.parse_responses(_responses(spark, sf_dir))
    return rows.select("source_cluster", "name", "description", F.get("relationships", F.lit(0))["relation"].alias("relation"), F.get("relationships", F.lit(0))["type"].alias("type"))


def _merged(spark, sf_dir) -> DataFrame:
    rows = concepts.parse_responses(_responses(spark, sf_dir)).withColumn("ord", F.col("source_cluster")).withColumn("key", concepts.name_key(F.col("name")))
    return concepts.merge_groups(rows, "key")


def ontology_merge(spark, sf_dir):
    return _merged(spark, sf_dir).select("key", "name", F.md5("description").alias("description_md5"), F.size("relationships").alias("n_relationships"), F.size("source_clusters").alias("n_clusters"), "merged_from_count")


def ontology_stats(spark, sf_dir):
    return _rounded(concepts.stats(_merged(spark, sf_dir)))


def _concepts(spark, sf_dir) -> DataFrame:
    rows = concepts.parse_responses(_responses(spark, sf_dir))
    return rows.select(F.col("name").alias("ontology_name"), "description", F.lit(1).alias("document_count"), F.col("source_cluster").cast("int").alias("cluster_id"), F.col("source_cluster").alias("ord"), "relationships")


def owl_triples(spark, sf_dir):
    return rdf.triples(_concepts(spark, sf_dir)).groupBy("subject", "predicate", "object", "rel_type").agg(F.count("*").alias("n"))


def owl_properties(spark, sf_dir):
    rows = rdf.properties(rdf.triples(_concepts(spark, sf_dir)))
    return rows.select("predicate", F.array_join("domains", ",").alias("domains"), F.array_join("ranges", ",").alias("ranges"))


def owl_classes(spark, sf_dir):
    return rdf.defined_classes(_concepts(spark, sf_dir))


def owl_inferred(spark, sf_dir):
    rows = cut(_concepts(spark, sf_dir), "concepts")
    return rdf.inferred_classes(rdf.triples(rows), rdf.defined_classes(rows)).select("name", "cluster_id", "document_count")


def turtle_lines(spark, sf_dir):
    rows = cut(_concepts(spark, sf_dir), "concepts")
    edges = cut(rdf.triples(rows).distinct(), "edges")
    return rdf.turtle(rdf.classes(rows, edges), rdf.properties(edges), edges).select("section", "line")


def running_ids(spark, sf_dir):
    """Chunks of all documents, numbered through."""
    rows = chunking.corpus_rows(table(spark, sf_dir, "documents"), "doc_id", "text").select(F.col("key").alias("doc_id"), "part")
    return chunking.running_ids(rows, ["doc_id", "part"])


def retrieval_details(spark, sf_dir):
    """What was retrieved for each query, with the start of its content."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"), F.col("source").alias("title"))
    rows = retrieval.retrieval_details(_typed_hits(spark, sf_dir).join(docs, "doc_id"))
    one = rows.select("query_id", F.explode("retrieved_documents_analysis").alias("d")).select("query_id", "d.*")
    return _rounded(one.select("query_id", "rank", "doc_id", "similarity_score", "is_ontology_text", "title", F.md5("content_preview").alias("preview_md5")))


def written_relations(spark, sf_dir):
    """Relations written out as text, as older files hold them; some can't be read."""
    text = F.concat(F.lit("{'relation': '"), "p_name", F.lit(" -> is type of -> "), "p_type", F.lit("', 'type': 'TYPE'}"))
    rows = _parts(spark, sf_dir, "p_name", "p_type").select("p_partkey", F.array(F.when(F.col("p_partkey") % 4 == 0, "no relation").otherwise(text)).alias("r"))
    read = F.get(rdf.written_relations(F.col("r")), F.lit(0))
    return rows.select("p_partkey", read["relation"].alias("relation"), read["type"].alias("type"))


def vector_length(spark, sf_dir):
    """First entry and length of the normalised vectors."""
    unit = V.unit(F.col("embedding"))
    return _rounded(table(spark, sf_dir, "embeddings").select("vec_id", F.get(unit, F.lit(0)).cast("double").alias("first"), F.sqrt(F.aggregate(unit, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))).alias("length")))


def center_similarity(spark, sf_dir):
    """Cosine of each vector to its label's centre."""
    points = table(spark, sf_dir, "embeddings")
    return _rounded(clustering.center_similarity(points, clustering.centers(points, "label"), "label"))


def corpus_signature(spark, sf_dir):
    """One signature over all clusters of content_signature, in their order."""
    return concepts.whole_signature(content_signature(spark, sf_dir))


def required_keys(spark, sf_dir):
    """Responses that have all required keys, for two lists of them."""
    made = _responses(spark, sf_dir).select("cluster_id", F.col("response").alias("r"))
    return made.select("cluster_id", T.has_keys(F.col("r"), ["ontologies"]).alias("plain"), T.has_keys(F.col("r"), ["ontologies", "metadata"]).alias("full"))


def merge_answers(spark, sf_dir):
    """A model's merged definitions, made from parts: fenced, bare, and some that aren't JSON, which leave the rows as they were."""
    body = F.concat(F.lit('{"description":"One '), "p_type", F.lit('","relationships":[{"relation":"'), "p_name", F.lit(' -> is type of -> '), "p_type", F.lit('","type":"TYPE"}]}'))
    answer = F.when(F.col("p_partkey") % 5 == 0, "sorry").when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    rows = _parts(spark, sf_dir, "p_name", "p_type").select("p_partkey", F.col("p_name").alias("description"), F.array().cast(concepts.RELATIONS).alias("relationships"), answer.alias("output"))
    return concepts.merged_answers(rows).select("p_partkey", "description", F.get("relationships", F.lit(0))["relation"].alias("relation"))


def strip_punctuation(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.strip_punctuation(T.first_words(F.col("text")))).alias("md5"))


def string_em(spark, sf_dir):
    """Short answers (the words of a part's name) that stand in its name and type, given in two sets."""
    rows = _parts(spark, sf_dir, "p_name", "p_type").select("p_partkey", F.concat_ws(" ", F.substring_index("p_name", " ", 1), "p_type").alias("prediction"), F.transform(F.split("p_name", " "), lambda w: F.struct(F.array(w).alias("short_answers"))).alias("qa_pairs"))
    return _rounded(evaluation.presence_scores(rows).select("p_partkey", "str_em", F.col("str_hit").cast("int").alias("str_hit")))


def option_match(spark, sf_dir):
    """Close-set answers: the first figure of a part's brand against the second."""
    rows = _parts(spark, sf_dir, "p_brand").select("p_partkey", F.element_at(F.regexp_extract_all("p_brand", F.lit("[0-9]"), 0), 1).alias("extract_output"), F.element_at(F.regexp_extract_all("p_brand", F.lit("[0-9]"), 0), -1).alias("answer_idx"))
    return evaluation.option_scores(rows).select("p_partkey", "em")


def virtual_ids(spark, sf_dir):
    """Merged concepts as index summaries, numbered -1, -2, ..."""
    merged = _merged(spark, sf_dir).withColumn("ord", F.col("key"))
    return concepts.summaries(merged).select("cluster_id", "ontology_name", F.md5("ontology_summary").alias("summary_md5"))


def xml_escape(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.xml_escape(F.col("html"))).alias("escaped_md5"))


def content_signature(spark, sf_dir):
    """Clusters of twenty neighbouring ids: their size is bounded, as the clustering's is."""
    docs = table(spark, sf_dir, "documents").withColumn("cluster", F.floor(F.col("doc_id") / 20))
    return concepts.signature(docs, "cluster", F.col("source"), F.col("text"))


def keep_newest(spark, sf_dir):
    return retention.beyond_newest(table(spark, sf_dir, "events"), "event_type", "ts", "event_id").select("event_id", "event_type")


def age_filter(spark, sf_dir):
    return retention.older_than(table(spark, sf_dir, "events"), "ts", 7, F.to_timestamp(F.lit("2024-01-20 00:00:00"))).select("event_id")


def metric_stats(spark, sf_dir):
    return _rounded(retention.call_stats(table(spark, sf_dir, "events"), "value", F.col("event_type") != "error"))


def dataset_name(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.dataset_of_index(F.col("url")).alias("by_index"), T.dataset_of_report(F.col("url")).alias("by_report"))


def class_names(spark, sf_dir):
    return _parts(spark, sf_dir, "p_name", "p_brand", "p_type").select("p_partkey", T.class_id(F.concat_ws(" - ", "p_name", "p_brand")).alias("class_id"), T.property_id(F.concat_ws(" ", "p_name", "p_type")).alias("property_id"))


def source_concepts(spark, sf_dir):
    """Documents of every cluster up to the largest number, those without any too; -1 has the sources without a number."""
    number = F.expr("try_cast(regexp_extract(source, '([0-9]+)$', 1) as bigint)")
    docs = table(spark, sf_dir, "documents").select(F.coalesce(number, F.lit(-1)).alias("cluster_id"))
    most = F.greatest(F.coalesce(F.max("cluster_id"), F.lit(-1)), F.lit(-1))
    clusters = docs.agg(F.explode(F.sequence(F.lit(-1).cast("long"), most)).alias("cluster_id"))
    return concepts.per_cluster(clusters, docs)


QUERIES = {f.__name__: f for f in (
    knn_topk, retrieval_summary, retrieval_stats, prompt_context, sim_self_join, leader_dedup, name_dedup, nearest_centroid, cluster_stats, cluster_hist_zero_fill, rebalance_labels, kmeans, cluster_report,
    normalize_answer, normalize_loose, token_count, sentence_chunks, qa_accuracy, qa_f1, qa_em, qa_metric_means, qa_fallback, bleu, multi_answer_best, exact_presence, index_union, token_intersect_all, keyword_intersect,
    ontology_validate, ontology_concepts, ontology_merge, ontology_stats, owl_triples, owl_properties, owl_classes, owl_inferred, turtle_lines, running_ids, retrieval_details, written_relations, vector_length, center_similarity, corpus_signature, required_keys, merge_answers, strip_punctuation, string_em, option_match, virtual_ids, xml_escape, content_signature, keep_newest, age_filter, metric_stats, dataset_name, class_names, source_concepts,
)}

from .oracles import ORACLE_SQL  # noqa: E402, F401
