"""Extracted concepts: validation, grouping by name, merging, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T

RELATIONS = "array<struct<relation:string,type:string>>"
RESPONSE = f"struct<ontologies:array<struct<name:string,description:string,relationships:{RELATIONS}>>>"
#: The types of a relation.
TYPES = ["TYPE", "OTHER"]


def parts(relation: Column) -> Column:
    """Subject, predicate and object of `S -> P -> O`, as they stand."""
    return F.split(T.strip(relation), "\\s*->\\s*")


def relation_valid(relation: Column) -> Column:
    """Three non-empty parts, all different, and a predicate that says something."""

    def valid(p: Column) -> Column:
        first, said, last = (F.coalesce(F.get(p, F.lit(k)), F.lit("")) for k in range(3))
        vague = T.let(F.lower(said), lambda x: F.exists(F.lit(T.VAGUE), lambda v: x.contains(v)))
        return (F.size(p) == 3) & (first != "") & (said != "") & (last != "") & (first != said) & (said != last) & (first != last) & ~vague

    return T.let(F.transform(parts(T.blank(relation)), T.strip), valid)


def relations_valid(relationships: Column) -> Column:
    """A list whose entries all have a known type and a valid relation."""
    known = lambda r: F.upper(T.strip(T.blank(r["type"]))).isin(TYPES)
    return F.coalesce(F.forall(relationships, lambda r: known(r) & relation_valid(r["relation"])), F.lit(False))


def _error(is_object: Column, concepts: Column) -> Column:
    named = F.forall(concepts, lambda c: (T.strip(T.blank(c["name"])) != "") & (T.strip(T.blank(c["description"])) != ""))
    return (
        F.when(~is_object, "not a JSON object")
        .when(concepts.isNull() | (F.size(concepts) == 0), "no ontologies")
        .when(~named, "a name or description is missing")
        .when(~F.forall(concepts, lambda c: relations_valid(c["relationships"])), "a relationship is malformed")
    )


def checked(response: Column) -> Column:
    """struct(error, concepts) of a response: why it is rejected as a whole, null if it is valid, and what it holds. The text is read once."""
    read = lambda found: T.let(F.from_json(found["text"], RESPONSE)["ontologies"], lambda c: F.struct(_error(found["object"], c).alias("error"), c.alias("concepts")))
    return T.let(T.found_json(response), read)


def response_error(response: Column) -> Column:
    """Why a response is rejected as a whole; null if it is valid."""
    return checked(response)["error"]


def parse_responses(responses: DataFrame, response: str = "response", cluster: str = "cluster_id") -> DataFrame:
    """source_cluster, ord, name, description, relationships of every concept of the valid responses."""
    valid = T.let(checked(F.col(response)), lambda x: F.when(x["error"].isNull(), x["concepts"]))
    made = responses.select(F.col(cluster).alias("source_cluster"), F.posexplode(valid).alias("ord", "c"))
    tidy = F.transform("c.relationships", lambda r: F.struct(T.strip(r["relation"]).alias("relation"), F.upper(T.strip(r["type"])).alias("type")))
    return made.select("source_cluster", "ord", T.strip(F.col("c.name")).alias("name"), T.strip(F.col("c.description")).alias("description"), tidy.alias("relationships"))


def name_key(name: Column) -> Column:
    return F.lower(T.strip(T.blank(name)))


def groups_by_name(rows: DataFrame, name: str = "name", order: str = "ord") -> DataFrame:
    """key, first (order of the first row), representative (its name) and members, by name without case and outer blanks."""
    return rows.groupBy(name_key(F.col(name)).alias("key")).agg(F.min(order).alias("first"), F.min_by(F.col(name), F.col(order)).alias("representative"), F.count("*").alias("members"))


def merge_groups(rows: DataFrame, group: str, order: str = "ord") -> DataFrame:
    """For each group: descriptions and relations one after another, clusters without repeats, and how many were merged."""
    sorted_of = lambda c: F.transform(F.array_sort(F.collect_list(F.struct(order, c))), lambda x: x[c])
    merged = rows.groupBy(group).agg(
        F.min_by("name", order).alias("name"),
        F.array_join(F.filter(sorted_of("description"), lambda d: T.strip(T.blank(d)) != ""), "\n").alias("description"),
        F.flatten(sorted_of("relationships")).alias("relationships"),
        F.sort_array(F.collect_set(F.coalesce("source_cluster", F.lit(-1)))).alias("source_clusters"),
        F.count("*").cast("int").alias("merged_from_count"),
    )
    return merged


def singles_and_several(merged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups of one pass as they are; the others go to the language model."""
    return merged.where("merged_from_count = 1"), merged.where("merged_from_count > 1")


def merge_response(response: Column) -> Column:
    """description and relationships of a merge's answer; an empty description means: ask again."""
    parsed = F.from_json(T.fenced_json(response), f"struct<description:string,relationships:{RELATIONS}>")
    return F.struct(T.blank(parsed["description"]).alias("description"), F.coalesce(parsed["relationships"], F.array().cast(RELATIONS)).alias("relationships"))


def summaries(merged: DataFrame, order: str = "ord") -> DataFrame:
    """Concepts as index summaries: virtual ids -1, -2, ..., a text of name, description and relations. Concepts are as
    many as the language model made, so one window over all of them is bounded."""
    relations = F.transform("relationships", lambda r: F.concat(F.lit("- "), r["relation"]))
    text = F.concat("name", F.lit("："), "description", F.when(F.size("relationships") > 0, F.concat(F.lit("\n关系：\n"), F.array_join(relations, "\n"))).otherwise(""))
    number = -F.row_number().over(Window.orderBy(order))
    return merged.select(number.cast("int").alias("cluster_id"), F.lit(0).alias("document_count"), text.alias("ontology_summary"), F.array("name").alias("key_concepts"), "relationships", "source_clusters", F.col("name").alias("ontology_name"))


def stats(merged: DataFrame) -> DataFrame:
    """Concepts, relations, and relations a concept."""
    n = F.size("relationships")
    return merged.agg(F.count("*").alias("total_ontologies"), F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("total_relationships"), F.coalesce(F.avg(n), F.lit(0.0)).alias("avg_relationships"))


def cluster_distribution(merged: DataFrame) -> DataFrame:
    """Concepts for each source cluster."""
    return merged.select(F.explode(F.array_distinct("source_clusters")).alias("cluster_id")).groupBy("cluster_id").agg(F.count("*").alias("n"))


def per_cluster(clusters: DataFrame, concepts: DataFrame) -> DataFrame:
    """Concepts of every cluster, those without any too."""
    return clusters.join(concepts.select("cluster_id", F.lit(1).alias("one")), "cluster_id", "left").groupBy("cluster_id").agg(F.count("one").alias("n"))


def dedup_ratio(raw: int, merged: int) -> float:
    return 1 - merged / max(raw, 1)


def signature(rows: DataFrame, cluster: str, title: Column, content: Column) -> DataFrame:
    """For each cluster, md5 of its sorted texts (title and content), joined by bars, as a key for caches. Clusters have a
    largest size, which bounds a group."""
    text = F.concat(T.blank(title), T.blank(content))
    listed = rows.groupBy(F.col(cluster).alias("cluster_id")).agg(F.sort_array(F.collect_list(text)).alias("texts"))
    body = F.concat(F.lit("cluster_"), F.col("cluster_id").cast("string"), F.lit(":"), F.array_join("texts", "|"))
    return listed.select("cluster_id", F.substring(F.md5(body), 1, 12).alias("signature"))


def whole_signature(signatures: DataFrame) -> DataFrame:
    """One md5 over the clusters' signatures, in the order of their ids, joined by two bars. Twelve characters a cluster meet in one row."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("cluster_id", "signature"))), lambda x: x["signature"])
    return signatures.agg(F.md5(F.array_join(listed, "||")).alias("signature"), F.count("*").alias("clusters"))


def merge_prompt(merged: DataFrame) -> DataFrame:
    """merged (name, description, relationships) with the prompt that asks for one definition."""
    relations = F.array_join(F.transform("relationships", lambda r: F.concat(F.lit("- "), r["relation"], F.lit(" ("), T.blank(r["type"]), F.lit(")"))), "\n")
    task = 'These notes describe one concept. Write one complete description, and list its relations once each, keeping TYPE and OTHER apart. Answer with JSON only: {"description": "", "relationships": [{"relation": "S -> P -> O", "type": "TYPE or OTHER"}]}\n\nConcept: '
    return merged.withColumn("prompt", F.concat(F.lit(task), "name", F.lit("\n\nDescriptions:\n"), "description", F.lit("\n\nRelations:\n"), relations))


def merged_answers(answered: DataFrame, answer: str = "output") -> DataFrame:
    """Several concepts' rows with the model's description and relations; without a usable answer, they stay as they were joined."""
    made = merge_response(F.col(answer))
    usable = T.strip(made["description"]) != ""
    return answered.withColumns({"relationships": F.when(usable & (F.size(made["relationships"]) > 0), made["relationships"]).otherwise(F.col("relationships")), "description": F.when(usable, made["description"]).otherwise(F.col("description"))})
