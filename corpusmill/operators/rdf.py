"""Concepts as classes, properties and triples, and as lines of Turtle and RDF/XML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T
from .concepts import parts

PREFIX, NAMESPACE = "mill", "http://example.org/concepts#"
#: What the properties of the classes are called, their labels and types, and the public vocabularies.
DATA_PROPERTIES = [("documentCount", "document count", "integer"), ("clusterId", "cluster id", "integer"), ("generatedFrom", "generated from", "string"), ("clusterCount", "cluster count", "integer"), ("ontologyCount", "ontology count", "integer")]
VOCABULARIES = [("rdf", "http://www.w3.org/1999/02/22-rdf-syntax-ns#"), ("rdfs", "http://www.w3.org/2000/01/rdf-schema#"), ("owl", "http://www.w3.org/2002/07/owl#"), ("xsd", "http://www.w3.org/2001/XMLSchema#")]


def namespace(uri: str) -> str:
    return uri if uri.endswith(("#", "/")) else uri + "#"


def triples(concepts: DataFrame, relationships: str = "relationships") -> DataFrame:
    """subject, predicate, object and rel_type of all relations with three parts; TYPE relations are subClassOf."""
    rows = concepts.select(F.explode(relationships).alias("r")).select(parts(F.col("r.relation")).alias("p"), F.upper(T.strip(T.blank(F.col("r.type")))).alias("rel_type"))
    rows = rows.where((F.size("p") == 3) & F.forall("p", lambda x: T.strip(x) != ""))
    predicate = F.when(F.col("rel_type") == "TYPE", "subClassOf").otherwise(T.property_id(F.get("p", F.lit(1))))
    return rows.select(T.class_id(F.get("p", F.lit(0))).alias("subject"), predicate.alias("predicate"), T.class_id(F.get("p", F.lit(2))).alias("object"), "rel_type")


def written_relations(relationships: Column) -> Column:
    """Relations that were written out as text, with single or double quotes, as structs; the fields of those that can't be read are null."""
    return F.transform(relationships, lambda r: F.from_json(r, "struct<relation:string,type:string>", {"allowSingleQuotes": "true"}))


def defined_classes(concepts: DataFrame) -> DataFrame:
    """name, description (the longest; of equals, the first), original_name, document_count, cluster_id by class id.
    concepts: ontology_name, description, document_count, cluster_id, ord."""
    rows = concepts.select(T.class_id(F.col("ontology_name")).alias("name"), T.clean_description(F.col("description")).alias("d"), "ontology_name", "document_count", "cluster_id", "ord")
    return rows.groupBy("name").agg(
        F.max_by("d", F.struct(F.length("d"), -F.col("ord"))).alias("description"),
        F.min_by("ontology_name", "ord").alias("original_name"),
        F.coalesce(F.sum("document_count"), F.lit(0)).cast("long").alias("document_count"),
        F.coalesce(F.min_by("cluster_id", "ord"), F.lit(-1)).cast("int").alias("cluster_id"),
    )


def inferred_classes(edges: DataFrame, defined: DataFrame) -> DataFrame:
    """Ends of relations that no concept defines."""
    ends = edges.select(F.explode(F.array("subject", "object")).alias("name")).distinct().join(defined, "name", "left_anti")
    return ends.select("name", F.concat("name", F.lit(" (inferred from a relation)")).alias("description"), F.col("name").alias("original_name"), F.lit(0).cast("long").alias("document_count"), F.lit(-999).alias("cluster_id"))


def classes(concepts: DataFrame, edges: DataFrame) -> DataFrame:
    """Defined classes first, then the inferred ones: the result doesn't depend on the order of the concepts."""
    own = defined_classes(concepts)
    return own.unionByName(inferred_classes(edges, own))


def properties(edges: DataFrame) -> DataFrame:
    """predicate with the classes it leads from and to; relations that aren't TYPE."""
    return edges.where("rel_type <> 'TYPE'").groupBy("predicate").agg(F.sort_array(F.collect_set("subject")).alias("domains"), F.sort_array(F.collect_set("object")).alias("ranges"))


def _term(c: Column) -> Column:
    return F.concat(F.lit(f"{PREFIX}:"), c)


def _side(name: str, side: Column, end: str) -> Column:
    union = F.concat(F.lit(f"    rdfs:{name} [ rdf:type owl:Class ; owl:unionOf ( "), F.array_join(F.transform(side, _term), " "), F.lit(f" ) ] {end}"))
    return F.when(F.size(side) == 1, F.concat(F.lit(f"    rdfs:{name} "), _term(F.get(side, F.lit(0))), F.lit(f" {end}"))).otherwise(union)


def turtle(nodes: DataFrame, links: DataFrame, edges: DataFrame, uri: str = NAMESPACE) -> DataFrame:
    """section, key and line of a Turtle file; sort by these and write `line`."""
    spark = nodes.sparkSession
    head = [f"@prefix {p}: <{u}> ." for p, u in [(PREFIX, namespace(uri)), *VOCABULARIES]] + ["", f"<{namespace(uri)[:-1]}> rdf:type owl:Ontology ."]
    data = [f"{PREFIX}:{n} rdf:type owl:DatatypeProperty ;\n    rdfs:label \"{label}\" ;\n    rdfs:range xsd:{kind} ." for n, label, kind in DATA_PROPERTIES]
    fixed = spark.createDataFrame([(0, f"{k:04d}", x) for k, x in enumerate(head)] + [(2, f"{k:04d}", x) for k, x in enumerate(data)], "section int, key string, line string")
    quoted = lambda c: F.concat(F.lit('"'), T.turtle_escape(F.col(c)), F.lit('"'))
    comment = F.when(F.col("description") != "", F.concat(F.lit("    rdfs:comment "), quoted("description"), F.lit(" ;\n"))).otherwise("")
    class_lines = F.concat(_term(F.col("name")), F.lit(" rdf:type owl:Class ;\n    rdfs:label "), quoted("original_name"), F.lit(" ;\n"), comment, F.lit(f"    {PREFIX}:documentCount "), F.col("document_count").cast("string"), F.lit(f" ;\n    {PREFIX}:clusterId "), F.col("cluster_id").cast("string"), F.lit(" ."))
    link_lines = F.concat(_term(F.col("predicate")), F.lit(' rdf:type owl:ObjectProperty ;\n    rdfs:label "'), "predicate", F.lit('" ;\n'), _side("domain", F.col("domains"), ";"), F.lit("\n"), _side("range", F.col("ranges"), "."))
    kind = F.when(F.col("rel_type") == "TYPE", F.lit("rdfs:subClassOf")).otherwise(_term(F.col("predicate")))
    edge = F.concat_ws(" ", _term(F.col("subject")), kind, _term(F.col("object")), F.lit("."))
    return (
        fixed.unionByName(nodes.select(F.lit(1).alias("section"), F.col("name").alias("key"), class_lines.alias("line")))
        .unionByName(links.select(F.lit(3).alias("section"), F.col("predicate").alias("key"), link_lines.alias("line")))
        .unionByName(edges.select(F.when(F.col("rel_type") == "TYPE", 4).otherwise(5).alias("section"), edge.alias("key"), edge.alias("line")))
    )


def rdf_xml(nodes: DataFrame, links: DataFrame, edges: DataFrame, uri: str = NAMESPACE) -> DataFrame:
    """section, key and line of an RDF/XML file with the same content."""
    spark, base = nodes.sparkSession, namespace(uri)
    spaces = " ".join(f'xmlns:{p}="{u}"' for p, u in VOCABULARIES)
    data = [f'  <owl:DatatypeProperty rdf:about="{base}{n}"><rdfs:label>{label}</rdfs:label><rdfs:range rdf:resource="{VOCABULARIES[3][1]}{kind}"/></owl:DatatypeProperty>' for n, label, kind in DATA_PROPERTIES]
    fixed = spark.createDataFrame([(0, "0", '<?xml version="1.0" encoding="UTF-8"?>'), (0, "1", f'<rdf:RDF xmlns:{PREFIX}="{base}" xml:base="{base}" {spaces}>'), (0, "2", f'  <owl:Ontology rdf:about="{base[:-1]}"/>')] + [(2, f"{k:04d}", x) for k, x in enumerate(data)] + [(9, "", "</rdf:RDF>")], "section int, key string, line string")
    about = lambda c: F.concat(F.lit(f'rdf:about="{base}'), c, F.lit('"'))
    resource = lambda c: F.concat(F.lit(f'rdf:resource="{base}'), c, F.lit('"'))
    element = lambda name, c: F.concat(F.lit(f"<{name}>"), T.xml_escape(c), F.lit(f"</{name}>"))
    class_lines = F.concat(F.lit("  <owl:Class "), about(F.col("name")), F.lit(">"), element("rdfs:label", F.col("original_name")), element("rdfs:comment", F.col("description")), element(f"{PREFIX}:documentCount", F.col("document_count").cast("string")), element(f"{PREFIX}:clusterId", F.col("cluster_id").cast("string")), F.lit("</owl:Class>"))
    side = lambda name, c: F.when(F.size(c) == 1, F.concat(F.lit(f"<rdfs:{name} "), resource(F.get(c, F.lit(0))), F.lit("/>"))).otherwise(F.concat(F.lit(f'<rdfs:{name}><owl:Class><owl:unionOf rdf:parseType="Collection">'), F.array_join(F.transform(c, lambda x: F.concat(F.lit("<owl:Class "), about(x), F.lit("/>"))), ""), F.lit(f"</owl:unionOf></owl:Class></rdfs:{name}>")))
    link_lines = F.concat(F.lit("  <owl:ObjectProperty "), about(F.col("predicate")), F.lit(">"), element("rdfs:label", F.col("predicate")), side("domain", F.col("domains")), side("range", F.col("ranges")), F.lit("</owl:ObjectProperty>"))
    name = F.when(F.col("rel_type") == "TYPE", F.lit("rdfs:subClassOf")).otherwise(_term(F.col("predicate")))
    edge = F.concat(F.lit("  <rdf:Description "), about(F.col("subject")), F.lit("><"), name, F.lit(" "), resource(F.col("object")), F.lit("/></rdf:Description>"))
    return (
        fixed.unionByName(nodes.select(F.lit(1).alias("section"), F.col("name").alias("key"), class_lines.alias("line")))
        .unionByName(links.select(F.lit(3).alias("section"), F.col("predicate").alias("key"), link_lines.alias("line")))
        .unionByName(edges.select(F.when(F.col("rel_type") == "TYPE", 4).otherwise(5).alias("section"), edge.alias("key"), edge.alias("line")))
    )
