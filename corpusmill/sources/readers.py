"""Readers of corpora, questions, evaluation rows, long-context records and concept files."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.text import blank

CORPUS = "id STRING, title STRING, context STRING"
QUESTIONS = "id STRING, question STRING, answer STRING, answers ARRAY<STRING>"
EVALUATION = "question STRING, answer STRING, output STRING, question_id STRING, mode STRING, num_retrieved INT, retrieved_documents STRING"
LONG_CONTEXT = "input STRING, answers ARRAY<STRING>, context STRING"
RELATION = "STRUCT<relation: STRING, type: STRING>"
CONCEPTS = f"cluster_id INT, ontology_name STRING, description STRING, key_concepts ARRAY<STRING>, relationships ARRAY<{RELATION}>, document_count INT, source_clusters ARRAY<INT>"

log = logging.getLogger(__name__)


def _schema(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def json_rows(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """Rows of a JSON list, of the values of a JSON object of objects, or of JSON lines, found out from the file's start.

    JSON lines are read split by split; a list or an object is one document that one task reads. An empty file has no
    rows (and is logged); a list without rows, a scalar, or a line that isn't JSON raises; a missing path raises too."""
    schema = _schema(ddl)
    lines = spark.read.text(path).where(F.trim("value") != "")
    first = lines.limit(2).collect()
    if not first:
        log.warning("%s is empty", path)
        return spark.createDataFrame([], schema)
    start = first[0]["value"].strip()
    if start[0] == "[":
        rows = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
        if not rows.take(1):
            raise ValueError(f"{path} has no rows")
        return rows
    if start[0] != "{":
        raise ValueError(f"{path} is neither a list, an object nor JSON lines")
    whole_line = lines.limit(1).select(F.try_parse_json(F.trim("value")).isNotNull()).first()[0]
    if whole_line and (len(first) > 1 or not _all_objects(lines.limit(1), "value")):
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.map_values(F.from_json("value", T.MapType(T.StringType(), schema), {"mode": "FAILFAST"}))).alias("r")).select("r.*")


def _all_objects(rows: DataFrame, column: str) -> bool:
    """Whether every value of the object is an object itself; a single record isn't such an object."""
    values = F.map_values(F.from_json(column, "map<string,string>"))
    return bool(rows.select(F.forall(values, lambda v: F.trim(v).startswith("{"))).first()[0])


def corpus(spark: SparkSession, path: str) -> DataFrame:
    rows = json_rows(spark, path, CORPUS)
    return rows.select(*(blank(F.col(c)).alias(c) for c in rows.columns))


def questions(spark: SparkSession, path: str) -> DataFrame:
    """Alternatives of an answer are joined by bars, whether they come as a text or as a list."""
    rows = json_rows(spark, path, QUESTIONS)
    return rows.select("id", blank(F.col("question")).alias("question"), F.coalesce("answer", F.array_join("answers", "|"), F.lit("")).alias("answer"))


def evaluation_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of an evaluation; retrieved_documents stays JSON, as its fields differ by mode."""
    return spark.read.schema(EVALUATION).json(path)


def long_context(spark: SparkSession, path: str) -> DataFrame:
    """Records with a context and an input; lines that aren't JSON are skipped."""
    rows = spark.read.schema(LONG_CONTEXT + ", _bad STRING").option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.where(F.col("_bad").isNull() & (F.trim(blank(F.col("context"))) != "") & (F.trim(blank(F.col("input"))) != "")).drop("_bad")


def concept_file(spark: SparkSession, path: str) -> DataFrame:
    """The concepts of a file with `ontologies` and `metadata`, or of the folder that write_concepts() writes."""
    lines = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/ontologies")
    if lines.getFileSystem(spark._jsc.hadoopConfiguration()).exists(lines):
        return spark.read.schema(CONCEPTS).json(f"{path}/ontologies")
    rows = spark.read.schema(f"ontologies ARRAY<STRUCT<{CONCEPTS}>>").option("multiLine", True).json(path)
    return rows.select(F.explode("ontologies").alias("o")).select("o.*")


def artifacts(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """name, path, size (of a folder, all its files) and time (from the name; null where it has none) of a folder's entries."""
    from ..operators.retention import stamp

    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(f"{folder}/{pattern}")
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    found = files.globStatus(where) or []
    rows = [(s.getPath().getName(), s.getPath().toString(), files.getContentSummary(s.getPath()).getLength()) for s in found]
    listed = spark.createDataFrame(rows, "name string, path string, size long")
    return listed.withColumn("time", stamp(F.col("name")))


def prompts(spark: SparkSession, n: int, bases: list[str]) -> DataFrame:
    """index and prompt: n numbered prompts that cycle through the bases."""
    return spark.range(n).select(F.col("id").alias("index"), F.concat(F.get(F.lit(bases), (F.col("id") % len(bases)).cast("int")), F.lit(" (#"), (F.col("id") + 1).cast("string"), F.lit(")")).alias("prompt"))


def sample_clusters(spark: SparkSession, clusters: int = 8, documents: int = 4, topics: list[str] = ("energy", "water", "trade", "health")) -> DataFrame:
    """cluster_id, id, title and context of invented documents whose topics cycle."""
    n = F.col("id")
    topic = F.get(F.lit(list(topics)), (n % len(topics)).cast("int"))
    return spark.range(clusters * documents).select(F.floor(n / documents).cast("int").alias("cluster_id"), n.cast("string").alias("id"), F.concat(F.lit("About "), topic).alias("title"), F.concat(F.lit("Notes on "), topic, F.lit(", part "), n.cast("string"), F.lit(".")).alias("context"))
