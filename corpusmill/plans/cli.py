"""Command line: ingest, ontology, rdf, qa and cleanup."""

from __future__ import annotations

import argparse
import os

from ..session import cut, local_session
from ..sources import readers, writers
from . import pipelines


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="corpusmill")
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("ingest")
    p.add_argument("input"), p.add_argument("output")
    p = sub.add_parser("ontology")
    p.add_argument("--corpus", required=True), p.add_argument("--output", required=True), p.add_argument("--clusters", type=int, default=5)
    p.add_argument("--max-cluster-size", type=int, default=20), p.add_argument("--min-cluster-size", type=int)
    p = sub.add_parser("rdf")
    p.add_argument("json_file"), p.add_argument("--output-dir", required=True), p.add_argument("--namespace", default="http://example.org/concepts#"), p.add_argument("--format", choices=["turtle", "xml", "all"], default="all")
    p = sub.add_parser("qa")
    p.add_argument("--corpus"), p.add_argument("--questions", required=True), p.add_argument("--output", required=True), p.add_argument("--clusters", type=int, default=5), p.add_argument("--cache")
    p.add_argument("--zeroshot", action="store_true"), p.add_argument("--ablation", action="store_true")
    p = sub.add_parser("cleanup")
    p.add_argument("--results-dir", required=True), p.add_argument("--keep-count", type=int, default=5), p.add_argument("--keep-days", type=int, default=0), p.add_argument("--dry-run", action="store_true")
    return top


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = local_session()
    if a.command == "ingest":
        writers.write_corpus(*pipelines.ingest(readers.long_context(spark, a.input)), a.output)
    elif a.command == "ontology":
        s = pipelines.Settings(clusters=a.clusters, max_cluster_size=a.max_cluster_size, min_cluster_size=a.min_cluster_size)
        grouped = cut(pipelines.cluster(readers.corpus(spark, a.corpus), s), "grouped")
        writers.write_cluster_details(grouped.drop("embedding"), f"{a.output}/clusters")
        made = pipelines.ontology(grouped, s)
        writers.write_concepts(made.withColumnRenamed("ontology_summary", "description"), a.output, {"corpus_file": a.corpus})
    elif a.command == "rdf":
        from pyspark.sql import functions as F

        writers.write_rdf(readers.concept_file(spark, a.json_file).withColumn("ord", F.xxhash64("ontology_name", "cluster_id")), a.output_dir, a.namespace, a.format)
    elif a.command == "qa":
        mode = "zeroshot" if a.zeroshot else "ablation" if a.ablation else "rag"
        if mode != "zeroshot" and not a.corpus:
            raise SystemExit("--corpus is needed")
        corpus = readers.corpus(spark, a.corpus) if a.corpus else None
        settings = pipelines.Settings(clusters=a.clusters, cache=a.cache)
        made = pipelines.evaluate(corpus, readers.questions(spark, a.questions), settings, mode)
        dataset = os.path.basename(os.path.dirname(os.path.abspath(a.questions)))
        writers.write_report(*made, a.output, dataset, mode, {"Clusters": settings.clusters, "Top-K": settings.top_k, "Corpus": a.corpus, "Questions": a.questions})
    else:
        for r in writers.clean_up(readers.artifacts(spark, a.results_dir), a.keep_count, a.keep_days or None, a.dry_run).toLocalIterator():
            print(r["path"])
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
