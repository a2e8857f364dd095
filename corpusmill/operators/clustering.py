"""K-means, assignment to centres, sizes, and the rebalancing of sizes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..functions import vectors as V


def cluster_count(n: int, asked: int = 5, max_size: int | None = None, default: int = 5) -> int:
    """Clusters for n documents, where none other than the default was asked for."""
    if asked != default:
        return asked
    floor = [3, n // 10, 5] + ([-(-n // max_size)] if max_size else [])
    return min(max(5, n // 5), max(floor))


def size_limits(n: int, k: int, least: int | None = None, most: int | None = None) -> tuple[int, int]:
    """Smallest and largest size; 0 counts as not given."""
    average = n // k
    least, most = least or max(1, average // 2), most or average * 3 // 2
    if least > most:
        raise ValueError(f"the smallest size {least} exceeds the largest, {most}")
    return least, most


def kmeans(points: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", iterations: int = 20, seed: int = 42, algorithm: str = "auto") -> DataFrame:
    """key and cluster_id; rows with a null vector have none and are left out, as by assign(). algorithm: kmeans, bisecting,
    or auto, which is kmeans."""
    from pyspark.ml.clustering import BisectingKMeans, KMeans
    from pyspark.ml.functions import array_to_vector

    rows = points.where(F.col(vector).isNotNull()).select(key, array_to_vector(V.doubles(F.col(vector))).alias("features"))
    known = {"auto": KMeans, "kmeans": KMeans, "bisecting": BisectingKMeans}
    if algorithm not in known:
        raise ValueError(f"unknown algorithm {algorithm}; known are {', '.join(known)}")
    model = known[algorithm](k=k, maxIter=iterations, seed=seed, featuresCol="features", predictionCol="cluster_id").fit(rows)
    return model.transform(rows).select(key, F.col("cluster_id").cast("int").alias("cluster_id"))


def centers(points: DataFrame, cluster: str, vector: str = "embedding") -> DataFrame:
    """cluster and center (the mean vector)."""
    cells = points.select(F.col(cluster).alias("cluster_id"), F.posexplode(V.doubles(F.col(vector))).alias("at", "x"))
    means = cells.groupBy("cluster_id", "at").agg(F.avg("x").alias("x"))
    listed = means.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("c"))
    return listed.select("cluster_id", F.transform("c", lambda c: c["x"]).alias("center"))


def assign(points: DataFrame, middle: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key, cluster_id and distance of the nearest centre (ties: the smaller id). Centres are k rows, sent to the executors."""
    rows = sorted((r["cluster_id"], list(r["center"])) for r in middle.collect())
    shared = points.sparkSession.sparkContext.broadcast((np.array([r[0] for r in rows], dtype=np.int64), np.array([r[1] for r in rows], dtype=float)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, c = shared.value
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), dtype=float).reshape(batch.num_rows, -1)
            best, far = np.zeros(len(x), np.int64), np.full(len(x), np.inf)
            for k in range(len(c)):
                d = np.sqrt(((x - c[k]) ** 2).sum(axis=1))
                closer = np.round(d, 9) < np.round(far, 9)
                best[closer], far[closer] = ids[k], d[closer]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best), pa.array(far)], names=[key, "cluster_id", "distance"])

    some = points.where(F.col(vector).isNotNull())
    return some.select(key, vector).mapInArrow(run, f"{key} long, cluster_id long, distance double")


def center_distance(points: DataFrame, middle: DataFrame, cluster: str, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key, cluster_id and distance to the own cluster's centre."""
    joined = points.select(key, F.col(cluster).alias("cluster_id"), vector).join(F.broadcast(middle) if middle.count() <= 10_000 else middle, "cluster_id")
    return joined.select(key, "cluster_id", V.distance(F.col(vector), F.col("center")).alias("distance"))


def center_similarity(points: DataFrame, middle: DataFrame, cluster: str, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key, cluster_id and cosine to the own cluster's centre."""
    joined = points.select(key, F.col(cluster).alias("cluster_id"), vector).join(F.broadcast(middle) if middle.count() <= 10_000 else middle, "cluster_id")
    return joined.select(key, "cluster_id", V.cosine(V.doubles(F.col(vector)), F.col("center")).alias("similarity"))


def sizes(points: DataFrame, cluster: str) -> DataFrame:
    return points.groupBy(F.col(cluster).alias("cluster_id")).agg(F.count("*").alias("n"))


def size_stats(points: DataFrame, cluster: str) -> DataFrame:
    """Documents, clusters, and the smallest, largest and average size; zeros for none."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    return sizes(points, cluster).agg(zero(F.sum("n")).alias("total_documents"), F.count("*").alias("num_clusters"), zero(F.min("n")).alias("min_size"), zero(F.max("n")).alias("max_size"), F.coalesce(F.avg("n"), F.lit(0.0)).alias("avg_size"))


def histogram(points: DataFrame, cluster: str, k: int) -> DataFrame:
    """Sizes of clusters 0 to k - 1, empty ones too."""
    every = points.sparkSession.range(k).withColumnRenamed("id", "cluster_id")
    found = sizes(points, cluster).withColumn("cluster_id", F.col("cluster_id").cast("long"))
    return every.join(found, "cluster_id", "left").select("cluster_id", F.coalesce("n", F.lit(0)).alias("n"))


def move_plan(size: dict[int, int], least: int, most: int, rounds: int = 10) -> list[tuple[int, int, int, int]]:
    """(source, first rank, last rank, target) of the rows that rebalancing moves, farthest first. Only sizes decide."""
    now, gone, plan = dict(size), dict.fromkeys(size, 0), []
    for _ in range(rounds):
        small = [c for c in sorted(now) if now[c] < least]
        large = [c for c in sorted(now) if now[c] > most]
        if not small or not large:
            break
        for c in large:
            target = next((t for t in sorted(now) if now[t] < least), None)
            if target is None:
                break
            n = min(now[c] - most, least - now[target])
            plan.append((c, gone[c] + 1, gone[c] + n, target))
            gone[c] += n
            now[c] -= n
            now[target] += n
    return plan


def rebalance(points: DataFrame, cluster: str, least: int, most: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key, cluster_id and moved: oversized clusters give their farthest rows to the first undersized one, as long as there
    is one. The plan needs the k sizes only; rows move by one window and one join with it."""
    if least > most:
        raise ValueError(f"the smallest size {least} exceeds the largest, {most}")
    plan = move_plan({r["cluster_id"]: r["n"] for r in sizes(points, cluster).collect()}, least, most)
    far = center_distance(points, centers(points, cluster, vector), cluster, key, vector)
    if not plan:
        return far.select(key, "cluster_id", F.lit(False).alias("moved"))
    moves = points.sparkSession.createDataFrame(plan, "source long, first long, last long, target long")
    deepest = F.broadcast(moves.groupBy(F.col("source").alias("cluster_id")).agg(F.max("last").alias("last")))
    # Only rows that may move are ranked: the deepest rank is below the cluster's size, and the plan has k rows at most a round.
    rank = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.round("distance", 9).desc(), key))
    ranked = far.join(deepest.select("cluster_id"), "cluster_id", "left_semi").withColumn("rank", rank)
    moved = ranked.join(F.broadcast(moves), (F.col("cluster_id") == F.col("source")) & F.col("rank").between(F.col("first"), F.col("last"))).select(key, "target")
    return far.join(moved, key, "left").select(key, F.coalesce("target", "cluster_id").alias("cluster_id"), F.col("target").isNotNull().alias("moved"))


def report(points: DataFrame, cluster: str, text: str, key: str) -> DataFrame:
    """One row a document: cluster, id, length, and the start of its text."""
    from ..functions.text import preview

    return points.select(F.col(cluster).alias("cluster_id"), F.col(key).alias("doc_id"), F.length(text).cast("long").alias("context_length"), preview(F.col(text)).alias("context_preview"))
