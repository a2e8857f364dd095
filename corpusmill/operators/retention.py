"""Which timestamped artifacts to keep, and statistics of calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def stamp(name: Column) -> Column:
    """The time in a name like x_20240131_235959.json; null where there is none."""
    return F.try_to_timestamp(F.regexp_extract(name, "([0-9]{8}_[0-9]{6})", 1), F.lit("yyyyMMdd_HHmmss"))


def beyond_newest(rows: DataFrame, group: str, time: str, key: str, keep: int = 5) -> DataFrame:
    """Rows that are not among the `keep` newest of their group (ties: the larger key is newer). Only the newest few of
    each group are ranked; the rest is compared with the last of these."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.col(time).desc_nulls_last(), F.col(key).desc()))
    newest = rows.select(group, time, key).withColumn("rank", rank).where(F.col("rank") <= keep)
    last = newest.groupBy(group).agg(F.max_by(F.struct(F.col(time).alias("t"), F.col(key).alias("k")), "rank").alias("last"))
    older = F.coalesce(F.col(time) < F.col("last.t"), F.lit(False)) | (F.col(time).eqNullSafe(F.col("last.t")) & (F.col(key) < F.col("last.k"))) | (F.col(time).isNull() & F.col("last.t").isNotNull())
    return rows.join(last, group).where(older).drop("last")


def older_than(rows: DataFrame, time: str, days: int, now: Column | None = None) -> DataFrame:
    moment = F.current_timestamp() if now is None else now
    return rows.where(F.col(time) < moment - F.make_interval(days=F.lit(days)))


def call_stats(calls: DataFrame, duration: str, ok: Column, seconds: float | None = None) -> DataFrame:
    """Calls, share of successes in percent, calls a second, and average, longest and shortest duration of successes."""
    good = F.when(ok, F.col(duration))
    rate = F.try_divide(F.count("*").cast("double"), F.lit(seconds) if seconds else F.sum(duration))
    return calls.agg(F.count("*").alias("total"), F.count_if(ok).alias("succeeded"), (100.0 * F.try_divide(F.count_if(ok), F.count("*"))).alias("success_rate"), rate.alias("per_second"), F.avg(good).alias("avg_duration"), F.max(good).alias("max_duration"), F.min(good).alias("min_duration"))
