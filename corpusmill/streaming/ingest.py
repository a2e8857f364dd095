"""Structured Streaming forms of the row-wise operators. The engine's semantics don't need streams; new files and call logs do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import chunking
from ..sources import readers


def chunk_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Corpus rows of the JSON-lines files that arrive in a folder."""
    records = spark.readStream.schema(readers.LONG_CONTEXT).option("maxFilesPerTrigger", files_per_trigger).json(folder)
    return chunking.corpus_rows(records.withColumn("key", F.md5("context")), "key", "context")


def call_windows(calls: DataFrame, time: str = "ts", duration: str = "duration", late: str = "10 minutes", width: str = "1 minute") -> DataFrame:
    """Calls, successes and average duration in tumbling windows; rows that come later than `late` are dropped."""
    ok = F.col("status") == "success"
    return calls.withWatermark(time, late).groupBy(F.window(time, width)).agg(F.count("*").alias("total"), F.count_if(ok).alias("succeeded"), F.avg(F.when(ok, F.col(duration))).alias("avg_duration"))


def write_stream(rows: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Everything that is there now, then stop."""
    return rows.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


