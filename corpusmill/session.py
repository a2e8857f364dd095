"""Sessions and the shared folder that cut lineage is written to."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | None = None, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster, use the session that it gives."""
    n = cpus or os.cpu_count() or 4
    base = {
        "spark.master": f"local[{n}]",
        "spark.sql.shuffle.partitions": str(n),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.driver.host": "127.0.0.1",
    }
    builder = SparkSession.builder.appName("corpusmill")
    for k, v in (base | conf).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder: setCheckpointDir()'s, which spark.checkpoint.dir sets at the start, or that setting
    itself. Only a local master gets a temporary folder where none is set (tests); a cluster's machines wouldn't share it."""
    context = spark.sparkContext
    named = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='corpusmill-')}"
        context.setCheckpointDir(named)
    return named.rstrip("/")


#: Bytes of a batch that goes to a Python worker, where the session doesn't say: rows are texts of any length, so that a number
#: of rows bounds nothing.
BATCH_BYTES = 4 << 20


def ship(spark: SparkSession) -> SparkSession:
    """Python workers that start from now on find this package, also where it isn't installed but only lies on a
    path that all machines see; elsewhere, give it to the cluster with --py-files. They get batches of bounded bytes."""
    batch = "spark.sql.execution.arrow.maxBytesPerBatch"
    if batch not in spark.conf.getAll:
        spark.conf.set(batch, str(BATCH_BYTES))
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join(p for p in (*paths, root) if p)
    return spark


#: Folders of tables that have not been dropped, oldest first.
_roots: list[tuple[SparkSession, str]] = []


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """rows dealt by keys over all cores. For tables of few bytes and costly rows: a file of one row group is read by one task, which
    would do all the work."""
    spark = rows.sparkSession
    return rows.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Tables of one operator in the shared folder, dropped as soon as they have been used.

    A table that a returned, lazy DataFrame still reads stays until the scope() around the call ends, or the
    driver's Python does."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/corpusmill-{uuid.uuid4().hex}"
        self._n = 0
        _roots.append((spark, self.root))

    def put(self, df: DataFrame, name: str = "table") -> DataFrame:
        """Write df as Parquet and read it back: lineage ends there, and a lost executor costs one
        read, not the stages before it. The write's shuffle files go when it is done."""
        self._n += 1
        path, conf = f"{self.root}/{self._n}-{name}", "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = self.spark.conf.get(conf, None)
        self.spark.conf.set(conf, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(conf, before or "false")
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        drop(*tables)


def drop(*tables: DataFrame) -> None:
    """Deletes tables of put() or cut() that nothing reads any more."""
    for t in tables:
        _delete(t.sparkSession, t._scratch_path)


def cut(df: DataFrame, name: str = "table") -> DataFrame:
    """One table by itself: see Scratch.put."""
    return Scratch(df.sparkSession).put(df, name)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Drops, at its end, every table that was made inside; act on what the operators return before that."""
    first = len(_roots)
    try:
        yield
    finally:
        _drop_from(first)


def _drop_from(first: int) -> None:
    while len(_roots) > first:
        spark, root = _roots.pop()
        if spark.sparkContext._jsc is not None:
            _delete(spark, root)


@atexit.register
def _drop_all() -> None:
    with suppress(Exception):  # the session may have ended first
        _drop_from(0)
