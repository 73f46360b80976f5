"""Session set-up and staging of intermediate results."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_local_roots: dict[str, str] = {}
_staged: list[str] = []


def get_spark(app_name: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the jobs rely on; a cluster's own settings win by ``conf``."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        # Call sites of single column expressions are of no use here and slow plan building.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for staged tables, from ``spark.checkpoint.dir``.

    Only a local session without the setting gets a folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="tidemark-")
    return _local_roots[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage of results that several later steps read, and survives lost executors
    because nothing lives only on one machine.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    # What the write shuffled is not read again, so its files need not wait for the driver's garbage collection.
    before = spark.conf.get(_CLEAN_UP, None)
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEAN_UP) if before is None else spark.conf.set(_CLEAN_UP, before)
    _staged.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """Delete the tables that are staged inside, once the jobs in the block are done or have failed."""
    global _staged
    outer, _staged = _staged, []
    try:
        yield
    finally:
        drop_staged(spark)
        _staged = outer


def settled(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """Stored result of ``make``; the tables that it staged on the way are deleted, the result stays staged."""
    with staging(spark):
        result = stage(make(), name)
        path = _staged.pop()
    _staged.append(path)
    return result


def drop_staged(spark: SparkSession) -> int:
    """Delete the tables staged so far; call it when results built on them are stored."""
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark._jsc.hadoopConfiguration()
    dropped = 0
    while _staged:
        path = path_of(_staged.pop())
        dropped += bool(path.getFileSystem(conf).delete(path, True))
    return dropped
