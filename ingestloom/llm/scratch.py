"""Intermediate tables that outlive an executor.

Lineage is cut by writing Parquet below the folder that the cluster names in
``spark.checkpoint.dir``; every executor and the driver reach it. Only where
that setting is absent (local tests) a folder of our own is set.
"""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

#: Small partitions are joined to the advised size; shuffle files go once the table is written.
_WHILE_WRITING = {"spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
#: Session, path and thread of every table that there is.
_made: list[tuple[SparkSession, str, int]] = []


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if not current:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ingestloom-"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    The rows are computed a single time, whatever reads them later, and a lost
    executor costs no recomputation of what came before. Small results go to
    few files: partitions after a shuffle are joined to the advised size.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/ingestloom-{uuid.uuid4().hex}"
    before = {key: spark.conf.get(key) for key in _WHILE_WRITING}
    for key, value in _WHILE_WRITING.items():
        spark.conf.set(key, value)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    _made.append((spark, path, threading.get_ident()))
    return spark.read.schema(df.schema).parquet(path)


def folder(spark: SparkSession) -> str:
    """A fresh path in the shared folder, for files of an operator's own; it goes with the other tables."""
    path = f"{scratch_root(spark)}/ingestloom-{uuid.uuid4().hex}"
    _made.append((spark, path, threading.get_ident()))
    return path


def made() -> set[str]:
    """Paths of the tables that this thread has made and that are still there."""
    return {path for _, path, thread in _made if thread == threading.get_ident()}


def release_unread(df: DataFrame, before: set[str], *more: DataFrame) -> None:
    """Delete this thread's tables that were not there ``before`` and that the plans of ``df`` and ``more`` do not read."""
    fresh = made() - before
    read = {name for x in ((df, *more) if fresh else ()) for file in x.inputFiles() for name in file.split("/") if name.startswith("ingestloom-")}
    release([path for path in fresh if path.rsplit("/", 1)[-1] not in read])


def release(paths: Iterable[str]) -> None:
    """Delete some intermediate tables; call when what reads them was written."""
    doomed = [entry for entry in _made if entry[1] in set(paths)]
    for entry in doomed:
        _made.remove(entry)
    for spark, path, _ in doomed:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def purge() -> None:
    """Delete every intermediate table, as far as their sessions are alive."""
    try:
        release([path for _, path, _ in _made])
    except Exception:  # a session has ended; nothing can be deleted through it
        _made.clear()


atexit.register(purge)
