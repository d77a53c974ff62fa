"""Session settings, capabilities, and options that Spark has no use for but callers pass."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import SparkSession

INDEX_STRATEGIES = ("auto", "drop_rebuild", "keep")


@dataclass(frozen=True)
class Capabilities:
    """What the engine does natively: a scan without casts, staging without a log, views, no enforced foreign keys."""

    fast_load: bool = True
    unlogged_staging: bool = True
    fk_toggle: bool = False
    materialized_views: bool = True

    def require(self, name: str) -> None:
        if not getattr(self, name):
            raise NotImplementedError(f"{name} is not supported")


def resolve_index_strategy(strategy: str) -> str:
    """The strategy that ``auto`` stands for, or the one named; others are an error."""
    if strategy not in INDEX_STRATEGIES:
        raise ValueError(f"unknown index strategy {strategy!r}; one of {INDEX_STRATEGIES}")
    return "keep" if strategy == "auto" else strategy


def configure(builder: SparkSession.Builder, **more: str) -> SparkSession.Builder:
    """Settings that results depend on, and adaptive execution."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.timestampType": "TIMESTAMP_NTZ",
    } | more
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder


def quote_identifier(name: str, schema: str | None = None) -> str:
    """A name for SQL text, in back-ticks, with its schema if any."""
    parts = [p for p in (schema, name) if p]
    return ".".join("`" + p.replace("`", "``") + "`" for p in parts)


#: Sessions and paths of scratch folders that there are.
_scratch: list[tuple[SparkSession, str]] = []


def scratch_folder(spark: SparkSession) -> str:
    """A fresh folder below the one that the cluster shares; a local one only where none is named. It goes when the program ends."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    path = f"{(named or tempfile.mkdtemp(prefix='ingestloom-')).rstrip('/')}/ingestloom-{uuid.uuid4().hex}"
    _scratch.append((spark, path))
    return path


@atexit.register
def drop_scratch_folders() -> None:
    """Deletes the scratch folders, as far as their sessions are alive."""
    while _scratch:
        spark, path = _scratch.pop()
        try:
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
        except Exception:  # the session has ended; nothing can be deleted through it
            return
