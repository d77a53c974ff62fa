"""Merging staged rows into a target: pure DataFrame plans.

All joins are on the primary key. Which side is broadcast is left to the
optimizer, which knows sizes; nothing is forced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ingestloom.errors import IngestError
from ingestloom.operators.quality import first_per_key
from ingestloom.sources.readers import ROWNUM

STRATEGIES = ("replace", "upsert", "insert_if_empty")


def _staged(staging: DataFrame) -> DataFrame:
    return staging.drop(ROWNUM)


def replace(target: DataFrame, staging: DataFrame, key: Sequence[str]) -> DataFrame:
    """Target rows whose key is not staged, and all staged rows."""
    kept = target.join(staging.select(*key).distinct(), list(key), "left_anti")
    return kept.select(*target.columns).unionByName(_staged(staging), allowMissingColumns=True)


def upsert(target: DataFrame, staging: DataFrame, key: Sequence[str], order: Sequence[str | Column] = (ROWNUM,)) -> DataFrame:
    """The target unchanged, and the first staged row of every key that it lacks."""
    fresh = first_per_key(staging, key, order, keep_null_keys=False).join(target.select(*key), list(key), "left_anti")
    return target.unionByName(_staged(fresh), allowMissingColumns=True)


def insert(target: DataFrame, staging: DataFrame) -> DataFrame:
    """All target rows and all staged rows."""
    return target.unionByName(_staged(staging), allowMissingColumns=True)


def check_empty(target: DataFrame) -> None:
    if not target.isEmpty():
        raise ValueError("insert_if_empty needs an empty target")


def check_strategy(strategy: str) -> None:
    if strategy not in STRATEGIES:
        raise ValueError(f"Unknown merge strategy {strategy!r}; one of {STRATEGIES}")


def repeated_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that more than one row holds, and their number of rows."""
    return df.groupBy(*key).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def check_unique(staging: DataFrame, key: Sequence[str]) -> None:
    """Raises where staged rows repeat a key, as a primary key would."""
    some = repeated_keys(staging, key).limit(3).collect()
    if some:
        raise IngestError(f"repeated primary keys in the staged rows, such as {[tuple(r)[:-1] for r in some]}")


def plan(target: DataFrame, staging: DataFrame, key: Sequence[str], strategy: str, target_is_empty: bool) -> DataFrame:
    """The merged table. An empty target needs no join: the staged rows are the result."""
    check_strategy(strategy)
    if strategy == "insert_if_empty":
        if not target_is_empty:
            raise ValueError("insert_if_empty needs an empty target")
        return insert(target, staging)
    if strategy == "upsert":
        return insert(target, first_per_key(staging, key, keep_null_keys=False)) if target_is_empty else upsert(target, staging, key)
    return insert(target, staging) if target_is_empty else replace(target, staging, key)
