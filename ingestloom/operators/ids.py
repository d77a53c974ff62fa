"""Largest ids in use, and ids for new rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ingestloom.model import IdAllocator
from ingestloom.plans.settings import scratch_folder


def max_id(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row: the largest value of a single-column key, 0 for an empty table."""
    if len(key) != 1:
        raise ValueError("a composite key has no largest id")
    return df.agg(F.coalesce(F.max(key[0]), F.lit(0)).cast("bigint").alias("max_id"))


def allocator(df: DataFrame, key: Sequence[str]) -> IdAllocator:
    return IdAllocator(max_id(df, key).first()["max_id"])


def assign_ids(rows: DataFrame, target: DataFrame, key: str, order: Sequence[str | Column]) -> DataFrame:
    """``rows`` with dense ids above those of ``target``, in the given order.

    Rows are ranged by the order, numbered within each range, and shifted by
    the sizes of the ranges before, so no task sees all of them. The numbered
    rows are written once: ranges follow from a sample, and one drawn anew for
    the sizes would cut the rows elsewhere.
    """
    ranged = rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    local = ranged.withColumn("_nth", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    folder = scratch_folder(rows.sparkSession)
    local.write.parquet(folder)
    local = rows.sparkSession.read.schema(local.schema).parquet(folder)
    sizes = local.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))  # one row a range
    start = max_id(target, [key])
    joined = local.join(F.broadcast(before), "_part").crossJoin(F.broadcast(start))
    new = (F.col("max_id") + F.coalesce("_before", F.lit(0)) + F.col("_nth")).cast("bigint")
    return joined.withColumn(key, new).drop("_part", "_n", "_before", "_nth", "max_id")
