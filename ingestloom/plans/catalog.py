"""Tables in Spark's catalog, bucketed by their keys, and the choice of a store by name.

``CatalogStore`` keeps a table as a managed one of a database: ``bucketBy`` and
``sortBy`` on its primary key, so that a merge joins stored rows without a
shuffle of theirs. A write makes a table beside the current one and swaps names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

from ingestloom.model import IdAllocator, TableModel
from ingestloom.operators import ids, merge
from ingestloom.plans.buckets import BucketedStore
from ingestloom.plans.settings import quote_identifier
from ingestloom.plans.store import TableStore, VersionedStore, with_computed


class CatalogStore:
    """Managed tables of one database."""

    def __init__(self, spark: SparkSession, database: str = "default", buckets: int = 8):
        self.spark, self.database, self.buckets = spark, database, buckets
        spark.sql(f"create database if not exists {quote_identifier(database)}")

    def _at(self, name: str) -> str:
        return quote_identifier(name.replace("/", "__"), self.database)

    def exists(self, name: str) -> bool:
        return self.spark.catalog.tableExists(self._at(name))

    def read(self, model: TableModel) -> DataFrame:
        if not self.exists(model.name):
            return self.spark.createDataFrame([], model.schema)
        return self.spark.table(self._at(model.name)).select(*model.schema.names)

    def read_rows(self, name: str) -> DataFrame:
        if not self.exists(name):
            raise ValueError(f"{name} does not exist")
        return self.spark.table(self._at(name))

    def is_empty(self, model: TableModel) -> bool:
        return self.read(model).isEmpty()

    def write(self, model: TableModel, df: DataFrame, max_records_per_file: int | None = None) -> None:
        self._swap(model.name, with_computed(df, model), list(model.primary_key), max_records_per_file)

    def write_rows(self, name: str, df: DataFrame, max_records_per_file: int | None = None) -> None:
        self._swap(name, df, [], max_records_per_file)

    def _swap(self, name: str, df: DataFrame, key: list[str], max_records_per_file: int | None) -> None:
        fresh, old = f"{name}__{uuid.uuid4().hex[:12]}", f"{name}__{uuid.uuid4().hex[:12]}"
        writer = df.write.format("parquet")
        if key:
            writer = writer.bucketBy(self.buckets, *key).sortBy(*key)
        if max_records_per_file:
            writer = writer.option("maxRecordsPerFile", max_records_per_file)
        try:
            writer.saveAsTable(self._at(fresh))
        except Exception:
            self.drop(fresh)
            raise
        if self.exists(name):
            self.spark.sql(f"alter table {self._at(name)} rename to {self._at(old)}")
        self.spark.sql(f"alter table {self._at(fresh)} rename to {self._at(name)}")
        self.drop(old)

    def merge_rows(self, model: TableModel, staged: DataFrame, strategy: str, batch_rows: int | None = None, load: str | None = None) -> None:
        merge_whole(self, model, staged, strategy, batch_rows)

    def drop(self, name: str) -> None:
        self.spark.sql(f"drop table if exists {self._at(name)}")

    def bootstrap(self, models: Iterable[TableModel], create: bool = True) -> None:
        for model in models if create else ():
            if not self.exists(model.name):
                self.write(model, self.spark.createDataFrame([], model.schema))

    def stage(self, name: str, df: DataFrame) -> DataFrame:
        df.write.format("parquet").mode("overwrite").saveAsTable(self._at(name))
        return self.spark.table(self._at(name))

    def max_id(self, model: TableModel) -> int:
        return ids.max_id(self.read(model), model.key()).first()["max_id"]

    def allocator(self, model: TableModel) -> IdAllocator:
        return ids.allocator(self.read(model), model.key())


def merge_whole(store: TableStore, model: TableModel, staged: DataFrame, strategy: str, batch_rows: int | None = None) -> None:
    """A merge as one plan; the table is written anew."""
    target = store.read(model).drop(*[c.name for c in model.columns if c.computed is not None])
    if model.primary_key:
        merged = merge.plan(target, staged, model.key(), strategy, store.is_empty(model))
    else:
        merged = merge.insert(target, staged)
    store.write(model, merged, batch_rows)


STORES: dict[str, Callable[..., TableStore]] = {"versioned": VersionedStore, "bucketed": BucketedStore, "catalog": CatalogStore}


def register_store(name: str, make: Callable[..., TableStore]) -> None:
    """A further kind of store; ``make`` takes the session, a place, and options."""
    STORES[name.lower()] = make


def resolve_store(spark: SparkSession, kind: str, place: str, **options) -> TableStore:
    """The store of a kind, at a folder or in a database."""
    try:
        make = STORES[kind.strip().lower()]
    except KeyError:
        raise ValueError(f"unknown store {kind!r}; one of {sorted(STORES)}") from None
    return make(spark, place, **options)
