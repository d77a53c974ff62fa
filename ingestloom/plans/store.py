"""Tables as versioned Parquet folders.

A write makes a new version beside the current one, and then moves a pointer
file into place. A reader sees one version whole; a failed write leaves the
table as it was. One writer at a time is assumed.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Mapping
from types import MappingProxyType
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ingestloom.model import IdAllocator, TableModel
from ingestloom.operators import ids
from ingestloom.plans import layout

_POINTER, _LAYOUT = "_CURRENT", "_LAYOUT"


class TableStore(Protocol):
    """Where tables live."""

    def exists(self, name: str) -> bool: ...

    def read(self, model: TableModel) -> DataFrame: ...

    def write(self, model: TableModel, df: DataFrame, max_records_per_file: int | None = None) -> None: ...

    def merge_rows(self, model: TableModel, staged: DataFrame, strategy: str, batch_rows: int | None = None, load: str | None = None): ...

    def stage(self, name: str, df: DataFrame) -> DataFrame: ...

    def drop(self, name: str) -> None: ...

    def is_empty(self, model: TableModel) -> bool: ...

    def write_rows(self, name: str, df: DataFrame, max_records_per_file: int | None = None) -> None: ...

    def read_rows(self, name: str) -> DataFrame: ...


class Files:
    """File operations through Hadoop's file systems, as Spark's own."""

    def __init__(self, spark: SparkSession):
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        place = self.jvm.org.apache.hadoop.fs.Path(path)
        return place, place.getFileSystem(self.conf)

    def exists(self, path: str) -> bool:
        place, system = self._at(path)
        return system.exists(place)

    def delete(self, path: str) -> None:
        place, system = self._at(path)
        system.delete(place, True)

    def children(self, path: str) -> list[str]:
        place, system = self._at(path)
        return [s.getPath().getName() for s in system.listStatus(place)] if system.exists(place) else []

    def read_text(self, path: str) -> str:
        place, system = self._at(path)
        stream = system.open(place)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def replace_text(self, path: str, text: str) -> None:
        """Writes beside the file, then renames over it."""
        fresh = f"{path}.{uuid.uuid4().hex}"
        place, system = self._at(fresh)
        stream = system.create(place, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        target, _ = self._at(path)
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri() if place.toUri().getScheme() else system.getUri(), self.conf)
        options = self.jvm.org.apache.hadoop.fs.Options
        rename = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
        rename[0] = getattr(options, "Rename").OVERWRITE
        context.rename(system.makeQualified(place), system.makeQualified(target), rename)


class VersionedStore:
    """Tables below a root folder, one folder of versions each.

    ``options`` go to the Parquet writer. Tables named in ``plain`` are written
    without the layout of their indexes.
    """

    def __init__(self, spark: SparkSession, root: str, keep_versions: int = 2, options: Mapping[str, str] | None = None):
        self.spark, self.root, self.keep = spark, root.rstrip("/"), max(1, keep_versions)
        self.options, self.plain = dict(options or {}), set()
        self.files = Files(spark)

    def _pointer(self, name: str) -> str:
        return f"{self.root}/{name}/{_POINTER}"

    def current(self, name: str) -> str | None:
        """Path of the current version."""
        if not self.files.exists(self._pointer(name)):
            return None
        return f"{self.root}/{name}/{self.files.read_text(self._pointer(name)).strip()}"

    def exists(self, name: str) -> bool:
        return self.current(name) is not None

    def read(self, model: TableModel) -> DataFrame:
        path = self.current(model.name)
        if path is None:
            return self.spark.createDataFrame([], model.schema)
        return self.spark.read.schema(model.schema).parquet(path)

    def is_empty(self, model: TableModel) -> bool:
        return not self.exists(model.name) or self.read(model).isEmpty()

    def read_rows(self, name: str) -> DataFrame:
        path = self.current(name)
        if path is None:
            raise ValueError(f"{name} does not exist")
        return self.spark.read.parquet(path)

    def merge_rows(self, model: TableModel, staged: DataFrame, strategy: str, batch_rows: int | None = None, load: str | None = None) -> None:
        """One plan; the table's next version is written whole."""
        from ingestloom.plans.catalog import merge_whole

        merge_whole(self, model, staged, strategy, batch_rows)

    def write(self, model: TableModel, df: DataFrame, max_records_per_file: int | None = None) -> None:
        """The next version: the model's columns in order, absent ones null, computed ones evaluated, clustered by the model's first index."""
        rows = with_computed(df, model)
        if model.name in self.plain or not model.indexes:
            self.write_rows(model.name, rows, max_records_per_file)
        else:
            self._write_version(model.name, layout.clustered(rows, model), max_records_per_file, layout.writer_options(model), self._layout_text(model))

    @staticmethod
    def _layout_text(model: TableModel) -> str:
        return json.dumps({"order": layout.layout_order(model), "filters": layout.filtered_columns(model)})

    def is_laid_out(self, model: TableModel) -> bool:
        """Whether the current version has the layout of the model's indexes, or there is none to have."""
        path = self.current(model.name)
        if path is None or not model.indexes:
            return True
        mark = f"{path}/{_LAYOUT}"
        return self.files.exists(mark) and self.files.read_text(mark) == self._layout_text(model)

    def rebuild(self, model: TableModel, max_records_per_file: int | None = None) -> None:
        """The current rows as a further version with the layout of the model's indexes."""
        self._write_version(model.name, layout.clustered(self.read(model), model), max_records_per_file, layout.writer_options(model), self._layout_text(model))

    def write_rows(self, name: str, df: DataFrame, max_records_per_file: int | None = None) -> None:
        self._write_version(name, df, max_records_per_file)

    def _write_version(self, name: str, df: DataFrame, max_records_per_file: int | None, options: Mapping[str, str] = MappingProxyType({}), mark: str | None = None) -> None:
        before = self.current(name)
        last = int(before.rsplit("v", 1)[1]) if before else 0
        version = f"v{last + 1:08d}"
        path = f"{self.root}/{name}/{version}"
        writer = df.write.mode("overwrite").options(**self.options, **options)
        if max_records_per_file:
            writer = writer.option("maxRecordsPerFile", max_records_per_file)
        try:
            writer.parquet(path)
            if mark is not None:
                self.files.replace_text(f"{path}/{_LAYOUT}", mark)
        except Exception:
            self.files.delete(path)
            raise
        self.files.replace_text(self._pointer(name), version)
        for old in self.files.children(f"{self.root}/{name}"):
            if old.startswith("v") and int(old[1:]) <= last + 1 - self.keep:
                self.files.delete(f"{self.root}/{name}/{old}")

    def drop(self, name: str) -> None:
        self.files.delete(f"{self.root}/{name}")

    def bootstrap(self, models: Iterable[TableModel], create: bool = True) -> None:
        """An empty table for each model that has none."""
        for model in models if create else ():
            if not self.exists(model.name):
                self.write(model, self.spark.createDataFrame([], model.schema))

    def stage(self, name: str, df: DataFrame) -> DataFrame:
        """Rows written once and read back, so that what follows sees the same rows."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def max_id(self, model: TableModel) -> int:
        return ids.max_id(self.read(model), model.key()).first()["max_id"]

    def allocator(self, model: TableModel) -> IdAllocator:
        return ids.allocator(self.read(model), model.key())


def with_computed(df: DataFrame, model: TableModel) -> DataFrame:
    """All columns of the model in its types; defaults fill nulls, computed columns are evaluated last."""
    out = []
    for column in model.insertable:
        value: Column = F.col(column.name) if column.name in df.columns else F.lit(None)
        if column.default is not None:
            value = F.coalesce(value, F.lit(column.default))
        elif column.server_default is not None:
            value = F.coalesce(value, F.expr(column.server_default))
        out.append(value.cast(column.spark_type).alias(column.name))
    whole = df.select(*out)
    for column in model.columns:
        if column.computed is not None:
            expression = F.expr(column.computed) if isinstance(column.computed, str) else column.computed()
            whole = whole.withColumn(column.name, expression.cast(column.spark_type))
    return whole
