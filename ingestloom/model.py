"""Declared tables: the schema that files are fitted to."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field
from typing import Any, Protocol, runtime_checkable

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import types as T

from ingestloom.functions.nulls import is_null_value

#: Logical types that are cast, and the Spark type of each. Any other Spark type passes through uncast.
SPARK_TYPES: dict[str, T.DataType] = {
    "integer": T.LongType(),
    "float": T.DoubleType(),
    "boolean": T.BooleanType(),
    "date": T.DateType(),
    "datetime": T.TimestampNTZType(),
    "string": T.StringType(),
}


@dataclass(frozen=True)
class ColumnModel:
    """One column: a logical type name or a Spark type, and its constraints.

    ``computed`` is an expression over the other columns, evaluated on write.
    ``nullable`` None means: yes, unless the column is part of the key.
    ``autoincrement`` None means: yes for the only, integer, primary key column.
    ``canonical`` False keeps numeric-looking strings as they are written.
    """

    name: str
    kind: str | T.DataType = "string"
    nullable: bool | None = None
    length: int | None = None
    default: Any = None
    server_default: str | None = None
    autoincrement: bool | None = None
    computed: str | Callable[[], Column] | None = None
    source_name: str | None = None
    canonical: bool = True

    @property
    def spark_type(self) -> T.DataType:
        return SPARK_TYPES[self.kind] if isinstance(self.kind, str) else self.kind


@dataclass(frozen=True)
class TableModel:
    """A declared table. ``foreign_keys`` maps a column to (table, column); ``indexes`` are column lists besides the key."""

    name: str
    columns: tuple[ColumnModel, ...]
    primary_key: tuple[str, ...] = ()
    foreign_keys: Mapping[str, tuple[str, str]] = field(default_factory=dict)
    indexes: tuple[tuple[str, ...], ...] = ()

    def __post_init__(self) -> None:
        object.__setattr__(self, "columns", tuple(self.columns))
        object.__setattr__(self, "primary_key", tuple(self.primary_key))
        object.__setattr__(self, "indexes", tuple(tuple(index) for index in self.indexes))
        unknown = [c for c in (*self.primary_key, *self.foreign_keys, *(c for index in self.indexes for c in index)) if c not in self.column_names]
        if unknown:
            raise ValueError(f"{self.name}: keys name unknown columns {unknown}")
        if not all(self.indexes):
            raise ValueError(f"{self.name}: an index without columns")

    @property
    def column_names(self) -> list[str]:
        return [c.name for c in self.columns]

    @property
    def by_name(self) -> dict[str, ColumnModel]:
        return {c.name: c for c in self.columns}

    @property
    def schema(self) -> T.StructType:
        """The stored schema; computed columns come last, as they are written last."""
        ordered = [*self.insertable, *(c for c in self.columns if c.computed is not None)]
        meta = lambda c: {"length": c.length} if c.length else {}
        return T.StructType([T.StructField(c.name, c.spark_type, self.is_nullable(c), meta(c)) for c in ordered])

    def is_nullable(self, column: ColumnModel) -> bool:
        return column.name not in self.primary_key if column.nullable is None else column.nullable

    @property
    def insertable(self) -> list[ColumnModel]:
        """Columns that loads write: all but computed ones."""
        return [c for c in self.columns if c.computed is None]

    def file_columns(self) -> dict[str, str]:
        """Header name in files for each insertable column."""
        return {(c.source_name or c.name): c.name for c in self.insertable}

    def key(self) -> list[str]:
        """Primary key columns; a table without one cannot be merged into."""
        if not self.primary_key:
            raise ValueError(f"{self.name} has no primary key")
        return list(self.primary_key)

    def key_of(self, row: Mapping[str, Any] | Row) -> tuple:
        """The primary key values of a row."""
        return tuple(row[name] for name in self.key())

    def key_values(self, row: Mapping[str, Any] | Row) -> dict[str, Any]:
        return dict(zip(self.key(), self.key_of(row), strict=True))

    def counts_up(self, column: ColumnModel) -> bool:
        """Whether values of the column are given by the table itself."""
        if column.autoincrement is not None:
            return column.autoincrement
        return self.primary_key == (column.name,) and column.kind == "integer"

    def required_columns(self) -> list[str]:
        """Columns that a row must bring: not nullable, and without any source of a value."""
        return [c.name for c in self.insertable if not self.is_nullable(c) and c.default is None and c.server_default is None and not self.counts_up(c)]

    def clean_row(self, data: Mapping[str, Any], drop_nulls: bool = True, strict: bool = False) -> dict[str, Any]:
        """Known, null-normalised values of a row; ``strict`` demands the required ones."""
        known = {k: None if is_null_value(v) else v for k, v in data.items() if k in self.by_name}
        missing = sorted(c for c in self.required_columns() if known.get(c) is None)
        if strict and missing:
            raise ValueError(f"{self.name}: missing required values {missing}")
        return {k: v for k, v in known.items() if v is not None or not drop_nulls}

    def from_rows(self, spark: SparkSession, rows: Iterable[Mapping[str, Any]], strict: bool = False) -> DataFrame:
        """A DataFrame of driver-side rows in the model's schema.

        A value of the wrong type raises TypeError, one that the type cannot
        hold ValueError, anything else RuntimeError.
        """
        defaults = {c.name: c.default for c in self.insertable if c.default is not None}
        cleaned = [{**defaults, **self.clean_row(row, strict=strict)} for row in rows]
        schema = T.StructType([T.StructField(c.name, c.spark_type) for c in self.insertable])
        try:
            return spark.createDataFrame([tuple(row.get(f.name) for f in schema) for row in cleaned], schema)
        except TypeError as error:
            raise TypeError(f"{self.name}: {error}") from error
        except ValueError as error:
            raise ValueError(f"{self.name}: {error}") from error
        except Exception as error:
            kind = TypeError if "PySparkTypeError" in type(error).__name__ else RuntimeError
            raise kind(f"{self.name}: {error}") from error


@runtime_checkable
class TableLike(Protocol):
    """What operators ask of a declared table."""

    name: str

    @property
    def schema(self) -> T.StructType: ...

    def key(self) -> list[str]: ...

    def required_columns(self) -> list[str]: ...


@runtime_checkable
class FileTableLike(TableLike, Protocol):
    """A table that files are loaded into."""

    def file_columns(self) -> dict[str, str]: ...


@runtime_checkable
class SerializableLike(Protocol):
    """A row set that can be written as JSON and fingerprinted."""

    def key_of(self, row: Mapping[str, Any]) -> tuple: ...


class IdAllocator:
    """Counts up from the largest id in use."""

    def __init__(self, last: int = 0):
        self.last = int(last)

    def next(self) -> int:
        self.last += 1
        return self.last

    def reserve(self, n: int) -> range:
        """The next ``n`` ids."""
        if n < 0:
            raise ValueError("cannot reserve a negative number of ids")
        start, self.last = self.last + 1, self.last + n
        return range(start, self.last + 1)


def find_models(package: str) -> list[TableModel]:
    """Every model bound at the top of a module of ``package``, by name."""
    root = importlib.import_module(package)
    names = [package, *(m.name for m in pkgutil.walk_packages(getattr(root, "__path__", []), f"{package}."))]
    found = {id(v): v for name in names for v in vars(importlib.import_module(name)).values() if isinstance(v, TableModel)}
    return sorted(found.values(), key=lambda m: m.name)


def model_by_name(name: str, models: Iterable[TableModel]) -> TableModel | None:
    wanted = name.strip().lower()
    return next((m for m in models if m.name.lower() == wanted), None)
