"""Descriptors of stored tables: what is in them, not what a model declares.

Columns and types come from a table's schema (Parquet footers). A column is
nullable if a null was seen. A key is the named one if its columns hold neither
nulls nor repeats, else the first single column that does; a reference holds if
no row's value lacks a parent. Each table is scanned once for nulls and
estimates of different values; exact counts are made only for columns that the
estimate leaves as a key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ingestloom.model import ColumnModel, TableModel
from ingestloom.operators import merge, references
from ingestloom.registry.specs import ModelDescriptor

#: Columns of a frame of observed models; the first six are those of a declared one's frame.
OBSERVED = "table string, field string, nullable boolean, is_pk boolean, fk_table string, fk_field string, kind string"
#: A column whose estimated number of different values is below this share of its rows is no key; the estimate is off by a few hundredths.
LEAST_DIFFERENT = 0.8

#: The kinds that each kind can be read as without loss, itself aside.
_WIDER = {"boolean": {"integer", "float", "string"}, "integer": {"float", "string"}, "float": {"string"}, "date": {"datetime", "string"}, "datetime": {"string"}, "string": set()}


def kind_of(stored: T.DataType) -> str:
    """The logical kind of a stored type; the type's own name where there is none."""
    for kind, types in (
        ("boolean", T.BooleanType), ("integer", (T.ByteType, T.ShortType, T.IntegerType, T.LongType)), ("float", (T.FloatType, T.DoubleType, T.DecimalType)),
        ("date", T.DateType), ("datetime", (T.TimestampType, T.TimestampNTZType)), ("string", (T.StringType, T.CharType, T.VarcharType)),
    ):
        if isinstance(stored, types):
            return kind
    return stored.simpleString()


def fits(stored: str, declared: str) -> bool:
    """Whether every value of the stored kind has one of the declared kind."""
    return stored == declared or declared in _WIDER.get(stored, ())


def common_kind(*kinds: str) -> str | None:
    """The narrowest kind that all kinds fit; none for kinds that nothing holds together."""
    candidates = [k for k in _WIDER if all(fits(x, k) for x in kinds)]
    return min(candidates, key=lambda k: len(_WIDER) - len(_WIDER[k])) if candidates else None


def is_key(df: DataFrame, columns: Sequence[str]) -> bool:
    """Whether no row has a null in ``columns`` and no two rows agree in all."""
    return set(columns) <= set(df.columns) and df.where(" or ".join(f"`{c}` is null" for c in columns)).isEmpty() and merge.repeated_keys(df, columns).isEmpty()


def describe_table(name: str, df: DataFrame, key: Sequence[str] = ()) -> TableModel:
    """The model that the stored rows fit."""
    plain = [f.name for f in df.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    found = df.agg(F.count("*").alias("n"), *[F.count(F.col(f"`{c}`")).alias(f"known {k}") for k, c in enumerate(df.columns)], *[F.approx_count_distinct(F.col(f"`{c}`")).alias(f"different {k}") for k, c in enumerate(plain)]).first()
    whole = {c for k, c in enumerate(df.columns) if found[f"known {k}"] == found["n"]}
    likely = [c for k, c in enumerate(plain) if c in whole and found[f"different {k}"] >= LEAST_DIFFERENT * found["n"]]
    held: tuple[str, ...] = ()
    for columns in ([tuple(key)] if key else []) + [(c,) for c in likely]:
        if found["n"] and set(columns) <= whole and is_key(df, columns):
            held = columns
            break
    kinds = {f.name: kind_of(f.dataType) for f in df.schema}
    return TableModel(name, tuple(ColumnModel(c, kinds[c] if kinds[c] in _WIDER else df.schema[c].dataType, nullable=c not in whole) for c in df.columns), held)


def describe_tables(tables: Mapping[str, DataFrame], keys: Mapping[str, Sequence[str]] | None = None, links: Mapping[tuple[str, str], tuple[str, str]] | None = None) -> list[TableModel]:
    """Models of all tables; ``links`` (table, column) to (table, column) become references where they hold."""
    out = []
    for name, df in tables.items():
        model = describe_table(name, df, (keys or {}).get(name, ()))
        held = {}
        for (child, column), (parent, target) in (links or {}).items():
            if child == name and parent in tables and references.orphans(df.select(column), tables[parent].select(target), {column: target}).isEmpty():
                held[column] = (parent, target)
        out.append(TableModel(model.name, model.columns, model.primary_key, held))
    return out


def observed_frame(spark: SparkSession, models: Sequence[TableModel]) -> DataFrame:
    """A row a column of the models."""
    rows = [(m.name, c.name, bool(c.nullable), c.name in m.primary_key, *(m.foreign_keys.get(c.name) or (None, None)), c.kind if isinstance(c.kind, str) else c.kind.simpleString()) for m in models for c in m.columns]
    return spark.createDataFrame(rows, OBSERVED)


def type_differences(observed: Sequence[TableModel], declared: Sequence[TableModel]) -> list[tuple[str, str, str, str]]:
    """(table, column, stored kind, declared kind) of columns whose stored values the declared kind cannot hold, or that are missing."""
    known = {m.name: m.by_name for m in observed}
    out = []
    for model in declared:
        for column in model.insertable:
            if model.name not in known or not isinstance(column.kind, str):
                continue
            stored = known[model.name].get(column.name)
            kind = "absent" if stored is None else stored.kind if isinstance(stored.kind, str) else stored.kind.simpleString()
            if not fits(kind, column.kind):
                out.append((model.name, column.name, kind, column.kind))
    return out


def observed_descriptors(models: Sequence[TableModel]) -> list[ModelDescriptor]:
    return [ModelDescriptor.of(m) for m in models]
