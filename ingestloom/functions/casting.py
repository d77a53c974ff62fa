"""Typed casts of text as expressions that never fail.

``cast_column`` gives two expressions for a column: the value, and whether a
non-null input could not be cast. Rules for single columns are kept in a
``ColumnRules`` object: an enumeration's values, a Column function (preferred),
or a scalar Python function, which runs over Arrow batches.
"""

from __future__ import annotations

import enum
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ingestloom.functions.datetimes import free_datetime, iso_datetime
from ingestloom.functions.nulls import null_if_sentinel, strip
from ingestloom.model import SPARK_TYPES, ColumnModel

_NUMERIC = r"^[+-]?\d+(\.\d+)?$"
_INTEGRAL = r"^[+-]?\d+(\.0+)?$"

# Date layouts in the order they are tried, and the shape that a text must have for each.
DATE_LAYOUTS = (
    (r"^\d{8}$", "yyyyMMdd"),
    (r"^\d{1,2}-[A-Za-z]{3}-\d{4}$", "d-MMM-yyyy"),
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
)


def canonical_number(text: Column) -> Column:
    """Numeric text without plus sign, leading zeros and trailing fraction zeros; other text unchanged."""
    plain = F.regexp_replace(text, r"^\+", "")
    plain = F.regexp_replace(plain, r"^(-?)0+(?=\d)", "$1")
    plain = F.when(F.contains(plain, F.lit(".")), F.regexp_replace(F.regexp_replace(plain, r"0+$", ""), r"\.$", "")).otherwise(plain)
    plain = F.when(plain == "-0", "0").otherwise(plain)
    return F.when(text.rlike(_NUMERIC), plain).otherwise(text)


def to_integer(text: Column) -> Column:
    """Whole numbers, also written with a zero fraction; null for all else, and beyond 64 bits."""
    trimmed = strip(text)
    return F.when(trimmed.rlike(_INTEGRAL), F.regexp_extract(trimmed, r"^\+?(-?\d+)", 1).try_cast("bigint"))


def to_float(text: Column) -> Column:
    value = strip(text).try_cast("double")
    return F.when(~F.isnan(value), value)


def to_boolean(text: Column) -> Column:
    word = F.lower(strip(text))
    return F.when(word.isin("true", "t", "yes", "y", "1"), True).when(word.isin("false", "f", "no", "n", "0"), False)


def to_date(text: Column) -> Column:
    """The first layout that fits; text is not trimmed, and a time of day makes it no date."""
    return F.coalesce(*[F.when(text.rlike(shape), F.try_to_date(text, layout)) for shape, layout in DATE_LAYOUTS])


def to_datetime(text: Column) -> Column:
    """ISO date-times, else dates at midnight, else an ISO date beside a time in free spelling; zones are dropped."""
    return F.coalesce(iso_datetime(text), to_date(text).cast("timestamp_ntz"), free_datetime(text))


def to_text(text: Column, length: int | None = None, canonical: bool = True) -> Column:
    """Trimmed text, numbers in canonical form, cut to ``length``; blank is null."""
    trimmed = strip(text)
    value = canonical_number(trimmed) if canonical else trimmed
    value = F.when(value != "", value)
    return F.substring(value, 1, length) if length else value


_TEXT_CASTS: dict[str, Callable[[Column], Column]] = {"integer": to_integer, "float": to_float, "boolean": to_boolean, "date": to_date, "datetime": to_datetime}
#: Kinds whose failures the strictest counter holds; the others become null with no record there.
RECORDED_KINDS = frozenset({"integer"})


@dataclass
class ColumnRules:
    """Cast rules for single columns, by (table, column)."""

    rules: dict[tuple[str, str], tuple[str, Any]] = field(default_factory=dict)

    def register(self, table: str, column: str, scalar: Callable[[Any], Any] | None = None, *, enum_type: type[enum.Enum] | None = None, expression: Callable[[Column], Column] | None = None) -> None:
        """Exactly one rule; a later registration replaces an earlier one."""
        given = {k: v for k, v in (("scalar", scalar), ("enum", enum_type), ("expression", expression)) if v is not None}
        if len(given) != 1:
            raise ValueError("give exactly one of scalar, enum_type and expression")
        self.rules[table, column] = next(iter(given.items()))

    def get(self, table: str, column: str) -> tuple[str, Any] | None:
        return self.rules.get((table, column))


def enum_name(text: Column, enum_type: type[enum.Enum]) -> Column:
    """The member's name for its value (or its name, if it is a member already); null for all else."""
    names = {str(m.value).strip(): m.name for m in enum_type}
    pairs = [F.lit(x) for pair in names.items() for x in pair]
    word = strip(text.cast("string"))
    if all(isinstance(m.value, int) for m in enum_type):  # 2.0 is the member of value 2
        word = F.coalesce(to_integer(word).cast("string"), word)
    return F.try_element_at(F.create_map(*pairs), word) if pairs else F.lit(None).cast("string")


def _scalar_rule(function: Callable[[Any], Any], kind: T.DataType) -> Callable[[Column], Column]:
    schema = T.StructType([T.StructField("value", kind), T.StructField("failed", T.BooleanType())])

    def call(value):
        if value is None:
            return None, False
        try:
            return function(value), False
        except Exception:
            return None, True

    return F.udf(call, schema, useArrow=True)


def cast_column(source: Column, model: ColumnModel, source_type: T.DataType | None = None, rules: ColumnRules | None = None, table: str = "", normalise: bool = True) -> tuple[Column, Column]:
    """(value, failed) for a column of a file; ``failed`` is true where a non-null input has no value.

    Text is cast by the model's type; other input is cast by Spark where the
    kinds differ. A registered rule comes first. Types that are not logical
    types pass through.
    """
    source_type = source_type or T.StringType()
    is_text = isinstance(source_type, T.StringType)
    value = null_if_sentinel(source, source_type) if normalise else (F.when(source != "", source) if is_text else source)
    rule = rules.get(table, model.name) if rules else None
    if rule is not None:
        kind, what = rule
        if kind == "enum":
            out = enum_name(value, what)
        elif kind == "expression":
            out = what(value)
        else:
            result = _scalar_rule(what, model.spark_type)(value)
            return result["value"], F.coalesce(result["failed"], F.lit(False))
        return out, value.isNotNull() & out.isNull()
    if not isinstance(model.kind, str):
        return value, F.lit(False)
    if model.kind == "string":
        out = to_text(value.cast("string"), model.length, model.canonical)
    elif is_text:
        out = _TEXT_CASTS[model.kind](value)
    elif model.kind == "integer" and isinstance(source_type, (T.DoubleType, T.FloatType)):
        out = F.when(value == F.floor(value), value.try_cast("bigint"))
    elif model.kind == "boolean" and isinstance(source_type, T.NumericType):
        out = F.when(value == 1, True).when(value == 0, False)
    else:
        out = value.try_cast(SPARK_TYPES[model.kind])
    return out, value.isNotNull() & out.isNull()


def cast_value(spark, value: Any, model: ColumnModel, rules: ColumnRules | None = None, table: str = "", on_error: Callable[[Any], None] | None = None) -> Any:
    """One driver-side value by the same expressions; ``on_error`` is told of a failure."""
    kind = {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType()}.get(type(value), T.StringType())
    text = value.name if isinstance(value, enum.Enum) else value if value is None or not isinstance(kind, T.StringType) else str(value)
    if isinstance(value, enum.Enum) and rules and rules.get(table, model.name):
        return value.name
    frame = spark.createDataFrame([(text,)], T.StructType([T.StructField("v", kind)]))
    out, failed = cast_column(F.col("v"), model, kind, rules, table)
    row = frame.select(out.alias("out"), failed.alias("failed")).first()
    if row.failed and on_error:
        on_error(value)
    return row.out
