"""Null sentinels, as expressions and for driver-side values."""

from __future__ import annotations

import math
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What stands for null in text, trimmed and in lower case.
NULL_WORDS = ("", "null", "none", "na", "n/a", "nan")
#: White space that is trimmed from text before it is read.
SPACE = " \t\n\r\x0b\x0c"


def strip(column: Column) -> Column:
    """Text without white space at either end."""
    return F.btrim(column, F.lit(SPACE))


def null_if_sentinel(column: Column, kind: T.DataType | None = None) -> Column:
    """Null for sentinels and NaN; any other value unchanged, spaces included."""
    if kind is None or isinstance(kind, T.StringType):
        return F.when(~F.lower(strip(column)).isin(*NULL_WORDS), column)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(column), column)
    return column


def is_null_value(value: Any) -> bool:
    """Whether a driver-side value stands for null."""
    if value is None:
        return True
    if isinstance(value, float):
        return math.isnan(value)
    if isinstance(value, str):
        return value.strip().lower() in NULL_WORDS
    return type(value).__name__ in ("NAType", "NaTType")
