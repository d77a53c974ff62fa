"""Rows as canonical JSON, and their fingerprints.

The canonical form is compact JSON with sorted keys and ISO dates; it is the
same on every partition and run.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F


def chosen_columns(columns: Iterable[str], only: Iterable[str] | None = None, exclude: Iterable[str] | None = None) -> list[str]:
    """Sorted names; an empty ``only`` or ``exclude`` counts as not given."""
    only, exclude = set(only or ()), set(exclude or ())
    return sorted(c for c in columns if (not only or c in only) and c not in exclude)


def row_json(columns: Iterable[str], include_nulls: bool = True, only: Iterable[str] | None = None, exclude: Iterable[str] | None = None) -> Column:
    """One row as a JSON object."""
    options = {"ignoreNullFields": str(not include_nulls).lower(), "dateFormat": "yyyy-MM-dd", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"}
    return F.to_json(F.struct(*chosen_columns(columns, only, exclude)), options)


def row_fingerprint(columns: Iterable[str], only: Iterable[str] | None = None, exclude: Iterable[str] | None = None) -> Column:
    """SHA-256 of a row's JSON with nulls, in hexadecimal."""
    return F.sha2(row_json(columns, True, only, exclude), 256)


def row_map(df: DataFrame, only: Iterable[str] | None = None, exclude: Iterable[str] | None = None, include_nulls: bool = False) -> Column:
    """One row as a map of text values."""
    names = chosen_columns(df.columns, only, exclude)
    whole = F.create_map(*[x for c in names for x in (F.lit(c), F.col(c).cast("string"))])
    return whole if include_nulls else F.map_filter(whole, lambda _, v: v.isNotNull())


def row_dict(row: Row, include_nulls: bool = False, only: Iterable[str] | None = None, exclude: Iterable[str] | None = None) -> dict[str, Any]:
    """A collected row as a dictionary."""
    values = row.asDict()
    names = chosen_columns(values, only, exclude)
    return {k: values[k] for k in values if k in names and (include_nulls or values[k] is not None)}


def row_items(row: Row) -> list[tuple[str, Any]]:
    """The name and value of each field that is not null."""
    return list(row_dict(row).items())
