"""Index strategies as file layout.

A model's first index orders its files: rows are clustered by ranges of its
columns and sorted within each file, so that a lookup reads the row groups whose
range holds the value. Key columns follow the index in the order, so a value
that many rows share is spread over several ranges. The columns of further
indexes get Bloom filters in the files, which lookups of single values consult.

``keep`` lays every version out as it is written; ``drop_rebuild`` writes what a
block changes plainly and lays it out once at the block's end, also where the
block failed after a write. ``auto`` is ``keep``. Stores without such a layout
(buckets, catalog: sorted by key) take any strategy and stay as they are.

Defined results: nulls in indexed columns come first in the order; an empty table
is one empty file; a table without indexes, or one that does not exist, is left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame

from ingestloom.model import TableModel
from ingestloom.plans.settings import resolve_index_strategy


@runtime_checkable
class LaidOut(Protocol):
    """A store whose versions may be clustered by a model's indexes."""

    plain: set[str]

    def is_laid_out(self, model: TableModel) -> bool: ...

    def rebuild(self, model: TableModel, max_records_per_file: int | None = None) -> None: ...


def layout_order(model: TableModel) -> list[str]:
    """Columns in whose order the files of a model stand: its first index, then its key."""
    return list(dict.fromkeys((*model.indexes[0], *model.primary_key))) if model.indexes else []


def filtered_columns(model: TableModel) -> list[str]:
    """Columns of further indexes, which have Bloom filters."""
    return list(dict.fromkeys(c for index in model.indexes[1:] for c in index))


def clustered(df: DataFrame, model: TableModel) -> DataFrame:
    """Rows by ranges of the layout's order, sorted within each."""
    order = layout_order(model)
    return df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df


def writer_options(model: TableModel) -> dict[str, str]:
    return {f"parquet.bloom.filter.enabled#{column}": "true" for column in filtered_columns(model)}


@contextmanager
def manage_layout(store: object, model: TableModel, strategy: str = "auto", max_records_per_file: int | None = None) -> Iterator[None]:
    """A block of writes to a model's table under an index strategy."""
    if resolve_index_strategy(strategy) != "drop_rebuild" or not model.indexes or not isinstance(store, LaidOut) or model.name in store.plain:
        yield
        return
    store.plain.add(model.name)
    try:
        yield
    finally:
        store.plain.discard(model.name)
        if not store.is_laid_out(model):
            store.rebuild(model, max_records_per_file)
