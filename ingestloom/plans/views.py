"""Derived views kept as tables and refreshed in the order of their dependencies."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ingestloom.plans.settings import Capabilities
from ingestloom.plans.store import TableStore


@dataclass(frozen=True)
class MaterializedView:
    """A name, a DataFrame function or SQL text, and the names of the views and tables it reads."""

    name: str
    build: Callable[[SparkSession], DataFrame] | str
    depends_on: tuple[str, ...] = ()

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.sql(self.build) if isinstance(self.build, str) else self.build(spark)


def refresh_order(views: Sequence[MaterializedView]) -> list[MaterializedView]:
    """Views after all views that they read, otherwise in the given order; names that are no views are ignored."""
    waiting, known, done = list(views), {v.name for v in views}, set()
    order: list[MaterializedView] = []
    while waiting:
        ready = [v for v in waiting if all(d in done or d not in known for d in v.depends_on)]
        if not ready:
            raise RuntimeError(f"views depend on each other in a circle: {sorted(v.name for v in waiting)}")
        order += ready
        done |= {v.name for v in ready}
        waiting = [v for v in waiting if v.name not in done]
    return order


class ViewStore:
    """Views written to a store; each is registered under its name for others to read."""

    def __init__(self, spark: SparkSession, store: TableStore, capabilities: Capabilities | None = None):
        self.spark, self.store = spark, store
        self.capabilities = capabilities or Capabilities()

    def create(self, view: MaterializedView) -> None:
        """Computes the view if it does not exist."""
        self.capabilities.require("materialized_views")
        if not self.store.exists(view.name):
            self.store.write_rows(view.name, view.rows(self.spark))
        self.read(view).createOrReplaceTempView(view.name)

    def refresh(self, view: MaterializedView) -> None:
        """Computes the view anew; it must exist."""
        self.capabilities.require("materialized_views")
        if not self.store.exists(view.name):
            raise ValueError(f"view {view.name} does not exist")
        self.store.write_rows(view.name, view.rows(self.spark))
        self.read(view).createOrReplaceTempView(view.name)

    def refresh_all(self, views: Iterable[MaterializedView]) -> list[str]:
        order = refresh_order(list(views))
        for view in order:
            self.refresh(view)
        return [v.name for v in order]

    def read(self, view: MaterializedView) -> DataFrame:
        if not self.store.exists(view.name):
            raise ValueError(f"view {view.name} does not exist")
        return self.store.read_rows(view.name)
