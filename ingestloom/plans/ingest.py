"""The staged load: read, cast, filter, de-duplicate, stage, merge, switch."""

from __future__ import annotations

import logging
import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from ingestloom.model import TableModel
from ingestloom.operators import merge, quality
from ingestloom.plans.layout import manage_layout
from ingestloom.plans.settings import resolve_index_strategy
from ingestloom.plans.store import TableStore
from ingestloom.sources.readers import ROWNUM, CsvLoader, Loader, LoadOptions, check_file_name, choose_loader, require_columns

log = logging.getLogger(__name__)


@dataclass
class LoadResult:
    """Rows staged (not merged), failed casts, rows dropped for nulls, malformed rows left out, and seconds of each phase."""

    rows: int = 0
    stats: quality.CastStats | None = None
    nulls: dict[str, int] = field(default_factory=dict)
    malformed: int = 0
    phases: dict[str, float] = field(default_factory=dict)

    @contextmanager
    def phase(self, name: str) -> Iterator[None]:
        start = time.perf_counter()
        log.info("%s: begins", name)
        try:
            yield
        finally:
            self.phases[name] = time.perf_counter() - start
            log.info("%s: %.2f s", name, self.phases[name])


@contextmanager
def bulk_load(store: TableStore, *staging: str) -> Iterator[TableStore]:
    """Staging folders go, whatever happens; a table that was not switched stays as it was."""
    try:
        yield store
    finally:
        for name in staging:
            store.drop(name)


def prepare(df: DataFrame, options: LoadOptions) -> tuple[DataFrame, DataFrame]:
    """(cast rows with failure flags, rows to stage): cast, then filter, then the first row of each key."""
    model = options.model
    require_columns(model, df.columns)
    cast = quality.cast_rows(df, model, options.rules, options.normalise)
    rows = quality.drop_incomplete(quality.evaluated(quality.untracked(cast)), model.required_columns())
    if options.dedupe and model.primary_key:
        rows = quality.first_per_key(rows, model.key())
    return cast, rows


def load_file(spark: SparkSession, store: TableStore, model: TableModel, path: str, loader: Loader | None = None, **options) -> LoadResult:
    """Loads a file named after the table into it.

    Arguments are checked before anything is read. ``fast`` reads delimited
    text without null words, rules or de-duplication, and falls back to the
    usual path when that fails. Repeated keys in the staged rows are an error
    for every strategy but upsert, which takes the first. ``load`` names the load
    for stores that merge in steps: the same file loaded again under the name of a
    load that was stopped goes on behind its last step.
    """
    opts = LoadOptions(model, path, **options)
    check_file_name(model, path)
    merge.check_strategy(opts.merge_strategy)
    resolve_index_strategy(opts.index_strategy)
    if opts.quote_mode not in ("auto", "csv", "literal", "by_delimiter"):
        raise ValueError(f"unknown quote mode {opts.quote_mode!r}")
    result = LoadResult()
    if opts.merge_strategy == "insert_if_empty" and opts.load is None and not store.is_empty(model):
        raise ValueError("insert_if_empty needs an empty target")
    loader = loader or choose_loader(path)
    with bulk_load(store, opts.staging_name, f"{opts.staging_name}_cast"):
        with result.phase("stage"):
            staged = _stage(spark, store, loader, opts, result)
            result.malformed = getattr(loader, "malformed", 0)
            if result.malformed:
                log.warning("%s: %d malformed rows left out", model.name, result.malformed)
        if result.rows == 0:
            return result
        with result.phase("merge"):
            if opts.merge_strategy != "upsert" and model.primary_key:
                merge.check_unique(staged, model.key())
            with manage_layout(store, model, opts.index_strategy, opts.merge_batch_size):
                store.merge_rows(model, staged, opts.merge_strategy, opts.merge_batch_size, opts.load)
    return result


def _stage(spark: SparkSession, store: TableStore, loader: Loader, opts: LoadOptions, result: LoadResult) -> DataFrame:
    if opts.fast and isinstance(loader, CsvLoader):
        try:
            plain = replace(opts, normalise=False, dedupe=False, rules=None)
            return _stage_rows(store, loader.read(spark, plain), plain, result)
        except Exception as error:
            log.warning("%s: the fast path failed (%s); the usual path is taken", opts.model.name, error)
    return _stage_rows(store, loader.read(spark, opts), opts, result)


def _stage_rows(store: TableStore, source: DataFrame, opts: LoadOptions, result: LoadResult) -> DataFrame:
    require_columns(opts.model, source.columns)
    cast = quality.cast_rows(source, opts.model, opts.rules, opts.normalise)
    observed, seen = quality.observe_failures(cast, opts.model, opts.rules)
    kept = store.stage(f"{opts.staging_name}_cast", observed)  # the only pass over the file
    found = seen.get
    result.stats = quality.collect_stats(kept, found, opts.model, opts.rules)
    result.nulls = {k[len("null_") :]: v for k, v in found.items() if k.startswith("null_") and v}
    rows = quality.drop_incomplete(quality.untracked(kept), opts.model.required_columns())
    result.rows = found["complete"]
    if opts.dedupe and opts.model.primary_key:
        rows, counted = quality.observe_rows(quality.first_per_key(rows, opts.model.key()))
        rows = store.stage(opts.staging_name, rows)
        result.rows = counted.get["rows"]
    return rows


def staging_rows(spark: SparkSession, options: LoadOptions) -> DataFrame:
    """The rows that a load would stage, as a plan; nothing is written."""
    _, rows = prepare(choose_loader(options.path).read(spark, options), options)
    return rows.drop(ROWNUM)
