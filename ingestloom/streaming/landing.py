"""Files that arrive in a folder, merged as they come.

An extension: each micro-batch goes through the same reader, casts, filters and
merges as a single file. The stream itself carries only the names of new files;
their contents are read in the batch, under each file's own header.
"""

from __future__ import annotations

import logging
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ingestloom.functions.casting import ColumnRules
from ingestloom.model import TableModel
from ingestloom.operators import merge, quality
from ingestloom.plans.store import VersionedStore
from ingestloom.sources.readers import CsvLoader, LoadOptions, require_columns

log = logging.getLogger(__name__)

#: Files of a micro-batch at most; their headers are read on the driver.
MAX_FILES = 1_000


def watch(spark: SparkSession, store: VersionedStore, model: TableModel, folder: str, checkpoint: str, merge_strategy: str = "upsert", sep: str = ",", rules: ColumnRules | None = None, quote_mode: str = "csv") -> StreamingQuery:
    """Starts a query that merges every CSV file of ``folder`` once, then ends.

    Columns are taken by the names in a file's header, in any order; a file that
    lacks a required column stops the query. Rows with a null in the key are
    left out.
    """
    merge.check_strategy(merge_strategy)
    names = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", MAX_FILES).load(folder).select("path")

    def read(paths: list[str]) -> DataFrame:
        """The files' rows, read together where their headers agree."""
        alike: dict[tuple, list[str]] = defaultdict(list)
        for path in paths:
            header, *_ = CsvLoader().header(spark, LoadOptions(model, path, delimiter=sep, quote_mode=quote_mode))
            if header:  # an empty file has no rows
                alike[tuple(header)].append(path)
        parts = []
        for header, some in sorted(alike.items()):
            rows = CsvLoader().read(spark, LoadOptions(model, sorted(some), delimiter=sep, quote_mode=quote_mode))
            require_columns(model, rows.columns)
            parts.append(quality.cast_rows(rows, model, rules, track=False))
        out = parts[0] if parts else None
        for part in parts[1:]:
            out = out.unionByName(part, allowMissingColumns=True)
        return out

    def apply(batch: DataFrame, _: int) -> None:
        cast = read([r.path for r in batch.collect()])
        if cast is None:
            return
        rows = quality.drop_incomplete(cast, [*model.required_columns(), *model.key()])
        with_first = store.stage(f"_staging_{model.name}", quality.first_per_key(rows, model.key(), keep_null_keys=False))
        target = store.read(model).drop(*[c.name for c in model.columns if c.computed is not None])
        store.write(model, merge.plan(target, with_first, model.key(), merge_strategy, store.is_empty(model)))
        store.drop(f"_staging_{model.name}")

    return names.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
