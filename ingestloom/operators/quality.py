"""Row quality: casts with failure counts, required values, first row of a key."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ingestloom.functions.casting import RECORDED_KINDS, ColumnRules, cast_column
from ingestloom.model import TableModel
from ingestloom.sources.readers import ROWNUM

EXAMPLES = 3
_FAILED = "_failed_"
_RAW = "_raw_"


@dataclass
class CastStats:
    """Failed casts by column: how many, and the first few inputs."""

    table: str
    counts: dict[str, int] = field(default_factory=dict)
    examples: dict[str, list[str]] = field(default_factory=dict)
    recorded: frozenset[str] = frozenset()

    @property
    def total(self) -> int:
        return sum(self.counts.values())

    @property
    def total_recorded(self) -> int:
        """Failures of integer columns and of columns with a rule only."""
        return sum(n for c, n in self.counts.items() if c in self.recorded)

    def to_dict(self) -> dict:
        return {"table": self.table, "total": self.total, "columns": {c: {"count": n, "examples": self.examples.get(c, [])} for c, n in self.counts.items() if n}}


def cast_rows(df: DataFrame, model: TableModel, rules: ColumnRules | None = None, normalise: bool = True, track: bool = True) -> DataFrame:
    """``df`` in the model's types; with ``track`` also a failure flag and the raw text of each column."""
    kinds = {f.name: f.dataType for f in df.schema}
    out: list[Column] = []
    for column in model.insertable:
        if column.name not in kinds:
            continue
        value, failed = cast_column(F.col(column.name), column, kinds[column.name], rules, model.name, normalise)
        out.append(value.alias(column.name))
        if track:
            out += [F.coalesce(failed, F.lit(False)).alias(_FAILED + column.name), F.when(failed, F.col(column.name).cast("string")).alias(_RAW + column.name)]
    return df.select(*out, *[c for c in (ROWNUM,) if c in kinds])


def observe_failures(cast: DataFrame, model: TableModel, rules: ColumnRules | None = None) -> tuple[DataFrame, Observation]:
    """The cast rows without their tracking columns, and an observation of counts that the next action fills."""
    seen = Observation()
    tracked = [c[len(_FAILED) :] for c in cast.columns if c.startswith(_FAILED)]
    required = [c for c in model.required_columns() if c in cast.columns]
    metrics = [F.count_if(F.col(_FAILED + c)).alias(f"failed_{c}") for c in tracked] + [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in required]
    complete = reduce(and_, [F.col(c).isNotNull() for c in required], F.lit(True))
    observed = cast.observe(seen, F.count("*").alias("rows"), F.count_if(complete).alias("complete"), *metrics)
    return observed, seen


def observe_rows(df: DataFrame) -> tuple[DataFrame, Observation]:
    """``df`` and an observation of its number of rows that the next action fills."""
    seen = Observation()
    return df.observe(seen, F.count("*").alias("rows")), seen


def untracked(cast: DataFrame) -> DataFrame:
    return cast.drop(*[c for c in cast.columns if c.startswith((_FAILED, _RAW))])


def evaluated(df: DataFrame) -> DataFrame:
    """``df`` with each column computed once a row; a filter would repeat the expressions of the columns that it reads."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.select(row.alias("_row")).select(F.inline_outer(F.array("_row")))


def failure_examples(cast: DataFrame, n: int = EXAMPLES) -> DataFrame:
    """column_name, nth and example: the first ``n`` inputs of every column that failed, in file order.

    One scan for all columns; of a column a task sends ``n`` rows at most.
    """
    tracked = [c[len(_FAILED) :] for c in cast.columns if c.startswith(_FAILED)]
    some = [F.when(F.col(_FAILED + c), F.struct(F.lit(c).alias("column_name"), F.col(ROWNUM).alias("_at"), F.col(_RAW + c).alias("example"))) for c in tracked]
    if not some:
        return cast.sparkSession.createDataFrame([], "column_name string, nth int, example string")
    failed = cast.select(F.explode(F.filter(F.array(*some), lambda x: x.isNotNull())).alias("x")).select("x.*")
    nth = F.row_number().over(Window.partitionBy("column_name").orderBy("_at"))
    return failed.withColumn("nth", nth).where(F.col("nth") <= n).select("column_name", "nth", "example")


def collect_stats(cast: DataFrame, seen: dict, model: TableModel, rules: ColumnRules | None = None) -> CastStats:
    counts = {k[len("failed_") :]: v for k, v in seen.items() if k.startswith("failed_")}
    recorded = frozenset(c.name for c in model.insertable if c.kind in RECORDED_KINDS or (rules and rules.get(model.name, c.name)))
    examples: dict[str, list[str]] = {}
    if any(counts.values()):
        for row in failure_examples(cast).orderBy("column_name", "nth").collect():  # EXAMPLES rows a column at most
            examples.setdefault(row.column_name, []).append(row.example)
    return CastStats(model.name, counts, examples, recorded)


def failure_table(cast: DataFrame) -> DataFrame:
    """column_name and n_failed for each column, in one pass over the rows."""
    tracked = [c[len(_FAILED) :] for c in cast.columns if c.startswith(_FAILED)]
    counts = cast.agg(*[F.count_if(F.col(_FAILED + c)).alias(c) for c in tracked])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_failed")) for c in tracked])).alias("x")).select("x.*")


def drop_incomplete(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Rows with a value in every required column."""
    present = [c for c in required if c in df.columns]
    return df.dropna(subset=present) if present else df


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column_name and n_null of each column."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_null")) for c in columns])).alias("x")).select("x.*")


def first_per_key(df: DataFrame, key: Sequence[str], order: Sequence[str | Column] = (ROWNUM,), keep_null_keys: bool = True) -> DataFrame:
    """The first row of each key; rows with a null in the key are all kept, or count as equal keys.

    Each of the kept rows is a window of its own: they share no key, one window
    would put them all in one task, and a further branch would read ``df`` again.
    """
    taken = {c.lower() for c in df.columns}
    number, alone = "_nth", "_alone"
    while number in taken:
        number += "_"
    while alone in taken:
        alone += "_"
    by = list(key)
    if keep_null_keys:
        incomplete = reduce(or_, [F.col(c).isNull() for c in key])
        df = df.withColumn(alone, F.when(incomplete, F.monotonically_increasing_id()))
        by.append(alone)
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn(number, nth).where(F.col(number) == 1).drop(number, alone)


def sorted_by_key(df: DataFrame, key: Sequence[str]) -> DataFrame:
    return df.orderBy(*key)
