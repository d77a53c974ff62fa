"""Files as DataFrames of a table's columns, in file order.

Every reader gives the model's columns that the file has and ``_rownum``, which
grows with the place of a row in its file; files follow in the order of paths.
"""

from __future__ import annotations

import csv
import io
import logging
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import accumulate
from pathlib import PurePosixPath
from typing import Protocol

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ingestloom.errors import IngestError
from ingestloom.functions.casting import ColumnRules
from ingestloom.model import TableModel
from ingestloom.sources import sniff, splits

log = logging.getLogger(__name__)
ROWNUM = "_rownum"
CORRUPT = "_corrupt_record"
_RECORD = "_record"


@dataclass(frozen=True)
class LoadOptions:
    """How a file is loaded into a table."""

    model: TableModel
    path: str | list[str]
    normalise: bool = True
    dedupe: bool = False
    quote_mode: str = "auto"
    merge_strategy: str = "replace"
    index_strategy: str = "auto"
    merge_batch_size: int | None = None
    chunksize: int | None = None
    staging_schema: str | None = None
    fast: bool = False
    rules: ColumnRules | None = None
    encoding: str | None = None
    delimiter: str | None = None
    load: str | None = None

    @property
    def staging_name(self) -> str:
        name = f"_staging_{self.model.name}"
        return f"{self.staging_schema}/{name}" if self.staging_schema else name


class Loader(Protocol):
    """A source of rows; implement it to load from elsewhere."""

    def read(self, spark: SparkSession, options: LoadOptions) -> DataFrame: ...


def normalise_header(names: Sequence[str], quotes: bool = True) -> list[str]:
    """Lower case, ``_hash`` removed wherever it stands, no quotes, no outer space; collisions are an error."""
    out = []
    for name in names:
        name = name.strip().strip('"') if quotes else name
        out.append(name.lower().replace("_hash", "").strip())
    repeated = sorted({n for n in out if out.count(n) > 1})
    if repeated:
        raise IngestError(f"header names collide after normalising: {repeated}")
    return out


def require_columns(model: TableModel, present: Sequence[str]) -> None:
    """Raises if a required column is not in the file."""
    missing = sorted(set(model.required_columns()) - set(present))
    if missing:
        raise IngestError(f"{model.name}: the file lacks required columns {', '.join(missing)}")


def project(df: DataFrame, model: TableModel) -> DataFrame:
    """The model's insertable columns that ``df`` has, renamed to the model's names, and ``_rownum``."""
    wanted = {header.lower(): name for header, name in model.file_columns().items()}
    extra = [c for c in df.columns if c not in wanted and c not in (ROWNUM, CORRUPT)]
    if extra:
        log.warning("%s: columns not in the model are dropped: %s", model.name, extra)
    kept = [F.col(f"`{c}`").alias(wanted[c]) for c in df.columns if c in wanted]
    return df.select(*kept, *[c for c in (ROWNUM,) if c in df.columns])


def _file_order(df: DataFrame) -> DataFrame:
    """Rows numbered by file, in the order of paths, and by their place in what a task reads."""
    at, path = F.monotonically_increasing_id().alias("_at"), F.col("_metadata.file_path").alias("_path")
    placed = df.select("*", at, path)
    files = df.select(at, path).groupBy("_path").agg(F.count("*").alias("n"), F.min("_at").alias("first_at")).orderBy("_path").collect()  # a row a file
    return _shifted(placed, [(f["_path"], f["n"], f["first_at"]) for f in files])


def _parquet_order(df: DataFrame) -> DataFrame:
    """Rows numbered by file, in the order of paths, and by their place in the file; only footers are read for it."""
    path = F.col("_metadata.file_path").alias("_path")
    files = df.select(path).groupBy("_path").agg(F.count("*").alias("n")).orderBy("_path").collect()  # a row a file
    return _shifted(df.select("*", F.col("_metadata.row_index").alias("_at"), path), [(f["_path"], f["n"], 0) for f in files])


def _shifted(placed: DataFrame, files: list[tuple[str, int, int]]) -> DataFrame:
    before = [0, *accumulate(n for _, n, _ in files)]
    shifts = placed.sparkSession.createDataFrame([(path, b - first) for (path, _, first), b in zip(files, before, strict=False)], "_path string, _shift long")
    return placed.join(shifts, "_path").withColumn(ROWNUM, F.col("_at") + F.col("_shift")).drop("_path", "_at", "_shift")


class CsvLoader:
    """Delimited text: sniffed and read as strings.

    With ``drop_malformed`` rows of more or fewer fields than the header are
    left out; ``malformed`` says how many once an action has read the rows.
    Files of a folder share one header. Files are split also where quotes hold line
    ends (``splits``); the encoding follows from all bytes. Only files in UTF-16 and
    UTF-32 are read whole, a file a task.
    """

    def __init__(self, drop_malformed: bool = False):
        self.drop_malformed = drop_malformed
        self._seen: Observation | None = None

    @property
    def malformed(self) -> int:
        """Rows left out by the last read, after an action on them."""
        return self._seen.get["malformed"] if self._seen is not None else 0

    def header(self, spark: SparkSession, options: LoadOptions) -> tuple[list[str], str, str, str, bytes]:
        """(normalised header, delimiter, encoding, quote mode, head)."""
        head = sniff.read_head(spark, options.path)
        encoding = options.encoding or sniff.infer_encoding(head)
        delimiter = options.delimiter or sniff.infer_delimiter(head, encoding)
        mode = sniff.resolve_quote_mode(options.quote_mode, head, delimiter, encoding)
        text = head.decode(encoding, "replace").lstrip("\ufeff")
        first = next(csv.reader(io.StringIO(text, newline=""), delimiter=delimiter, quoting=csv.QUOTE_NONE if mode == "literal" else csv.QUOTE_MINIMAL), [])
        return normalise_header(first), delimiter, encoding, mode, head

    def read_text(self, spark: SparkSession, options: LoadOptions) -> DataFrame:
        """All columns of the file as strings, with ``_rownum``."""
        names, delimiter, encoding, mode, head = self.header(spark, options)
        if not names:
            return spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in options.model.file_columns()] + [T.StructField(ROWNUM, T.LongType())]))
        if encoding.startswith(("utf-16", "utf-32")):  # a line feed is no single byte there
            return self._whole_files(spark, options, names, delimiter, encoding, mode)
        lines = splits.lines(spark, options.path, "\r" if b"\r" in head and b"\n" not in head else "\n")
        found = splits.survey(lines)
        encoding = splits.encoding_of(found, options.encoding)
        if mode == "csv" and any(s.quoted for s in found):
            records = splits.quoted_records(lines, found, delimiter, encoding, ROWNUM, _RECORD)
        else:
            records = splits.plain_records(lines, found, encoding, ROWNUM, _RECORD)
        fields = [f"c{k}" for k in range(len(names))]
        schema = T.StructType([T.StructField(f, T.StringType()) for f in fields] + [T.StructField(CORRUPT, T.StringType())] * self.drop_malformed)
        parse = {"sep": delimiter, "multiLine": "true", "mode": "PERMISSIVE", "quote": "" if mode == "literal" else '"', "escape": "\\" if mode == "literal" else '"'}
        parse |= {"columnNameOfCorruptRecord": CORRUPT} if self.drop_malformed else {}
        row = F.from_csv(_RECORD, schema.simpleString()[len("struct<") : -1].replace(":", " "), parse)
        # as the row of a generator a record is parsed once: filters on its columns would repeat an expression wherever they mention it
        parsed = records.select(ROWNUM, F.inline_outer(F.array(row)))
        df = parsed.select(*[F.col(f).alias(n) for f, n in zip(fields, names, strict=True)], *[F.col(CORRUPT)] * self.drop_malformed, ROWNUM)
        if self.drop_malformed:
            self._seen = Observation()
            df = df.observe(self._seen, F.count_if(F.col(CORRUPT).isNotNull()).alias("malformed"))
            df = df.where(F.col(CORRUPT).isNull()).drop(CORRUPT)
        return df

    def _whole_files(self, spark: SparkSession, options: LoadOptions, names: list[str], delimiter: str, encoding: str, mode: str) -> DataFrame:
        """Wide encodings: a task reads a whole file, so a file's rows are in order; files count by their paths."""
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names] + [T.StructField(CORRUPT, T.StringType())] * self.drop_malformed)
        reader = spark.read.option("header", True).option("sep", delimiter).option("encoding", encoding).option("enforceSchema", True).option("multiLine", True)
        reader = reader.option("quote", "" if mode == "literal" else '"').option("escape", "\\" if mode == "literal" else '"').option("columnNameOfCorruptRecord", CORRUPT)
        df = _file_order(reader.schema(schema).csv(options.path))
        if self.drop_malformed:
            self._seen = Observation()
            df = df.observe(self._seen, F.count_if(F.col(CORRUPT).isNotNull()).alias("malformed"))
            df = df.where(F.col(CORRUPT).isNull()).drop(CORRUPT)
        return df

    def read(self, spark: SparkSession, options: LoadOptions) -> DataFrame:
        df = self.read_text(spark, options)
        return project(df, options.model)


class ParquetLoader:
    """Parquet files; delimited text by its suffix; nothing else."""

    def __init__(self):
        self._text: CsvLoader | None = None

    @property
    def malformed(self) -> int:
        return self._text.malformed if self._text else 0

    def read(self, spark: SparkSession, options: LoadOptions) -> DataFrame:
        suffix = PurePosixPath(options.path).suffix.lower()
        if suffix in (".csv", ".tsv"):
            self._text = CsvLoader(drop_malformed=True)
            return self._text.read(spark, options)
        if suffix != ".parquet":
            raise ValueError(f"Unsupported file type: {suffix or options.path}")
        df = _parquet_order(spark.read.parquet(options.path))
        return project(df.toDF(*normalise_header(df.columns[:-1], quotes=False), ROWNUM), options.model)


def choose_loader(path: str) -> Loader:
    """Parquet by suffix; everything else is delimited text."""
    return ParquetLoader() if PurePosixPath(path).suffix.lower() == ".parquet" else CsvLoader()


def check_file_name(model: TableModel, path: str) -> None:
    stem = PurePosixPath(path).stem.lower()
    if stem != model.name.lower():
        raise ValueError(f"file {stem!r} does not belong to table {model.name!r}")
