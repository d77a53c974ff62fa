"""Loaders of one's own as Python data sources, which Spark plans and reads in pieces.

A subclass of ``RecordSource`` names its columns, says what pieces its input has
and reads one piece as Arrow batches of text. ``spark.read`` and
``spark.readStream`` take it by its name once it is registered, and
``SourceLoader`` puts it into a load. ``FixedWidthSource`` is one: records of one
length, cut without a look into the files.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ingestloom.errors import IngestError
from ingestloom.sources.readers import ROWNUM, LoadOptions, normalise_header, project


@dataclass
class Piece(InputPartition):
    """A range of bytes of a file, and how many records stand before it in all files."""

    path: str
    start: int
    length: int
    first: int


class RecordSource(DataSource):
    """Rows of text under ``columns()``, in pieces; ``path`` is an option that Spark fills in."""

    def columns(self) -> list[str]:
        raise NotImplementedError

    def files(self) -> list[tuple[str, int]]:
        """(path, bytes) of all files of the input, in the order of paths; hidden ones are none."""
        path = self.options["path"]
        try:
            system, place = pafs.FileSystem.from_uri(path)
            found = system.get_file_info(pafs.FileSelector(place, recursive=True)) if system.get_file_info(place).type == pafs.FileType.Directory else [system.get_file_info(place)]
        except OSError as error:
            raise IngestError(f"{path} cannot be listed: {error}") from error
        if any(f.type == pafs.FileType.NotFound for f in found):
            raise IngestError(f"{path} does not exist")
        return sorted((f.path, f.size) for f in found if f.type == pafs.FileType.File and not f.base_name.startswith(("_", ".")))

    def pieces(self, files: Sequence[tuple[str, int]], first: int = 0) -> list[Piece]:
        """Pieces of files, of which the records before ``first`` are known to stand ahead."""
        raise NotImplementedError

    def records(self, files: Sequence[tuple[str, int]]) -> int:
        """How many records files hold."""
        raise NotImplementedError

    def batches(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        raise NotImplementedError

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c, T.StringType()) for c in self.columns()] + [T.StructField(ROWNUM, T.LongType())])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self)

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return _StreamReader(self)

    def numbered(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        """The piece's batches with row numbers in the order of files."""
        at = piece.first
        for batch in self.batches(piece):
            numbers = pa.array(np.arange(at, at + batch.num_rows, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, numbers], names=[*self.columns(), ROWNUM])
            at += batch.num_rows


class _Reader(DataSourceReader):
    def __init__(self, source: RecordSource):
        self.source = source

    def partitions(self) -> Sequence[Piece]:
        return self.source.pieces(self.source.files()) or [Piece("", 0, 0, 0)]

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        return self.source.numbered(piece) if piece.length else iter(())


class _StreamReader(DataSourceStreamReader):
    """Files by ascending names: an offset is the last name taken, and the files and records up to it.

    A file that arrives under a name before the offset's would never be read; it
    is an error. Files that were read may go.
    """

    def __init__(self, source: RecordSource):
        self.source = source

    def initialOffset(self) -> dict:
        return {"last": "", "files": 0, "records": 0}

    def latestOffset(self) -> dict:
        files = self.source.files()
        return {"last": files[-1][0] if files else "", "files": len(files), "records": self.source.records(files)}

    def partitions(self, start: dict, end: dict) -> Sequence[Piece]:
        files = self.source.files()
        if sum(path <= start["last"] for path, _ in files) > start["files"]:
            raise IngestError(f"a file arrived under a name before {start['last']}, up to which the stream has read")
        return self.source.pieces([f for f in files if start["last"] < f[0] <= end["last"]], start["records"]) or [Piece("", 0, 0, 0)]

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        return self.source.numbered(piece) if piece.length else iter(())


class FixedWidthSource(RecordSource):
    """Records of ``recordBytes`` bytes; ``layout`` is ``name:start:stop`` a column, comma-separated, in bytes from 0.

    Values are UTF-8 without outer spaces; empty ones stay empty text. A file that
    is no whole number of records, or a value that is no UTF-8, is an error.
    ``pieceBytes`` (64 MB) is the most that a task reads at a time.
    """

    BATCH_RECORDS = 1 << 14

    @classmethod
    def name(cls) -> str:
        return "fixed_width"

    def _layout(self) -> list[tuple[str, int, int]]:
        out = []
        for field in self.options["layout"].split(","):
            name, start, stop = field.strip().rsplit(":", 2)
            if not 0 <= int(start) < int(stop) <= self._length():
                raise IngestError(f"column {name!r} does not lie within a record")
            out.append((name, int(start), int(stop)))
        return out

    def _length(self) -> int:
        return int(self.options["recordbytes"])

    def columns(self) -> list[str]:
        return [name for name, _, _ in self._layout()]

    def records(self, files: Sequence[tuple[str, int]]) -> int:
        return sum(size for _, size in files) // self._length()

    def pieces(self, files: Sequence[tuple[str, int]], first: int = 0) -> list[Piece]:
        length = self._length()
        step = max(1, int(self.options.get("piecebytes", 64 << 20)) // length) * length
        out = []
        for path, size in files:
            if size % length:
                raise IngestError(f"{path}: {size} bytes are no whole number of records of {length}")
            out += [Piece(path, at, min(step, size - at), first + at // length) for at in range(0, size, step)]
            first += size // length
        return out

    def batches(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        length, layout = self._length(), self._layout()
        system, _ = pafs.FileSystem.from_uri(self.options["path"])
        with system.open_input_file(piece.path) as stream:
            stream.seek(piece.start)
            left = piece.length
            while left:
                buffer = stream.read_buffer(min(left, self.BATCH_RECORDS * length))
                if not buffer.size or buffer.size % length:
                    raise IngestError(f"{piece.path} has become shorter")
                left -= buffer.size
                records = pa.Array.from_buffers(pa.binary(length), buffer.size // length, [None, buffer]).cast(pa.binary())
                try:
                    values = [pc.utf8_trim(pc.binary_slice(records, start, stop).cast(pa.string()), " \r\n") for _, start, stop in layout]
                except pa.ArrowInvalid as error:
                    raise IngestError(f"{piece.path}: {error}") from error
                yield pa.RecordBatch.from_arrays(values, names=[name for name, _, _ in layout])


class SourceLoader:
    """A registered source as the loader of a load."""

    def __init__(self, source: type[RecordSource], **options: str | int):
        self.source, self.options = source, options

    def frame(self, spark: SparkSession, path: str) -> DataFrame:
        spark.dataSource.register(self.source)
        return spark.read.format(self.source.name()).options(**self.options).load(path)

    def stream(self, spark: SparkSession, path: str) -> DataFrame:
        """The same rows as files arrive."""
        spark.dataSource.register(self.source)
        return spark.readStream.format(self.source.name()).options(**self.options).load(path)

    def read(self, spark: SparkSession, options: LoadOptions) -> DataFrame:
        if not isinstance(options.path, str):
            raise ValueError("a source takes one path")
        df = self.frame(spark, options.path)
        return project(df.toDF(*normalise_header(df.columns[:-1]), ROWNUM), options.model)
