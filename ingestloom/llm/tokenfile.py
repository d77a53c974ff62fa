"""Token ids of whole texts as compressed binary files, in the order of doc_id.

``write_tokens`` encodes texts with a ``tokenizers`` file, puts an end id after
each, deals them into ranges of doc_id, counts all ids of the corpus for one
shared table, and writes blocks coded by that table (``rans``). A folder holds

* ``blocks/*.rtk``: blocks after each other, each behind its length as an
  unsigned 64-bit integer,
* ``table``: id, count and share of every id (Parquet),
* ``manifest``: range, number, file, place and sizes of every block (Parquet).

Blocks decode independently. Files that a lost task left are in no manifest.
The folder has to be one that every executor reaches; it is opened with Arrow's
file systems (local and mounted paths, HDFS, S3, GCS by their URI).

Defined results: null text is empty and gives only the end id. Null doc_ids
come first; rows of one doc_id follow one another, each a document. An empty
table gives a folder without blocks and no rows. Texts of any length are
encoded whole; one of more ids than a block has continues in blocks of its own.
Extra columns, whatever their names, are dropped.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ingestloom.llm import chunked, rans, scratch
from ingestloom.llm.bytesview import blocks, byte_view

#: Ranges of doc_id at most; their bounds are all that the driver holds of the ids.
MAX_RANGES = 20_000
#: Text encoded at once.
SLICE_BYTES = 8 << 20
#: The id after each document.
END = 0

_LEAST = -(1 << 63)
_MANIFEST = "part int, nth int, path string, offset long, length long, n_docs int, n_tokens long, piece long"


def _open(uri: str):
    """(file system, path) of a folder's URI."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def _ranges(docs: DataFrame) -> np.ndarray:
    """Upper bounds of all ranges of doc_id but the last, nearly equal in rows."""
    spark = docs.sparkSession
    n = min(MAX_RANGES, max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions()))
    if n < 2:
        return np.zeros(0, np.int64)
    found = docs.agg(F.percentile_approx(F.coalesce("doc_id", F.lit(_LEAST)), [k / n for k in range(1, n)], max(10_000, 10 * n)).alias("at")).first()["at"]
    return np.array(found or [], np.int64)


def _deal(ids: pa.Array, hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The range of each row; an id that fills several ranges is dealt over them."""
    at = ids.fill_null(_LEAST).to_numpy(zero_copy_only=False)
    low, high = np.searchsorted(bounds, at, "left"), np.searchsorted(bounds, at, "right")
    return (low + hashes % np.maximum(high - low, 1)).astype(np.int32)


def encoded(docs: DataFrame, tokenizer: str, bounds: np.ndarray) -> DataFrame:
    """part, doc_id and ids (little-endian, 16 bits if all ids fit) of every document, end id included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = chunked.load(tokenizer)
        for batch in batches:
            for rows in blocks(batch, limit=SLICE_BYTES):
                ids, counts = encoder.encode(*byte_view(rows.column("text")))
                ends = np.cumsum(counts + 1)
                whole = np.full(int(ends[-1]), END, _kind(encoder.size))
                inside = np.ones(len(whole), bool)
                inside[ends - 1] = False
                whole[inside] = ids
                offsets = np.concatenate([[0], ends]) * whole.itemsize
                packed = pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(whole)]).cast(pa.binary())
                hashes = np.array([zlib.crc32(x.as_buffer()) for x in packed], np.int64)
                yield pa.RecordBatch.from_pydict({"part": pa.array(_deal(rows.column("doc_id"), hashes, bounds)), "doc_id": rows.column("doc_id"), "ids": packed})

    return docs.mapInArrow(run, "part int, doc_id long, ids binary")


def _kind(size: int) -> type:
    return np.uint16 if size <= 1 << 16 else np.uint32


def _directory(doc_ids: list[int | None], counts: list[int]) -> bytes:
    """Ids and numbers of ids of a block's documents, deflated."""
    known = np.array([x is not None for x in doc_ids], np.uint8)
    ids = np.array([x or 0 for x in doc_ids], "<i8")
    return zlib.compress(struct.pack("<I", len(ids)) + ids.tobytes() + np.array(counts, "<i8").tobytes() + known.tobytes(), 1)


def _read_directory(raw: bytes) -> tuple[pa.Array, np.ndarray]:
    raw = zlib.decompress(raw)
    n = struct.unpack_from("<I", raw)[0]
    ids, counts = np.frombuffer(raw, "<i8", n, 4), np.frombuffer(raw, "<i8", n, 4 + 8 * n)
    return pa.array(ids, mask=np.frombuffer(raw, np.uint8, n, 4 + 16 * n) == 0), counts


def packed(tokens: DataFrame, size: int) -> DataFrame:
    """Sorted documents of each range, put together to blocks of at most ``rans.BLOCK`` ids.

    ``piece`` is how many ids of its document come before the block, where the document fills several.
    """
    width, limit = np.dtype(_kind(size)).itemsize, rans.BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nth, doc_ids, counts, held, total = None, 0, [], [], [], 0

        def close(piece: int | None = None) -> pa.RecordBatch:
            nonlocal nth, doc_ids, counts, held, total
            row = {
                "part": pa.array([part], pa.int32()), "nth": pa.array([nth], pa.int32()), "n_docs": pa.array([len(doc_ids)], pa.int32()), "n_tokens": pa.array([total], pa.int64()),
                "piece": pa.array([piece], pa.int64()), "directory": pa.array([_directory(doc_ids, counts)], pa.binary()), "ids": pa.array([b"".join(held)], pa.binary()),
            }
            nth, doc_ids, counts, held, total = nth + 1, [], [], [], 0
            return pa.RecordBatch.from_pydict(row)

        for batch in batches:
            for at, doc_id, ids in zip(batch.column("part").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                ids = ids.as_buffer()
                n = ids.size // width
                if doc_ids and (at != part or total + n > limit):
                    yield close()
                if at != part:
                    part, nth = at, 0
                if n > limit:  # a document of several blocks has them for itself
                    for piece in range(0, n, limit):
                        cut = ids.slice(piece * width, min(limit, n - piece) * width).to_pybytes()
                        doc_ids, counts, held, total = [doc_id], [len(cut) // width], [cut], len(cut) // width
                        yield close(piece)
                    continue
                doc_ids.append(doc_id)
                counts.append(n)
                held.append(ids.to_pybytes())
                total += n
        if doc_ids:
            yield close()

    return tokens.mapInArrow(run, "part int, nth int, n_docs int, n_tokens long, piece long, directory binary, ids binary")


def count_ids(raw: DataFrame, size: int) -> np.ndarray:
    """How often every id occurs in all blocks; one number an id of the vocabulary reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        for batch in batches:
            for ids in batch.column("ids"):
                counts += np.bincount(np.frombuffer(ids.as_buffer(), _kind(size)), minlength=size)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"id": pa.array(at, pa.int32()), "n": pa.array(counts[at], pa.int64())})

    out = np.zeros(size, np.int64)
    for row in raw.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[row.id] = row.n
    return out


def _write_blocks(raw: DataFrame, share: np.ndarray, folder: str) -> DataFrame:
    """Writes one file a task; the manifest's rows come once the file is closed."""
    size = len(share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, stream, at, rows = rans.Table(share), None, 0, []
        system, base = _open(folder)
        path = f"blocks/{uuid.uuid4().hex}.rtk"
        try:
            for batch in batches:
                for row, ids in zip(batch.drop_columns(["ids"]).to_pylist(), batch.column("ids"), strict=True):
                    block = rans.encode(np.frombuffer(ids.as_buffer(), _kind(size)), table, row["directory"])
                    if stream is None:
                        system.create_dir(f"{base}/blocks", recursive=True)
                        stream = system.open_output_stream(f"{base}/{path}")
                    stream.write(struct.pack("<Q", len(block)) + block)
                    rows.append((row["part"], row["nth"], path, at + 8, len(block), row["n_docs"], row["n_tokens"], row["piece"]))
                    at += 8 + len(block)
        finally:
            if stream is not None:
                stream.close()
        if rows:
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in _MANIFEST.split(", ")])

    return raw.mapInArrow(run, _MANIFEST)


def write_tokens(docs: DataFrame, folder: str, tokenizer: str) -> None:
    """All texts of ``docs`` (doc_id, text) as token files below ``folder``."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size, bounds = chunked.load(tokenizer).size, _ranges(docs)
    tokens = encoded(docs, tokenizer, bounds).repartitionById(len(bounds) + 1, F.col("part"))
    before = scratch.made()
    raw = scratch.materialize(packed(tokens.sortWithinPartitions("part", F.col("doc_id").asc_nulls_first()), size))
    counts = count_ids(raw, size)
    share = rans.shares(counts)
    rows = [(k, int(n), int(s)) for k, (n, s) in enumerate(zip(counts, share, strict=True))]  # one row an id of the vocabulary
    spark.createDataFrame(rows, "id int, n long, share int").coalesce(1).write.parquet(f"{folder}/table")
    _write_blocks(raw, share, folder).write.parquet(f"{folder}/manifest")
    scratch.release(scratch.made() - before)


def read_table(spark: SparkSession, folder: str) -> np.ndarray:
    """The share of every id."""
    rows = spark.read.parquet(f"{folder}/table").collect()
    out = np.zeros(len(rows), np.int64)
    for row in rows:
        out[row.id] = row.share
    return out


def block_starts(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest with the number of ids before each block: sums of the ranges before, then within the range."""
    manifest = spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest")
    before = lambda *by: (Window.partitionBy(*by) if by else Window).orderBy("nth" if by else "part").rowsBetween(Window.unboundedPreceding, -1)
    sums = manifest.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before()), F.lit(0)).alias("base"))  # MAX_RANGES rows at most
    inside = F.coalesce(F.sum("n_tokens").over(before("part")), F.lit(0))
    return manifest.withColumn("_inside", inside).join(sums, "part").withColumn("start", F.col("base") + F.col("_inside")).drop("base", "_inside")


def _decoded(some: DataFrame, folder: str, share: np.ndarray, make, schema: str) -> DataFrame:
    """Blocks of the manifest, dealt evenly, read and decoded; ``make`` gives a batch of (row, doc_ids, counts, ids)."""
    n = int(some.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = rans.Table(share)
        system, base = _open(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with system.open_input_file(f"{base}/{row['path']}") as file:
                    file.seek(row["offset"])
                    block = file.read(row["length"])
                ids, directory = rans.decode(block, table)
                doc_ids, counts = _read_directory(directory)
                yield make(row, doc_ids, counts, ids)

    return some.repartition(n, "part", "nth").mapInArrow(run, schema)


def read_tokens(spark: SparkSession, folder: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """doc_id, start, n_tokens and ids, end id included.

    ``first`` and ``last`` (exclusive) choose the documents of the blocks that
    hold ids of that range; no other block is read. A document of several
    blocks comes as several rows, each with the start of its piece.
    """
    some = block_starts(spark, folder)
    if first is not None:
        some = some.where(F.col("start") + F.col("n_tokens") > first)
    if last is not None:
        some = some.where(F.col("start") < last)

    def make(row, doc_ids, counts, ids):
        offsets = np.concatenate([[0], np.cumsum(counts)])
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.astype(np.int32)))
        return pa.RecordBatch.from_pydict({"doc_id": doc_ids, "start": pa.array(row["start"] + offsets[:-1]), "n_tokens": pa.array(counts), "ids": lists})

    return _decoded(some, folder, read_table(spark, folder), make, "doc_id long, start long, n_tokens long, ids array<int>")


def token_digests(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, read back from the files."""
    all_blocks, share = block_starts(spark, folder), read_table(spark, folder)

    def make(row, doc_ids, counts, ids):
        offsets, raw = np.concatenate([[0], np.cumsum(counts)]), memoryview(ids.astype("<u4").tobytes())
        crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(offsets, offsets[1:], strict=False)]
        start = row["start"] + offsets[:-1] - (row["piece"] or 0)  # of the document, also for its later pieces
        return pa.RecordBatch.from_pydict({"doc_id": doc_ids, "start": pa.array(start), "n_tokens": pa.array(counts), "ids_crc32": pa.array(crcs, pa.int64()), "piece": pa.array([row["piece"]] * len(counts), pa.int64())})

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, piece long"
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    short = _decoded(all_blocks.where("piece is null"), folder, share, make, schema).select(*names)
    pieces = _decoded(all_blocks.where("piece is not null"), folder, share, make, schema)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crcs = []
            for parts in batch.column("parts").to_pylist():
                crc = parts[0]["ids_crc32"]
                for part in parts[1:]:
                    crc = rans.joined_crc(crc, part["ids_crc32"], 4 * part["n_tokens"])
                crcs.append(crc)
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in names[:3]} | {"ids_crc32": pa.array(crcs, pa.int64())})

    # the pieces of one text: as many as its ids fill blocks
    long = pieces.groupBy("start", "doc_id").agg(F.sum("n_tokens").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("piece", "n_tokens", "ids_crc32"))).alias("parts"))
    return short.unionByName(long.select(*names[:3], "parts").mapInArrow(join, ", ".join(schema.split(", ")[:4])))
