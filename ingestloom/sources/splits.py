"""Delimited text by splits: lines in parallel, records and their numbers in file order.

A first scan counts the lines of every split (a byte range of a file that one
task reads) and looks at all of its bytes: is there a quote, is it UTF-8. Sums
over the splits, in the order of paths and byte places, number the records.

Where there are quotes, a line may belong to a record that began in another
split. Whether a split begins inside quotes is not known when it is read, so a
second scan reads each under both hypotheses; what it does to either is a small
function, and these functions are composed along a file. A third scan cuts the
records in parallel. Only the lines of records that cross the end of a split
are put together afterwards.

The driver holds one row a split, as Spark's own scheduler does.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ingestloom.errors import IngestError

OUT, IN = 0, 1
#: What the lines of a split come as.
_LINES = "key long, at long, value string"
#: Control characters of ISO-8859-1 that are letters and signs in windows-1252.
_C1 = "[\\u0080-\\u009f]"


@dataclass(frozen=True)
class Split:
    """A byte range of a file and what it holds.

    ``first_at`` is the place of its first line within the partition that reads
    it, ``header_at`` that of its first line with text. ``starts`` are the
    records that begin in it; before its first one are ``head`` lines of an
    earlier record, and from its last one on ``tail`` lines if that is not
    ended here.
    """

    key: int
    path: str
    place: int
    lines: int
    first_at: int
    header_at: int | None
    quoted: bool
    utf8: bool
    c1: bool
    wide: bool
    inside: bool = False
    starts: int = 0
    head: int = 0
    tail: int = 0
    number: int = 0


def lines(spark: SparkSession, path: str | list[str], ending: str = "\n") -> DataFrame:
    """key (of the split), at (place in the task's partition) and value of every physical line."""
    raw = spark.read.option("lineSep", ending).text(path)
    place = F.col("_metadata.file_block_start")
    return raw.select(F.xxhash64("_metadata.file_path", place).alias("key"), F.monotonically_increasing_id().alias("at"), "value", F.col("_metadata.file_path").alias("path"), place.alias("place"))


def decoded(value, encoding: str):
    """A line's text; lines are split before they are decoded, which UTF-8 and single-byte encodings allow."""
    if encoding.lower() in ("utf-8", "utf8"):
        return value
    if encoding.lower() in ("windows-1252", "cp1252"):  # not among the encodings of decode
        return F.translate(F.decode(value.cast("binary"), "ISO-8859-1"), *_signs())
    return F.decode(value.cast("binary"), encoding)


def _signs() -> tuple[str, str]:
    """The control characters that windows-1252 has other characters for, and those."""
    at = [b for b in range(0x80, 0xA0) if bytes([b]).decode("cp1252", "ignore")]
    return "".join(map(chr, at)), bytes(at).decode("cp1252")


def survey(all_lines: DataFrame) -> list[Split]:
    """All splits in file order, from one scan that aggregates before it shuffles."""
    value, text = F.col("value"), F.decode(F.col("value").cast("binary"), "ISO-8859-1")
    valid = F.is_valid_utf8(value)
    rows = all_lines.groupBy("key", "path", "place").agg(
        F.count("*").alias("lines"), F.min("at").alias("first_at"), F.min(F.when(F.trim(value) != "", F.col("at"))).alias("header_at"),
        F.bool_or(F.contains(value, F.lit('"'))).alias("quoted"), F.bool_and(valid).alias("utf8"), F.bool_or(~valid & text.rlike(_C1)).alias("c1"), F.bool_or(valid & (F.octet_length(value) > F.char_length(value))).alias("wide"),
    ).collect()
    found = sorted((Split(**r.asDict()) for r in rows), key=lambda s: (s.path, s.place))
    if len({s.key for s in found}) < len(found):
        raise IngestError("two splits have one key")
    return found


def encoding_of(found: list[Split], wanted: str | None = None) -> str:
    """UTF-8 if every byte of every file fits it, else the single-byte encoding that the bytes fit.

    Lines of letters in UTF-8 beside lines that are no UTF-8 are a conflict, and
    so are bytes that do not fit a ``wanted`` UTF-8; no text is guessed then.
    """
    wrong = sorted({s.path for s in found if not s.utf8})
    if wanted:
        if wrong and wanted.lower().replace("_", "-") in ("utf-8", "utf8", "ascii", "us-ascii"):
            raise IngestError(f"bytes that are no {wanted} in {wrong[0]}")
        return wanted
    if not wrong:
        return "utf-8"
    if any(s.wide for s in found):
        raise IngestError(f"text in UTF-8 and bytes that are no UTF-8, such as in {wrong[0]}; name the encoding")
    return "windows-1252" if any(s.c1 for s in found) else "iso-8859-1"


def _opens(delimiter: str) -> re.Pattern:
    """Matches a line, read from the start of a field, that ends inside quotes."""
    d = re.escape(delimiter)
    return re.compile(rf'(?>(?:"(?>[^"]+|"")*+"[^{d}]*+|[^"{d}][^{d}]*+|){d})*+"(?>[^"]+|"")*+\Z', re.S)


def _after(line: str, state: int, opens: re.Pattern) -> int:
    """Outside or inside quotes after a line; one that begins inside reads as if it began with the quote."""
    return int(opens.match(line if state == OUT else '"' + line) is not None)


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Array]]:
    """(key, lines) in pieces; a piece is of one split."""
    for batch in batches:
        keys = batch.column("key").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield int(keys[a]), batch.column("value").slice(a, b - a)


def _states(values: pa.Array, state: int, opens: re.Pattern) -> tuple[np.ndarray, int]:
    """(the state before each line, the state after the last); only lines with quotes are looked at."""
    quoted = np.flatnonzero(pc.match_substring(values, '"').to_numpy(zero_copy_only=False))
    before = np.full(len(values), state, np.int8)
    for k, line in zip(quoted.tolist(), values.take(pa.array(quoted)).to_pylist(), strict=True):
        now = _after(line, state, opens)
        if now != state:
            before[k + 1 :] = now
            state = now
    return before, state


def trace(all_lines: DataFrame, found: list[Split], delimiter: str, encoding: str) -> list[Split]:
    """The splits with their records: both hypotheses of each are read, then composed along each file."""
    opens = _opens(delimiter)
    schema = "key long, state int, after int, starts long, head long, tail long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], list[int]] = {}
        for key, values in _by_split(batches):
            for begin in (OUT, IN):
                kept = seen.setdefault((key, begin), [begin, 0, 0, 0])
                before, after = _states(values, kept[0], opens)
                starts = np.flatnonzero(before == OUT)
                if not kept[1]:
                    kept[2] += int(starts[0]) if len(starts) else len(values)
                kept[3] = len(values) - int(starts[-1]) if len(starts) else kept[3] + len(values)
                kept[0], kept[1] = after, kept[1] + len(starts)
        rows = [(key, begin, *kept) for (key, begin), kept in seen.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k not in (1, 2) else pa.int32()) for k, c in enumerate(zip(*rows, strict=True) if rows else [[]] * 6)], [c.split()[0] for c in schema.split(", ")])

    text = all_lines.select("key", decoded(F.col("value"), encoding).alias("value"))
    does = {(r.key, r.state): r for r in text.mapInArrow(run, schema).collect()}
    out, state, path = [], OUT, None
    for split in found:
        if split.path != path:
            state, path = OUT, split.path
        did = does[split.key, state]
        out.append(replace(split, inside=state == IN, starts=did.starts, head=did.head if state == IN else 0, tail=did.tail if did.after == IN and did.starts else 0))
        state = did.after
    return out


def numbered(found: list[Split]) -> list[Split]:
    """The splits with the number of records before each."""
    before = np.cumsum([0] + [s.starts for s in found])
    return [replace(s, number=int(n)) for s, n in zip(found, before, strict=False)]


def plain_records(all_lines: DataFrame, found: list[Split], encoding: str, rownum: str, record: str) -> DataFrame:
    """Records that are lines: no shuffle, numbers by the sums of the splits before; headers and blank lines are left out."""
    found = numbered([replace(s, starts=s.lines) for s in found])
    rows = [(s.key, s.number - s.first_at, s.header_at if s.place == 0 else None) for s in found]
    shifts = all_lines.sparkSession.createDataFrame(rows, "key long, shift long, header_at long")
    text = F.rtrim(decoded(F.col("value"), encoding), F.lit("\r"))
    body = all_lines.where(F.trim(F.col("value")) != "").join(shifts, "key").where(~F.col("at").eqNullSafe(F.col("header_at")))
    return body.select((F.col("at") + F.col("shift")).alias(rownum), text.alias(record))


def quoted_records(all_lines: DataFrame, found: list[Split], delimiter: str, encoding: str, rownum: str, record: str) -> DataFrame:
    """Records that may hold line ends inside quotes, cut in parallel."""
    spark, opens = all_lines.sparkSession, _opens(delimiter)
    found = numbered(trace(all_lines, found, delimiter, encoding))
    known = spark.sparkContext.broadcast({s.key: (s.inside, s.number, s.place == 0, s.starts - (s.tail > 0)) for s in found})  # a row a split
    schema = f"{rownum} long, {record} string"
    text = all_lines.select("key", "at", decoded(F.col("value"), encoding).alias("value"), "path", "place")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, base, begun, whole, header = None, OUT, 0, 0, 0, False
        held: list[str] = []
        numbers: list[int] = []
        records: list[str] = []

        def put() -> None:
            """The record that was begun last is complete; blank ones and the header go."""
            nonlocal header
            text = "\n".join(held).rstrip("\r")
            if not text.strip(" "):
                return
            if header:
                header = False
                return
            numbers.append(base + begun - 1)
            records.append(text)

        def take() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(records, pa.string())], [rownum, record])
            numbers.clear()
            records.clear()
            return out

        for at, values in _by_split(batches):
            if at != key:
                if 0 < begun <= whole:
                    put()
                key, begun, held = at, 0, []
                inside, base, header, whole = known.value[at]
                state = IN if inside else OUT
            before, state = _states(values, state, opens)
            pieces = values.to_pylist()
            bounds = [*np.flatnonzero(before == OUT).tolist(), len(pieces)]
            if begun:
                held += pieces[: bounds[0]]
            for a, b in zip(bounds, bounds[1:], strict=False):
                if begun:
                    put()
                begun, held = begun + 1, pieces[a:b]
            yield take()
        if 0 < begun <= whole:
            put()
        yield take()

    whole = text.select("key", "value").mapInArrow(cut, schema)
    crossing = [s for s in found if s.head or s.tail]
    if not crossing:
        return whole
    chains = _chains(found)
    rows = [(s.key, s.first_at + s.head, s.first_at + s.lines - s.tail, chains.get((s.key, "head")), chains.get((s.key, "tail"))) for s in crossing]
    edges = spark.createDataFrame(rows, "key long, head_end long, tail_start long, head_of long, tail_of long")
    pieces = text.join(edges, "key").where("at < head_end or at >= tail_start")
    owner = F.when(F.col("at") < F.col("head_end"), F.col("head_of")).otherwise(F.col("tail_of"))
    # the lines of one record: as many as it has
    joined = pieces.select(owner.alias(rownum), "place", "at", "value").groupBy(rownum).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "at", "value"))), lambda x: x["value"]), "\n").alias(record))
    return whole.unionByName(joined.select(rownum, F.rtrim(F.col(record), F.lit("\r")).alias(record)))


def _chains(found: list[Split]) -> dict[tuple[int, str], int]:
    """The number of the record that the first, and the last, lines of a split belong to."""
    out, current = {}, None
    for s in found:
        if s.head:
            out[s.key, "head"] = current
        if s.tail:
            current = s.number + s.starts - 1
            out[s.key, "tail"] = current
    return out
