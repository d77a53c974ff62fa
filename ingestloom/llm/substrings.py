"""Repeated passages: longest-previous-factor arrays over suffix order.

A position of a text lies in a repeat when the ``window`` bytes from it also
start elsewhere. To find all such positions without one suffix array over the
whole corpus, texts are cut into contexts that meet where they must:

1. Every window is named by an anchor: of the grams of ``GRAM`` bytes in it, the
   one with the least hash (the first of equals). Equal windows have equal
   anchors at equal places, and neighbouring windows mostly share theirs, so a
   text has about one anchor in 170 bytes. The bytes of all windows that share
   an anchor are its context.
2. Contexts are counted by anchor hash and 128-bit digest. A context that occurs
   twice is a repeat as a whole; copies of any number end here as a count.
3. Where an anchor has several different contexts, one of each kind is read from
   the texts and they are ordered by suffix array up to the depth of the window.
   The previous and next smaller positions in that order give the longest
   previous factor of each position, the next ones its longest next factor; a
   position whose factor reaches the window starts a repeat.
4. An anchor with more than ``MANY`` different contexts is not gathered. They are
   split by the distance of windows from the anchor, into blocks of 64, then 8,
   then 1 windows; all windows of a block hold the same core of bytes, and only
   pieces with equal cores can share a window. Pieces are counted and ordered as
   contexts are (steps 2 and 3), so what many contexts share becomes one piece
   with a count, and what none shares is alone. Pieces of one window need no
   order: they are equal or they are not.

Defined results: null text is empty; a text shorter than the window has no
repeats of its own. Very long texts are anchored in overlapping segments and
otherwise treated like any other. Repeated rows repeat each other. Matches never
cross documents. Extra columns, whatever their names, are dropped by
``remove_repeats`` and kept by ``drop_repeats``. An empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ingestloom.llm.bytesview import blocks, byte_view, mix, prefix_hashes, span_hashes
from ingestloom.llm.names import fresh
from ingestloom.llm.scratch import materialize

WINDOW = 400
GRAM = 64
#: Different contexts of an anchor, or pieces of a core, that are ordered together at most.
MANY = 256
#: Windows of a piece, level by level.
SPLITS = (64, 8, 1)
BATCH_BYTES = 3 << 20
#: Windows of a segment of a very long text.
SEGMENT = 8 << 20
_CORE_BLOCK = 32
_LOW = np.uint64(0xFFFFFFFF)

def suffix_order(data: np.ndarray, depth: int | None = None, ends: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and ranks by prefix doubling.

    Suffixes are compared up to ``depth`` bytes, or whole; one that ends first
    is smaller. ``ends`` gives for each position where its suffix ends (by
    default at the end of the data). Equal prefixes share a rank and stand in
    order of position.
    """
    n = len(data)
    ends = np.full(n, n, np.int64) if ends is None else ends
    depth = n if depth is None else depth
    at = np.arange(n)
    rank = data.astype(np.int64) + 1
    length = 1
    while length < depth and n:
        step = min(length, depth - length)
        ahead = at + step
        inside = ahead < ends
        second = np.zeros(n, np.int64)
        second[inside] = rank[ahead[inside]]
        key = rank * (int(rank.max()) + 1) + second
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        fresh = np.empty(n, np.int64)
        fresh[order] = np.cumsum(np.concatenate([[1], (sorted_key[1:] != sorted_key[:-1]).astype(np.int64)]))
        if fresh.max(initial=0) == n and ends[0] == n:
            rank = fresh
            break
        rank, length = fresh, length + step
    return np.argsort(rank, kind="stable"), rank


def _factors_before(places: np.ndarray, commons: np.ndarray) -> np.ndarray:
    """For each entry its common prefix with the nearest entry before it whose place is smaller, 0 without one.

    ``commons`` holds the common prefix of each entry with the one before it.
    All entries follow their links back at once, each carrying the least common
    prefix on the way.
    """
    at, least = np.arange(len(places)) - 1, commons.copy()
    least[:1] = 0
    going = np.flatnonzero(least > 0)
    going = going[places[at[going]] > places[going]]
    while len(going):
        back = at[going]
        least[going] = np.minimum(least[going], least[back])
        at[going] = at[back]
        going = going[least[going] > 0]
        going = going[places[at[going]] > places[going]]
    return least


def factor_lengths(order: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Longest previous and longest next factor of every position.

    ``order`` holds the positions in suffix order and ``lcp`` the common prefix
    of each with the one before. The longest earlier match of a position is with
    the previous or the next smaller position in suffix order; later matches
    likewise with larger ones.
    """
    n = len(order)
    previous, following = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if n:
        turned = np.concatenate([[0], lcp[:0:-1]])
        for result, sign in ((previous, 1), (following, -1)):
            forth = _factors_before(sign * order, lcp)
            back = _factors_before(sign * order[::-1], turned)[::-1]
            result[order] = np.maximum(forth, back)
    return previous, following


def repeated_starts(data: np.ndarray, ends: np.ndarray, starts: np.ndarray, window: int, earlier_only: bool = False) -> np.ndarray:
    """Which of ``starts`` (ascending) begin a window that also begins at another (or an earlier) of them.

    Suffixes are ordered to the depth of the window, and common prefixes are
    cut there: shorter ones count as 0, which no factor that reaches the window
    depends on.
    """
    order, rank = suffix_order(data, window, ends)
    number = np.full(len(data), -1)
    number[starts] = np.arange(len(starts))
    order = order[number[order] >= 0]
    lcp = np.zeros(len(order), np.int64)
    lcp[1:] = np.where(rank[order[1:]] == rank[order[:-1]], window, 0)
    previous, following = factor_lengths(number[order], lcp)
    return (previous if earlier_only else np.maximum(previous, following)) >= window


def anchors(data: np.ndarray, offsets: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> dict[str, np.ndarray]:
    """Anchors of all texts: row, first window, number of windows, anchor hash, and how far the anchor is from the first window."""
    empty = {k: np.zeros(0, np.int64) for k in ("row", "start", "count", "off")} | {"h": np.zeros(0, np.uint64)}
    width = window - gram + 1
    long_rows = np.flatnonzero(np.diff(offsets) >= window)
    if not len(long_rows):
        return empty
    sums = prefix_hashes(data)
    places = np.arange(len(data) - gram + 1)
    hashes = span_hashes(sums, places, places + gram)
    keys = (hashes >> np.uint64(32) << np.uint64(32)) | places.astype(np.uint64)
    pad = -len(keys) % width
    table = np.concatenate([keys, np.full(pad, ~np.uint64(0))]).reshape(-1, width)
    head = np.minimum.accumulate(table, axis=1).ravel()
    tail = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    counts = np.diff(offsets)[long_rows] - window + 1
    firsts = offsets[long_rows]
    starts = np.repeat(firsts - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
    least = np.minimum(tail[starts], head[starts + width - 1])
    anchor = (least & _LOW).astype(np.int64)
    cut = np.ones(len(starts), bool)
    cut[1:] = anchor[1:] != anchor[:-1]
    at = np.flatnonzero(cut)
    begin, anchor = starts[at], anchor[at]
    n = np.diff(np.append(at, len(starts)))
    return {"row": np.searchsorted(offsets, begin, side="right") - 1, "start": begin, "count": n, "off": anchor - begin, "h": hashes[anchor]}


def _long(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64), pa.int64())


def _digests(data: np.ndarray | bytes, starts: list[int], ends: list[int], seeds: list[int]) -> np.ndarray:
    """128-bit digest of each span, as two columns of unsigned integers."""
    from xxhash import xxh3_128_digest

    view = memoryview(data)
    joined = b"".join([xxh3_128_digest(view[s:e], k) for s, e, k in zip(starts, ends, seeds, strict=True)])
    return np.frombuffer(joined, "<u8").reshape(-1, 2)


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, text_id and text; the two ids name a text wherever a table is read again."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.select("doc_id", F.xxhash64("text").alias("text_id"), "text")


def _segments(part: pa.RecordBatch, window: int, limit: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shift, bytes, offsets) of the texts of ``part``; a very long text comes in segments that share ``window - 1`` bytes."""
    data, offsets = byte_view(part.column("text"))
    if part.num_rows > 1 or len(data) < limit + window:
        yield 0, data, offsets
        return
    for start in range(0, len(data) - window + 1, limit):
        piece = data[start : start + limit + window - 1]
        yield start, piece, np.array([0, len(piece)])


def anchor_table(docs: DataFrame, window: int = WINDOW, segment: int = SEGMENT) -> DataFrame:
    """doc_id, text_id, anchor hash h, digest c1 c2, start (in the text), count and off of every context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch):
                for shift, data, offsets in _segments(part, window, segment):
                    found = anchors(data, offsets, window)
                    rows, start, count, off = (found[k] for k in ("row", "start", "count", "off"))
                    digest = _digests(np.ascontiguousarray(data), start.tolist(), (start + count - 1 + window).tolist(), (off * 1024 + count).tolist())
                    taken = pa.array(rows)
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": part.column("doc_id").take(taken),
                            "text_id": part.column("text_id").take(taken),
                            "h": _long(found["h"]),
                            "c1": _long(np.ascontiguousarray(digest[:, 0])),
                            "c2": _long(np.ascontiguousarray(digest[:, 1])),
                            "start": pa.array(start - offsets[rows] + shift, pa.int64()),
                            "count": pa.array(count, pa.int64()),
                            "off": pa.array(off, pa.int64()),
                        }
                    )

    return _texts(docs).mapInArrow(run, "doc_id long, text_id long, h long, c1 long, c2 long, start long, count long, off long")


_PIECE = "h long, c1 long, c2 long, off long, count long, bytes binary"
_PIECE_COLUMNS = ("h", "c1", "c2", "off", "count", "bytes")


def context_bytes(docs: DataFrame, wanted: DataFrame, window: int = WINDOW) -> DataFrame:
    """The bytes of ``wanted`` contexts (h, c1, c2, off, count, many, and where one of the kind stands)."""
    lists = materialize(wanted.groupBy(F.col("doc_id").alias("in_doc"), F.col("text_id").alias("in_text")).agg(F.collect_list(F.struct("start", "h", "c1", "c2", "off", "count", "many")).alias("wanted")))
    texts = _texts(docs)
    there = texts["doc_id"].eqNullSafe(lists["in_doc"]) & (texts["text_id"] == lists["in_text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()  # rows that repeat doc_id and text give their contexts once
        for batch in batches:
            for text, entries in zip(batch.column("text"), batch.column("wanted"), strict=True):
                raw = text.as_py().encode()
                rows = []
                for e in entries.as_py():
                    key = (e["c1"], e["c2"])
                    if key not in seen:
                        seen.add(key)
                        rows.append((e["h"], *key, e["off"], e["count"], raw[e["start"] : e["start"] + e["count"] - 1 + window], e["many"]))
                for at in range(0, len(rows), 4096):
                    part = rows[at : at + 4096]
                    kinds = (*[pa.int64()] * 5, pa.binary(), pa.bool_())
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in part], kind) for k, kind in enumerate(kinds)], names=[*_PIECE_COLUMNS, "many"])

    return texts.join(lists.hint("shuffle_hash"), there).select("text", "wanted").mapInArrow(run, f"{_PIECE}, many boolean")


def _likely(sums: np.ndarray, window: int, base: np.ndarray, off: np.ndarray, count: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(piece, window number) of the windows that can repeat: their core, then their own hash, occurs again."""
    low, high = (off - count + 1) // _CORE_BLOCK, off // _CORE_BLOCK
    n = high - low + 1
    piece = np.repeat(np.arange(len(n)), n)
    block = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + low[piece]
    core = base[piece] + off[piece] - block * _CORE_BLOCK
    hashes = span_hashes(sums, core, core - _CORE_BLOCK + 1 + window)
    hashes = mix(hashes ^ mix(group[piece].astype(np.uint64) * np.uint64(4096) + block.astype(np.uint64)))
    _, which, times = np.unique(hashes, return_inverse=True, return_counts=True)
    again = times[which] > 1
    piece, block = piece[again], block[again]
    top = np.minimum(off[piece], block * _CORE_BLOCK + _CORE_BLOCK - 1)
    n = top - np.maximum(off[piece] - count[piece] + 1, block * _CORE_BLOCK) + 1
    owner = np.repeat(piece, n)
    place = np.repeat(off[piece] - top, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    start = base[owner] + place
    _, which, times = np.unique(span_hashes(sums, start, start + window), return_inverse=True, return_counts=True)
    again = times[which] > 1
    order = np.lexsort((place[again], owner[again]))
    return owner[again][order], place[again][order]


def _repeats_of(batch: list[tuple], window: int) -> list[tuple[int, int, int, int]]:
    """(c1, c2, high, low): runs of windows, by distance from the anchor, of each piece that are repeats within the batch."""
    lengths = np.array([len(b[5]) for b in batch])
    base = np.concatenate([[0], np.cumsum(lengths)])
    data = np.frombuffer(b"".join(b[5] for b in batch), np.uint8)
    off, count = np.array([b[3] for b in batch]), np.array([b[4] for b in batch])
    group = np.cumsum(np.array([True] + [batch[i][0] != batch[i - 1][0] for i in range(1, len(batch))]))
    own, at = _likely(prefix_hashes(data), window, base, off, count, group)  # no other window can repeat; these are ordered exactly
    if not len(own):
        return []
    cut = np.ones(len(own), bool)
    cut[1:] = (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(cut)
    run = np.diff(np.append(first, len(own)))
    begin = base[own[first]] + at[first]
    text = np.concatenate([data[b : b + n - 1 + window] for b, n in zip(begin.tolist(), run.tolist(), strict=True)])
    bounds = np.concatenate([[0], np.cumsum(run - 1 + window)])
    starts = np.repeat(bounds[:-1], run) + np.arange(len(own)) - np.repeat(first, run)
    repeat = repeated_starts(text, np.repeat(bounds[1:], run - 1 + window), starts, window)
    own, at = own[repeat], at[repeat]
    if not len(own):
        return []
    cut = np.ones(len(own), bool)
    cut[1:] = (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(cut)
    last = np.append(first[1:], len(own)) - 1
    return [(batch[k][1], batch[k][2], int(off[k] - i), int(off[k] - j)) for k, i, j in zip(own[first].tolist(), at[first], at[last], strict=True)]


def close_repeats(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """(c1, c2, high, low) of pieces that share windows with other pieces of their key h; at most ``MANY`` have one key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(pending):
            found = _repeats_of(pending, window) if len(pending) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in range(4)], names=["c1", "c2", "high", "low"])

        pending, group, size = [], [], 0
        last = None
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in _PIECE_COLUMNS), strict=True):
                if last is not None and row[0] != last[0]:
                    if len(group) > 1:
                        pending += group
                        size += sum(len(g[5]) for g in group)
                    group = []
                    if size >= BATCH_BYTES:
                        yield out(pending)
                        pending, size = [], 0
                if row[:3] != last:
                    group.append(row)
                last = row[:3]
        yield out(pending + group if len(group) > 1 else pending)

    return pieces.select(*_PIECE_COLUMNS).repartition("h").sortWithinPartitions("h", "c1", "c2").mapInArrow(run, "c1 long, c2 long, high long, low long")


def split_pieces(pieces: DataFrame, size: int, window: int = WINDOW) -> DataFrame:
    """Pieces cut into blocks of ``size`` windows: p1 p2 (what was cut), then a piece whose h names its block and core."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        for batch in batches:
            for part in (batch.slice(at, 256) for at in range(0, batch.num_rows, 256)):
                rows: list[tuple] = []
                for _, c1, c2, off, count, raw in zip(*(part.column(k).to_pylist() for k in _PIECE_COLUMNS), strict=True):
                    for block in range((off - count + 1) // size, off // size + 1):
                        high, low = min(off, block * size + size - 1), max(off - count + 1, block * size)
                        core = off - block * size
                        key = xxh3_64_intdigest(raw[core : core - size + 1 + window], block)
                        cut = raw[off - high : off - low + window]
                        first, second = _digests(cut, [0], [len(cut)], [high * 1024 + high - low + 1])[0].view(np.int64).tolist()
                        rows.append((c1, c2, key - (1 << 64) if key >= 1 << 63 else key, first, second, high, high - low + 1, cut))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.binary() if k == 7 else pa.int64()) for k in range(8)], names=["p1", "p2", *_PIECE_COLUMNS])

    return pieces.select(*_PIECE_COLUMNS).mapInArrow(run, f"p1 long, p2 long, {_PIECE}")


def _several(kinds: DataFrame, many: int) -> DataFrame:
    """The rows of ``kinds`` whose h has others, with ``many``: whether it has too many to gather."""
    sized = materialize(kinds.groupBy("h").agg(F.count("*").alias("v")).where("v > 1").select(F.col("h").alias("of"), (F.col("v") > many).alias("many")))
    return kinds.join(sized.hint("shuffle_hash"), kinds["h"] == sized["of"]).drop("of")


def shared_windows(pieces: DataFrame, window: int = WINDOW, many: int = MANY) -> DataFrame:
    """(c1, c2, high, low) of every piece that shares windows with others of its h; too many are split level by level."""
    found = [materialize(close_repeats(pieces.where("not many"), window))]
    edges = []
    for size in SPLITS:
        crowded = pieces.where("many")
        if crowded.isEmpty():
            break
        cut = materialize(split_pieces(crowded, size, window))
        kinds = materialize(cut.groupBy("h", "c1", "c2").agg(F.count("*").alias("n"), F.first("off").alias("off"), F.first("count").alias("count"), F.first("bytes").alias("bytes")))
        edges.append(cut.select("p1", "p2", F.col("c1").alias("e1"), F.col("c2").alias("e2")))
        pieces = materialize(_several(kinds, many if size > 1 else 1 << 62))
        whole = kinds.where("n > 1").select("c1", "c2", F.col("off").alias("high"), (F.col("off") - F.col("count") + 1).alias("low"))
        found.append(materialize(whole.unionByName(close_repeats(pieces.where("not many"), window))))
    spans = found.pop()
    while edges:
        inner, above = spans, edges.pop()
        raised = above.join(inner, (above["e1"] == inner["c1"]) & (above["e2"] == inner["c2"])).select(F.col("p1").alias("c1"), F.col("p2").alias("c2"), "high", "low")
        spans = found.pop().unionByName(raised)
    return spans


def repeat_ranges(docs: DataFrame, window: int = WINDOW, many: int = MANY, segment: int = SEGMENT) -> DataFrame:
    """doc_id, text_id and ``ranges``: the maximal byte ranges of each text that repeats cover, in order."""
    table = materialize(anchor_table(docs, window, segment))
    firsts = [F.first(c).alias(c) for c in ("doc_id", "text_id", "start", "off", "count")]
    kinds = materialize(table.groupBy("h", "c1", "c2").agg(F.count("*").alias("n"), *firsts))
    pieces = materialize(context_bytes(docs, _several(kinds, many), window))
    whole = kinds.where("n > 1").select("c1", "c2", F.col("off").alias("high"), (F.col("off") - F.col("count") + 1).alias("low"))
    shared = materialize(shared_windows(pieces, window, many).unionByName(whole).distinct()).withColumnsRenamed({"c1": "s1", "c2": "s2"})
    joined = table.join(shared, (table["c1"] == shared["s1"]) & (table["c2"] == shared["s2"]))
    spans = joined.select("doc_id", "text_id", (F.col("start") + F.col("off") - F.col("high")).alias("from"), (F.col("start") + F.col("off") - F.col("low") + window).alias("to"))
    # runs of ranges that touch become one: a text then has at most one for every window of its length
    ordered = Window.partitionBy("doc_id", "text_id").orderBy("from", "to")
    before = F.max("to").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    opened = spans.distinct().withColumn("new", F.when(F.col("from") <= before, 0).otherwise(1))
    numbered = opened.withColumn("run", F.sum("new").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    merged = numbered.groupBy("doc_id", "text_id", "run").agg(F.min("from").alias("from"), F.max("to").alias("to"))
    return merged.groupBy("doc_id", "text_id").agg(F.sort_array(F.collect_list(F.struct("from", "to"))).alias("ranges"))


def _with_ranges(docs: DataFrame, window: int) -> tuple[DataFrame, str]:
    """``docs`` with a further column of ranges (null where nothing repeats), and that column's name."""
    doc, text, name = fresh(docs.columns, "in_doc", "in_text", "ranges")
    ranges = materialize(repeat_ranges(docs, window)).toDF(doc, text, name)
    there = docs["doc_id"].cast("long").eqNullSafe(ranges[doc]) & (F.xxhash64(docs["text"].cast("string")) == ranges[text])
    return docs.join(ranges.hint("shuffle_hash"), there, "left").drop(doc, text), name


def _kept(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for start, end in spans:
        out.append(raw[at:start])
        at = end
    return b"".join([*out, raw[at:]])


def _pairs(ranges: pa.Scalar) -> list[tuple[int, int]]:
    return [(r["from"], r["to"]) for r in ranges.as_py()]


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 with every byte removed that a repeat covers."""
    joined, name = _with_ranges(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_bytes, removed, n_spans, digests = [], [], [], []
            for text, ranges in zip(batch.column("text"), batch.column(name), strict=True):
                raw = (text.as_py() or "").encode()
                spans = _pairs(ranges) if ranges.is_valid else []
                n_bytes.append(len(raw))
                removed.append(sum(e - s for s, e in spans))
                n_spans.append(len(spans))
                digests.append(hashlib.sha256(_kept(raw, spans)).hexdigest())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_bytes": pa.array(n_bytes, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(n_spans, pa.int64()), "kept_sha256": pa.array(digests, pa.string())})

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def drop_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The columns of ``docs`` with repeats cut from ``text``; bytes of characters cut in two are dropped as well."""
    joined, name = _with_ranges(docs, window)
    columns, schema = docs.columns, docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, ranges in zip(batch.column("text"), batch.column(name), strict=True):
                value = text.as_py()
                texts.append(value if value is None or not ranges.is_valid else _kept(value.encode(), _pairs(ranges)).decode("utf-8", "ignore"))
            whole = batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))
            yield whole.select(columns)

    return joined.mapInArrow(run, schema)
