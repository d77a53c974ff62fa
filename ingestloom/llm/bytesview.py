"""Vectorised views of Arrow string batches: bytes, words and word hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes that separate words: space and 0x09 to 0x0D.
SEPARATORS = np.zeros(256, bool)
SEPARATORS[[0x20, *range(0x09, 0x0E)]] = True
#: Text handled at once; a longer single text is handled alone.
BLOCK_BYTES = 2 << 20

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def blocks(batch: pa.RecordBatch, column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` holding about ``limit`` bytes of ``column`` each, one row at least."""
    _, offsets = byte_view(batch.column(column))
    start, n = 0, batch.num_rows
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        end = min(max(end, start + 1), n)
        yield batch.slice(start, end - start)
        start = end


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows and the offsets of the rows; null rows are empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and for each row the index of its first word (one more entry at the end)."""
    inside = ~SEPARATORS[data]
    first, last = inside.copy(), inside.copy()
    if len(data):
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        heads = offsets[:-1][offsets[:-1] < offsets[1:]]
        tails = offsets[1:][offsets[:-1] < offsets[1:]] - 1
        first[heads] = inside[heads]
        last[tails] = inside[tails]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_counts(column: pa.Array) -> np.ndarray:
    """Words in each row."""
    data, offsets = byte_view(column)
    return np.diff(word_spans(data, offsets)[2])


def _grow(n: int) -> None:
    global _powers, _inverses
    if len(_powers) < n:
        n = max(n, 2 * len(_powers))
        inverse = np.uint64(pow(int(_MULTIPLIER), -1, 1 << 64))
        _powers, _inverses = (np.concatenate([np.ones(1, np.uint64), np.full(n - 1, m)]).cumprod(dtype=np.uint64) for m in (_MULTIPLIER, inverse))


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Running polynomial hash modulo 2**64, from which ``span_hashes`` reads any span."""
    _grow(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers[: len(data)], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span; equal bytes have equal hashes wherever they stand."""
    return mix((sums[ends] - sums[starts]) * _inverses[starts])


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the word."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
