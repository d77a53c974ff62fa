"""Static range asymmetric numeral system over token ids, many lanes at a time.

A shared table gives every id a share of 2**20. A block holds the states of its
interleaved lanes and one stream of 32-bit words. Every ``INTERVAL`` steps the
decoder's states and place in the stream are kept as a checkpoint, so all parts
of a block decode side by side, and each block carries a CRC-32 of its ids.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BITS = 20
LANES = 512
#: Steps between checkpoints: 2**17 ids.
INTERVAL = 256
#: Ids of a block at most.
BLOCK = 8 * LANES * INTERVAL

_LOW = np.uint64(1 << 31)
_MASK = np.uint64((1 << BITS) - 1)
_SHIFT, _WORD = np.uint64(BITS), np.uint64(32)
_HEAD = struct.Struct("<4sHHIIII")
MAGIC = b"RTK1"


class CorruptBlock(ValueError):
    """A block whose bytes or ids do not match its checksum."""


def shares(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to a sum of 2**20; every id that occurs keeps one share at least."""
    counts = np.asarray(counts, np.float64)
    used = counts > 0
    if used.sum() > (1 << BITS):
        raise ValueError("more different ids than shares")
    out = np.zeros(len(counts), np.int64)
    if not used.any():
        return out
    out[used] = np.maximum(1, np.floor(counts[used] / counts.sum() * (1 << BITS)))
    rest = (1 << BITS) - int(out.sum())
    if rest > 0:
        out[int(np.argmax(out))] += rest
    while rest < 0:  # the least shares were raised to one; take that from the largest
        at = int(np.argmax(out))
        cut = min(-rest, int(out[at]) // 2)
        out[at] -= cut
        rest += cut
    return out


class Table:
    """Shares of all ids, ready for both directions."""

    def __init__(self, share: np.ndarray):
        self.share = np.asarray(share, np.uint64)
        self.start = np.concatenate([[0], np.cumsum(self.share)])[:-1].astype(np.uint64)
        self.pad = int(np.argmax(self.share)) if len(self.share) else 0
        self.crc = zlib.crc32(self.share.astype("<u4").tobytes())
        self._ids: np.ndarray | None = None

    @property
    def ids(self) -> np.ndarray:
        """The id of every slot."""
        if self._ids is None:
            self._ids = np.repeat(np.arange(len(self.share), dtype=np.uint32), self.share.astype(np.int64))
        return self._ids


def encode(ids: np.ndarray, table: Table, extra: bytes = b"") -> bytes:
    """One block: header, ``extra`` bytes of the caller, checkpoints, words."""
    n = len(ids)
    if n > BLOCK:
        raise ValueError("too many ids for a block")
    steps = -(-n // LANES)
    whole = np.full(steps * LANES, table.pad, np.uint32)
    whole[:n] = ids
    if n and not table.share[whole].all():
        raise ValueError("an id without a share in the table")
    share = table.share[whole].reshape(steps, LANES)
    start = table.start[whole].reshape(steps, LANES)
    limit = share << np.uint64(63 - BITS)
    x = np.full(LANES, _LOW, np.uint64)
    words: list[np.ndarray] = []
    marks = []
    for t in range(steps - 1, -1, -1):
        over = x >= limit[t]
        words.append(x[over].astype(np.uint32))
        x = np.where(over, x >> _WORD, x)
        q = x // share[t]
        x = (q << _SHIFT) + (x - q * share[t]) + start[t]
        if t % INTERVAL == 0:
            marks.append(x)
    words.reverse()
    marks.reverse()
    sizes = np.cumsum([0] + [len(w) for w in words])
    places = sizes[: len(sizes) - 1 : INTERVAL].astype("<u4") if steps else np.zeros(0, "<u4")
    states = np.concatenate(marks).astype("<u8").tobytes() if marks else b""
    stream = np.concatenate(words).astype("<u4").tobytes() if words else b""
    body = extra + places.tobytes() + states + stream
    crc = zlib.crc32(np.asarray(ids, "<u4").tobytes())
    head = _HEAD.pack(MAGIC, BITS, LANES, n, len(extra), crc, table.crc)
    return head + struct.pack("<I", zlib.crc32(head + body)) + body


def decode(block: bytes, table: Table) -> tuple[np.ndarray, bytes]:
    """(ids, the caller's bytes); raises ``CorruptBlock`` where a checksum does not fit."""
    head = block[: _HEAD.size]
    if len(head) < _HEAD.size or head[:4] != MAGIC:
        raise CorruptBlock("not a block")
    _, bits, lanes, n, n_extra, crc, table_crc = _HEAD.unpack(head)
    at = _HEAD.size + 4
    if struct.unpack("<I", block[_HEAD.size : at])[0] != zlib.crc32(head + block[at:]):
        raise CorruptBlock("the block's bytes differ from its checksum")
    if (bits, lanes, table_crc) != (BITS, LANES, table.crc):
        raise CorruptBlock("the block was written with another table")
    extra, at = bytes(block[at : at + n_extra]), at + n_extra
    steps = -(-n // LANES)
    parts = -(-steps // INTERVAL)
    place = np.frombuffer(block, "<u4", parts, at).astype(np.int64)[:, None]
    at += 4 * parts
    x = np.frombuffer(block, "<u8", parts * LANES, at).astype(np.uint64).reshape(parts, LANES)
    words = np.frombuffer(block, "<u4", offset=at + 8 * parts * LANES)
    out = np.empty((parts, INTERVAL, LANES), np.uint32)
    last = steps - (parts - 1) * INTERVAL  # steps of the last part
    for t in range(min(INTERVAL, steps)):
        if t == last:
            x, place = x[:-1], place[:-1]
        slot = x & _MASK
        ids = table.ids[slot]
        out[: len(x), t] = ids
        x = table.share[ids] * (x >> _SHIFT) + slot - table.start[ids]
        need = x < _LOW
        rank = np.cumsum(need, axis=1)
        x[need] = (x[need] << _WORD) | words[(place + rank - 1)[need]]
        place = place + rank[:, -1:]
    ids = out.reshape(-1)[:n]
    if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
        raise CorruptBlock("the decoded ids differ from their checksum")
    return ids, extra


def _times(matrix: list[int], vector: int) -> int:
    out = 0
    for row in matrix:
        if vector & 1:
            out ^= row
        vector >>= 1
    return out


def joined_crc(first: int, second: int, length: int) -> int:
    """CRC-32 of two byte strings after each other, from theirs and the second's length."""
    shift = [0xEDB88320] + [1 << k for k in range(31)]  # one zero bit
    for _ in range(3):
        shift = [_times(shift, row) for row in shift]  # one zero byte
    while length:
        if length & 1:
            first = _times(shift, first)
        shift = [_times(shift, row) for row in shift]
        length >>= 1
    return first ^ second
