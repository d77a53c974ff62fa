"""Whole Arrow batches of text through a byte-level tokenizer, each different chunk once.

The usual split pattern of byte-level vocabularies always begins a new match at
a single space or line feed between characters that are no white space, and at
a mark after an ASCII letter. Texts are cut there, equal chunks are encoded
once a batch, and their ids are put together again with numpy. Chunks that
begin with such a space are encoded joined, and their ids told apart by the
lengths of the tokens, which never reach over a cut.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Chunks that are joined for one call, and those that a worker keeps.
JOINED = 500
KEPT = 300_000


def _among(values) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(values)] = True
    return out


#: ASCII bytes that may count as white space.
_SPACE = _among([*range(0x09, 0x0E), *range(0x1C, 0x21)])
#: First bytes of characters some of which are white space.
_LEAD = _among([0xC2, 0xE1, 0xE2, 0xE3])
_LEAD3 = _among([0xE1, 0xE2, 0xE3])
_LETTER = _among([*range(0x41, 0x5B), *range(0x61, 0x7B)])
_MARK = _among(b".,;:!?")


def _solid_end(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the byte at each place surely ends a character that is no white space."""
    before, earlier = data[np.maximum(at - 1, 0)], data[np.maximum(at - 2, 0)]
    return ~_SPACE[data[at]] & ~((data[at] >= 0x80) & ((before == 0xC2) | _LEAD3[earlier]))


def _solid_start(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    return ~_SPACE[data[at]] & ~_LEAD[data[at]]


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where chunks begin: at every row that has bytes, and at every safe cut within a row."""
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True  # rows neither begin nor end inside a cut
    gap = np.flatnonzero((data == 0x20) | (data == 0x0A))
    gap = gap[~edge[gap] & ~edge[gap + 1]]
    gap = gap[_solid_end(data, gap - 1) & _solid_start(data, gap + 1)]
    feed = gap[data[gap] == 0x0A]
    mark = np.flatnonzero(_MARK[data])
    mark = mark[~edge[mark]]
    mark = mark[_LETTER[data[mark - 1]]]
    begins = np.zeros(len(data), bool)
    for places in (heads, gap, feed + 1, mark):
        begins[places] = True
    return np.flatnonzero(begins)


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All indices of the ranges that begin at ``starts`` and have ``sizes``."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class ChunkEncoder:
    """Encodes batches with a byte-level tokenizer of the usual split pattern; special tokens' strings are ordinary text."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.size = max(vocabulary.values(), default=-1) + 1
        self.bytes = np.zeros(self.size, np.int64)
        for token, at in vocabulary.items():
            self.bytes[at] = len(token)  # a character of a byte-level token is a byte
        self._forget()

    def _forget(self) -> None:
        self.known = pa.array([], pa.large_binary())
        self.known_sizes, self.known_ids = np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, number of ids of each row) of rows of UTF-8 bytes."""
        begins = cuts(data, offsets)
        if not len(begins):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        bounds = np.append(begins, len(data)).astype(np.int64)
        chunks = pa.Array.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        sizes, ids = self._encode_different(chunks.dictionary)
        which = chunks.indices.to_numpy(zero_copy_only=False)
        starts = np.cumsum(sizes) - sizes
        each = sizes[which]
        out = ids[ragged(starts[which], each)]
        ends = np.concatenate([[0], np.cumsum(each)])
        return out, np.diff(ends[np.searchsorted(begins, offsets)])

    def _encode_different(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each chunk, all ids); chunks met before are taken from what the worker keeps."""
        known = pc.index_in(chunks, value_set=self.known).fill_null(-1).to_numpy()
        fresh = np.flatnonzero(known < 0)
        sizes = np.zeros(len(chunks), np.int64)
        old = np.flatnonzero(known >= 0)
        sizes[old] = self.known_sizes[known[old]]
        new = chunks.take(pa.array(fresh))
        new_sizes, new_ids = self._encode_new(new)
        sizes[fresh] = new_sizes
        starts = np.cumsum(sizes) - sizes
        ids = np.zeros(int(sizes.sum()), np.uint32)
        known_starts = np.cumsum(self.known_sizes) - self.known_sizes
        ids[ragged(starts[old], sizes[old])] = self.known_ids[ragged(known_starts[known[old]], sizes[old])]
        ids[ragged(starts[fresh], new_sizes)] = new_ids
        if len(self.known) + len(new) > KEPT:
            self._forget()
        self.known = pa.concat_arrays([self.known, new])
        self.known_sizes, self.known_ids = np.concatenate([self.known_sizes, new_sizes]), np.concatenate([self.known_ids, new_ids])
        if len(self.known) > KEPT:
            self._forget()
        return sizes, ids

    def _encode_new(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        n = len(chunks)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint32)
        bounds = np.frombuffer(chunks.buffers()[1], np.int64)[chunks.offset : chunks.offset + n + 1]
        data = np.frombuffer(chunks.buffers()[2], np.uint8)
        first, last, lengths = bounds[:-1], bounds[1:] - 1, np.diff(bounds)
        spaced = (data[first] == 0x20) & (lengths > 1)
        spaced &= _solid_start(data, np.minimum(first + 1, last)) & _solid_end(data, last)
        sizes, kept = np.zeros(n, np.int64), []
        joined = np.flatnonzero(spaced)
        groups = [joined[k : k + JOINED] for k in range(0, len(joined), JOINED)]
        texts = [data[ragged(first[g], lengths[g])].tobytes().decode() for g in groups]
        for group, encoding in zip(groups, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(encoding.ids, np.uint32)
            ends = np.searchsorted(np.cumsum(self.bytes[ids]), np.cumsum(lengths[group])) + 1
            sizes[group] = np.diff(ends, prepend=0)
            kept.append(ids)
        alone = np.flatnonzero(~spaced)
        plain = [x.decode() for x in chunks.take(pa.array(alone)).to_pylist()]
        for at, encoding in zip(alone.tolist(), self.tokenizer.encode_batch_fast(plain, add_special_tokens=False), strict=True):
            kept.append(np.array(encoding.ids, np.uint32))
            sizes[at] = len(kept[-1])
        order = np.concatenate([joined, alone])
        out = np.zeros(int(sizes.sum()), np.uint32)
        out[ragged((np.cumsum(sizes) - sizes)[order], sizes[order])] = np.concatenate(kept)
        return sizes, out


@lru_cache(maxsize=2)
def load(path: str) -> ChunkEncoder:
    """One encoder a worker process, for a ``tokenizers`` file."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores belong to Spark's tasks
    from tokenizers import Tokenizer

    return ChunkEncoder(Tokenizer.from_file(path))
