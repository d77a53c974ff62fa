"""Byte-level BPE encoding and decoding with the tokenizers library.

The vocabulary is a rank file (``base64(token bytes) rank`` a line); its place
is a parameter. A ``tokenizers`` BPE model is built from it over the usual
byte-to-character table, so every byte string is a string of vocabulary
characters. With the public split pattern texts are cut into chunks that encode
by themselves, and each different chunk of a batch is encoded once (``chunked``);
with another pattern a text is one chunk.

Defined results: null and empty text give no ids. Text that looks like a
special token is ordinary text. Repeated rows are encoded like any other; extra
columns, whatever their names, are dropped. An empty table gives an empty result;
very long texts are encoded whole. Any text round-trips byte for byte, and ids whose bytes
are parts of one character decode to that character when joined.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ingestloom.llm.bytesview import blocks, byte_view
from ingestloom.llm.chunked import ChunkEncoder

#: Text encoded at once.
SLICE_BYTES = 4 << 20


def byte_characters() -> list[str]:
    """The character that stands for each byte: printable Latin-1 for itself, others from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


def _merges(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """Every pair of tokens that forms a token, by the rank of what it forms."""
    pairs = []
    for token, rank in ranks.items():
        pairs += [(rank, ranks[token[:i]], ranks[token[i:]], token[:i], token[i:]) for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
    return [(left, right) for *_, left, right in sorted(pairs)]


class ByteBPE:
    """Encoder and decoder for one rank file and split pattern."""

    def __init__(self, path: str, pattern: str):
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, file))}
        characters = byte_characters()
        spell = lambda token: "".join(map(characters.__getitem__, token))
        model = models.BPE(vocab={spell(t): r for t, r in self.ranks.items()}, merges=[(spell(a), spell(b)) for a, b in _merges(self.ranks)])
        self.tokenizer = Tokenizer(model)
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        back = {c: b for b, c in enumerate(characters)}
        self.token_bytes: list[bytes] = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for spelled, rank in model_vocabulary(self.tokenizer).items():
            self.token_bytes[rank] = bytes(back[c] for c in spelled)
        self.chunks = ChunkEncoder(self.tokenizer) if pattern == _known_pattern() else None

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        if self.chunks is None:
            found = self.tokenizer.encode_batch([text or "" for text in texts], add_special_tokens=False)
            return [np.array(one.ids, "<u4").tobytes() for one in found]
        ids, counts = self.chunks.encode(*byte_view(pa.array(texts, pa.string())))
        raw, ends = memoryview(ids.astype("<u4").tobytes()), (4 * np.cumsum(counts)).tolist()
        return [bytes(raw[a:b]) for a, b in zip([0, *ends], ends, strict=False)]

    def decode_bytes(self, ids: bytes) -> bytes:
        """The bytes that the ids stand for, also where an id ends inside a character."""
        return b"".join(map(self.token_bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def decode(self, ids: list[int]) -> str:
        """Text of the ids; bytes that form no character become U+FFFD."""
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")

    def offsets(self, ids: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of each id in code points: of the characters that hold its bytes."""
        parts = [self.token_bytes[i] for i in np.frombuffer(ids, "<u4").tolist()]
        ends = np.cumsum([len(p) for p in parts], dtype=np.int64)
        lead = (np.frombuffer(b"".join(parts), np.uint8) & 0xC0) != 0x80
        at = np.cumsum(lead) - 1  # the character of each byte
        starts = ends - [len(p) for p in parts] if len(ends) else ends
        return at[starts], at[ends - 1] + 1


def _known_pattern() -> str | None:
    """The pattern whose matches begin at single spaces between non-spaces and are single at line feeds between them."""
    try:
        from public_tokenizers import PATTERN
    except ModuleNotFoundError:
        return None
    return PATTERN


def model_vocabulary(tokenizer) -> dict[str, int]:
    return tokenizer.get_vocab(with_added_tokens=False)


@lru_cache(maxsize=4)
def load(path: str, pattern: str) -> ByteBPE:
    """One encoder a worker process."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores belong to Spark's tasks
    return ByteBPE(path, pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text", with_offsets: bool = False) -> DataFrame:
    """``id_column``, ``ids array<int>`` and, if asked for, ``starts`` and ``ends`` in code points."""
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for batch in batches:
            for part in blocks(batch, limit=SLICE_BYTES):
                encoded = bpe.encode(part.column("text").to_pylist())
                columns = {"id": part.column("id"), "ids": pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in encoded], pa.list_(pa.int32()))}
                if with_offsets:
                    spans = [bpe.offsets(x) for x in encoded]
                    columns |= {name: pa.array([s[k].astype(np.int32) for s in spans], pa.list_(pa.int32())) for k, name in enumerate(("starts", "ends"))}
                yield pa.RecordBatch.from_pydict(columns)

    out = f"id {kind}, ids array<int>" + ", starts array<int>, ends array<int>" * with_offsets
    return docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text")).mapInArrow(run, out).withColumnRenamed("id", id_column)


def decode_documents(encoded: DataFrame, path: str, pattern: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """``id_column`` and ``text`` of each row of ids."""
    kind = encoded.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for batch in batches:
            texts = [bpe.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "text": pa.array(texts, pa.string())})

    return encoded.select(F.col(id_column).alias("id"), F.col(ids_column).alias("ids")).mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_column)


def round_trip_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for batch in batches:
            for part in blocks(batch, limit=SLICE_BYTES):
                encoded = bpe.encode(part.column("text").to_pylist())
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": part.column("doc_id"),
                        "n_tokens": pa.array([len(x) // 4 for x in encoded], pa.int64()),
                        "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in encoded], pa.string()),
                        "decoded_sha256": pa.array([hashlib.sha256(bpe.decode_bytes(x)).hexdigest() for x in encoded], pa.string()),
                    }
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
