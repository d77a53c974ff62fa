"""Token files: the coder, the chunked encoder, and files against a plain encoding."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from ingestloom.llm import chunked, rans, scratch, tokenfile
from ingestloom.llm.bytesview import byte_view

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [*"ab .,'s\n\t!3é à’—中 tT", " ", "\x1c", "\x85", "'s", " ", "  ", "\n", "<|endoftext|>", "e."]


@pytest.fixture(scope="module")
def plain():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    return lambda texts: [e.ids for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("n", [0, 1, rans.LANES - 1, rans.LANES, rans.LANES * rans.INTERVAL + 1, rans.BLOCK])
def test_blocks_round_trip(n):
    ids = (np.random.default_rng(n).zipf(1.3, n) % 5000).astype(np.uint32)
    table = rans.Table(rans.shares(np.bincount(ids, minlength=5000)))
    block = rans.encode(ids, table, b"more")
    back, extra = rans.decode(block, table)
    assert (back == ids).all() and extra == b"more"
    if n > 100_000:  # within three hundredths of the entropy of the table
        p = np.bincount(ids) / n
        assert len(block) < 1.03 * n * -(p[p > 0] * np.log2(p[p > 0])).sum() / 8 + 10_000


def test_corrupt_blocks_are_told():
    ids = np.arange(3000, dtype=np.uint32) % 7
    table = rans.Table(rans.shares(np.bincount(ids)))
    block = bytearray(rans.encode(ids, table))
    block[-1] ^= 1
    with pytest.raises(rans.CorruptBlock):
        rans.decode(bytes(block), table)
    with pytest.raises(rans.CorruptBlock):
        rans.decode(rans.encode(ids, table), rans.Table(rans.shares(np.bincount(ids % 3, minlength=7) + 1)))
    with pytest.raises(ValueError):
        rans.encode(np.array([9], np.uint32), rans.Table(rans.shares(np.array([1, 1] + [0] * 8))))


def test_shares_fill_the_table_and_keep_every_id():
    for counts in ([1], [10**12, 1, 1, 0], [1] * 70_000, [3, 0, 5]):
        share = rans.shares(np.array(counts))
        assert share.sum() == 1 << rans.BITS and ((share > 0) == (np.array(counts) > 0)).all()


def test_joined_checksums():
    a, b = b"some bytes", bytes(range(256)) * 9
    assert rans.joined_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
    assert rans.joined_crc(zlib.crc32(a), 0, 0) == zlib.crc32(a)


def test_chunks_encode_as_whole_texts(plain):
    rng = random.Random(3)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 25))) for _ in range(4000)] + ["", None, " ", "\n", "the end. " * 500]
    encoder = chunked.load(PATH)
    for part in (texts, texts[::-1]):  # the second time from what the worker keeps
        ids, counts = encoder.encode(*byte_view(pa.array(part, pa.string())))
        want = plain(part)
        assert counts.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


def _write(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, part string, n_tokens int")
    folder = scratch.folder(spark)
    tokenfile.write_tokens(docs, folder, PATH)
    return folder


def test_files_hold_all_documents_in_order(spark, plain, monkeypatch):
    monkeypatch.setattr(rans, "BLOCK", 600)  # long texts fill several blocks
    rng = random.Random(8)
    texts = ["", None, "word " * 2500, *["".join(rng.choice(ODD) for _ in range(rng.randint(0, 300))) for _ in range(60)]]
    rows = [(k * 7 % 63 - 20, t, "x", "y", 1) for k, t in enumerate(texts)] + [(None, "null id", None, None, None), (None, None, None, None, None), (5, "again", "x", "y", 1), (5, "again", "x", "y", 1)]
    folder = _write(spark, rows)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in tokenfile.token_digests(spark, folder).collect())
    want = {}
    for (doc_id, text, *_), ids in zip(rows, plain([r[1] for r in rows]), strict=True):
        ids = [*ids, 0]
        want.setdefault(doc_id, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    at, left = 0, {k: list(v) for k, v in want.items()}
    for start, doc_id, n, crc in got:
        assert start == at
        at += n
        left[doc_id].remove((n, crc))
    assert not any(left.values())
    order = [r[1] for r in got]
    assert order == sorted(order, key=lambda d: (d is not None, d or 0))
    manifest = tokenfile.block_starts(spark, folder)
    assert manifest.where("piece > 0").count() >= 4 and manifest.agg({"n_tokens": "max"}).first()[0] == 600
    pieces = sorted((r.start, r.ids) for r in tokenfile.read_tokens(spark, folder).collect())
    assert pieces[0][0] == 0 and sum(len(i) for _, i in pieces) == at
    some = tokenfile.read_tokens(spark, folder, 1000, 1400).collect()
    assert 0 < len(some) < len(pieces) and {r.start for r in some} >= {s for s, i in pieces if 1000 <= s < 1400}


def test_a_frequent_doc_id_is_dealt_over_ranges():
    bounds = np.array([3, 7, 7, 7, 9])
    parts = tokenfile._deal(pa.array([1, 3, 5, *[7] * 90, 8, None], pa.int64()), np.arange(95), bounds).tolist()
    assert parts[0] == 0 and parts[1] == 0 and parts[2] == 1 and set(parts[3:93]) == {1, 2, 3} and parts[93:] == [4, 0]


def test_empty_table(spark):
    folder = _write(spark, [])
    assert tokenfile.token_digests(spark, folder).count() == 0 and tokenfile.read_tokens(spark, folder).count() == 0
