"""Ranked lexical search against a plain computation."""

import math
import random
import re
from collections import Counter

import numpy as np

from ingestloom.llm import lexical

FOLD = str.maketrans(lexical._UPPER, lexical._LOWER)


def words(text):
    return re.findall(lexical.PATTERN, (text or "").translate(FOLD))


def brute(docs, items, best):
    counts = [(d, Counter(words(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n_docs, n_terms = len(counts), sum(sum(c.values()) for _, c in counts)
    out = []
    for item, text in items:
        found = []
        for d, c in counts:
            norm, score = 50 + 50 * sum(c.values()) * n_docs // n_terms, 0
            for t in set(words(text)):
                if c[t]:
                    df = sum(t in x for _, x in counts)
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * norm))
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(item, k, d, -s) for k, (s, _, _, d) in enumerate(sorted(found)[:best], 1)]
    return sorted(out, key=str)


def frames(spark, docs, items):
    extra = lambda rows: [(*r, "x", 1) for r in rows]
    return spark.createDataFrame(extra(docs), "doc_id long, text string, terms string, n int"), spark.createDataFrame(extra(items), "item_id long, text string, terms string, rank int")


def made(seed, n=120):
    rng = random.Random(seed)
    vocabulary = ["Über", "straße", "a", "B", "c3", "the", "THE", "x-y", "naïve", "日本", "𝔘nicode", "_", "é", *[f"w{k}" for k in range(30)]]
    text = lambda m: "".join(rng.choice(vocabulary) + rng.choice([" ", "\n", "--", "\t", ".", "\x7f"]) for _ in range(rng.randint(0, m)))
    docs = [(k, text(40)) for k in range(n)] + [(n + k, "same words here the") for k in range(30)] + [(3, "the a"), (None, "same words here the"), (None, None), (7, ""), (8, "the long " * 4000)]
    items = [(k, text(12)) for k in range(9)] + [(20, None), (21, ""), (22, "absent"), (23, "same SAME words"), (None, "the here")]
    return docs, items


def test_ranks_are_those_of_a_plain_computation(spark):
    docs, items = made(4)
    got = sorted((tuple(r) for r in lexical.rank_documents(*frames(spark, docs, items), best=12).collect()), key=str)
    assert got == brute(docs, items, 12)


def test_blocks_of_items_and_small_runs_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_ITEMS", 4)
    docs, items = made(6, 60)
    got = sorted((tuple(r) for r in lexical.rank_documents(*frames(spark, docs, items), best=5).collect()), key=str)
    assert got == brute(docs, items, 5)


def test_radix_order_is_a_stable_sort():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << 40, 5000, dtype=np.uint64) >> np.uint64(5)
    assert (lexical.radix_order(keys, 0, 40) == np.argsort(keys, kind="stable")).all()
    assert (lexical.radix_order(keys, 12, 40) == np.argsort(keys >> np.uint64(12), kind="stable")).all()


def test_heaps_keep_the_best(monkeypatch):
    rng = np.random.default_rng(2)
    kept, entries = lexical._Best(3, 7), []
    for run in range(20):
        items = np.sort(rng.integers(0, 3, 40))
        scores, keys = rng.integers(1, 15, 40), rng.integers(0, 99, 40)
        kept.add(items, scores, keys)
        entries += list(zip(items.tolist(), scores.tolist(), (-keys).tolist(), strict=True))
    for item in range(3):
        assert sorted(kept.heaps[item], reverse=True) == sorted(((s, k) for i, s, k in entries if i == item), reverse=True)[:7]


def test_empty_tables(spark):
    docs, items = made(1, 5)
    for a, b in (([], items), (docs, []), ([], []), ([(1, None)], items)):
        assert lexical.rank_documents(*frames(spark, a, b)).collect() == []
