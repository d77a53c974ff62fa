"""Prefix tries against a plain computation over every prefix."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from ingestloom.llm import tries

SCHEMA = "conv_id long, turn int, role string, text string, node string, depth int, parent_conv_id string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, None) for r in rows], SCHEMA).repartition(5)


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h, base = zlib.crc32(str(c).encode()) % 9, c - (c % 5 if c >= 0 else -(-c % 5))
        rebuilt[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in rebuilt.items():
        ends[turns].append(c)
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in members.items()
    )


def got(spark, rows, **more):
    return sorted(tuple(r) for r in tries.prefix_nodes(frame(spark, rows), **more).collect())


def made(seed, n=60):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-20, 400), n):
        for turn in range(rng.randint(1, 9)):
            rows.append((c, rng.choice([turn, turn, turn, None, 0]), rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "ü", "", None, "long " * 9])))
    return rows + [(None, 1, "user", "no id"), (None, None, None, None)]


@pytest.mark.parametrize("limit", [tries.SHARD_CHAINS, 6, 1])
def test_nodes_are_those_of_a_plain_computation(spark, limit):
    rows = made(3)
    assert got(spark, rows, shard_chains=limit) == brute(rows)


def test_copies_and_one_long_conversation(spark, monkeypatch):
    talk = [("system", "be kind"), ("user", "hello"), ("assistant", "hi"), ("user", "more")]
    rows = [(c, t, *x) for c in range(0, 900, 5) for t, x in enumerate(talk[: 2 + c % 3])]
    rows += [(10_003, t, "user", f"turn {t}" * 3) for t in range(700)] + [(10_000, t, "user", f"turn {t}" * 3) for t in range(60)]
    rows += [(c, t, *x) for c in (7, 8, 11) for t, x in enumerate(talk)] * 2
    assert got(spark, rows) == brute(rows)
    assert got(spark, rows, shard_chains=2) == brute(rows)


def test_first_turns_that_all_share(spark):
    rows = [(c, t, "user", x) for c in range(0, 60, 5) for t, x in enumerate(["same", "too", str(c % 2), str(c % 3)])]
    assert got(spark, rows, shard_chains=1) == brute(rows)


def test_bit_vectors():
    #       0            1
    #     2   3          4
    #         5
    parents = np.array([-1, -1, 0, 0, 1, 3])
    names = [b"%016d" % k for k in range(6)]
    mixed = [4, 0, 5, 2, 1, 3]
    labels = pa.array([names[k] for k in mixed], pa.binary())
    order, children, n_roots = tries.level_order(labels, pa.array([names[parents[k]] if parents[k] >= 0 else None for k in mixed], pa.binary()))
    louds = tries.Louds.read(tries.Louds.of(n_roots, children).write(), 6)
    assert n_roots == 2 and len(louds.bits) == 13 and louds.levels() == [(0, 2), (2, 5), (5, 6)]
    at = [mixed[k] for k in order]
    for place, node in enumerate(at):
        up = louds.parents()[place]
        assert (at[up] if up >= 0 else -1) == parents[node]
        assert {at[k] for k in louds.children(place)} == {k for k in range(6) if parents[k] == node}
    assert {at[k] for k in louds.children(-1)} == {0, 1}


def test_pieces_of_ends(spark, monkeypatch):
    rows = [(c, 0, "user", "x") for c in range(0, 9000, 10)]
    want = hashlib.sha256(",".join(str(c) for c in range(0, 9000, 10)).encode()).hexdigest()
    assert {r[7] for r in got(spark, rows) if r[1] == 1} == {want}


def test_empty_tables(spark):
    assert got(spark, []) == [] and got(spark, [(None, 0, "user", "x")]) == []
