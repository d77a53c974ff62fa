"""Prefix tries of conversations, as level-order bit vectors by shards.

1. Turns become 128-bit digests and lengths before any shuffle. A task streams
   the conversations of one base, rebuilds each, and chains digests, so a node
   (a sequence of first turns) is a digest; a conversation of any length takes
   constant memory.
2. Nodes are counted by partial aggregation, so copies are one row a node before
   they are shuffled. Nodes of one and the same set of members follow each other
   without a branch; such a chain is one node of the trie.
3. Chains are dealt to shards by the node of their first turn. A node with more
   than ``SHARD_CHAINS`` chains below it goes to the upper part, and those below
   are dealt by their next turn, and so on.
4. A task puts the chains of a shard in level order and makes a LOUDS bit
   vector, labels and arrays; sums over subtrees run backwards over the levels.
   Sums of the shards' roots are added up below the upper part, which is merged
   last: it has one chain for every ``SHARD_CHAINS`` chains, and level, at most.

Ids of conversations that end at a node are put in ranges, joined in pieces
there, and hashed piece by piece; a digest of one string is sequential, so this
last step streams in one task a node.

Defined results: rows with a null conv_id are left out. Null roles and texts are
empty. Turns of one number follow by the MD5 of role and text. Repeated rows
count. Texts of any length are taken whole. An empty table gives no rows, not
even a root. Extra columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ingestloom.llm.chunked import ragged
from ingestloom.llm.scratch import materialize

#: Chains of a shard, about.
SHARD_CHAINS = 200_000
#: Ids that are joined to one piece.
PIECE_IDS = 4_096
#: Conversations that share a base, and the most turns taken from it.
GROUP, BORROWED = 5, 8

ROOT = bytes(16)
_PATHS = "conv_id long, depth long, node binary, parent binary, first binary, n_bytes long, last boolean"
_CHAIN = ("conv_id", "n_convs", "top", "bottom", "weight")
_TRIE = "shard int, n_roots int, louds binary, labels binary, parents binary, " + ", ".join(f"{c} array<long>" for c in _CHAIN) + ", leaves array<long>, saved array<long>, children array<long>"
_ROLLUP = "conv_id long, n_convs long, top long, bottom long, node binary, parent binary, parent_conv_id long, n_children long, n_leaves long, saved long"


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, base, borrowed (turns taken from the base), turn, digest and n_bytes of every turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    c = F.col("conv_id").cast("long")
    return conversations.where(c.isNotNull()).select(
        c.alias("conv_id"), (c - c % GROUP).alias("base"), (F.crc32(c.cast("string").cast("binary")) % (BORROWED + 1)).cast("int").alias("borrowed"), "turn",
        F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"),
    )


def rebuilt_paths(conversations: DataFrame) -> DataFrame:
    """One row for every rebuilt conversation and depth, from the root on: the node there, its parent, the node of depth 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = conv = None
        first_of_base: list[tuple[bytes, int]] = []
        own = skip = depth = 0
        node, first = ROOT, None
        out: list[list] = []

        def step(digest: bytes, size: int) -> None:
            nonlocal node, first, depth
            parent, depth = node, depth + 1
            node = hashlib.blake2b(parent + digest, digest_size=16).digest()
            first = node if depth == 1 else first
            out.append([conv, depth, node, parent, first, size, False])

        def flush(keep: int) -> pa.RecordBatch:
            some = out[: len(out) - keep]
            del out[: len(out) - keep]
            columns = zip(*some, strict=True) if some else [[]] * 7
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in _PATHS.split(", ")])

        for batch in batches:
            for c, b, borrowed, digest, size in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "base", "borrowed", "digest", "n_bytes")), strict=True):
                if b != base:
                    base, first_of_base = b, []
                if c != conv:
                    if out:
                        out[-1][6] = True
                    conv, own, depth, node, first = c, 0, 0, ROOT, None
                    skip = 0 if c == b else borrowed
                    out.append([conv, 0, ROOT, None, None, 0, False])
                    for x in first_of_base[:skip]:
                        step(*x)
                if c == b and own < BORROWED:
                    first_of_base.append((digest, size))
                own += 1
                if own > skip:
                    step(digest, size)
            yield flush(1)
        if out:
            out[-1][6] = True
            yield flush(0)

    dealt = turns(conversations).repartition("base").sortWithinPartitions("base", F.col("conv_id") != F.col("base"), "conv_id", F.asc_nulls_first("turn"), "digest")
    return dealt.select("conv_id", "base", "borrowed", "digest", "n_bytes").mapInArrow(run, _PATHS)


class Louds:
    """A forest in level order: a one for every child, a zero after the last child of each node.

    The vector begins with the roots, as children of a node that is none.
    """

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.ones, self.zeros = np.flatnonzero(bits), np.flatnonzero(bits == 0)

    @classmethod
    def of(cls, n_roots: int, children: np.ndarray) -> Louds:
        counts = np.concatenate([[n_roots], children]).astype(np.int64)
        bits = np.ones(int(counts.sum()) + len(counts), np.uint8)
        bits[np.cumsum(counts + 1) - 1] = 0
        return cls(bits)

    @classmethod
    def read(cls, raw: bytes, nodes: int) -> Louds:
        return cls(np.unpackbits(np.frombuffer(raw, np.uint8), count=2 * nodes + 1))

    def write(self) -> bytes:
        return np.packbits(self.bits).tobytes()

    def parents(self) -> np.ndarray:
        """The place of each node's parent; -1 of a root: the zeros before a node's one."""
        return self.ones - np.arange(len(self.ones)) - 1

    def children(self, node: int) -> range:
        """The places of a node's children; of the roots for -1."""
        start = int(self.zeros[node]) + 1 if node >= 0 else 0
        end = int(self.zeros[node + 1])
        return range(start - node - 1, end - node - 1)

    def levels(self) -> list[tuple[int, int]]:
        """First and last place (exclusive) of the nodes of each level."""
        out, start, end = [], 0, len(self.children(-1))
        while start < end:
            out.append((start, end))
            start, end = end, int(self.zeros[end] - end)
        return out


def level_order(labels: pa.Array, parents: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """(rows in level order, number of children of each row in that order, number of roots)."""
    parent = pc.index_in(parents, value_set=labels).fill_null(-1).to_numpy().astype(np.int64)
    by_parent = np.argsort(parent, kind="stable")
    starts = np.searchsorted(parent[by_parent], np.arange(-1, len(labels) + 1))
    n_children = np.diff(starts)[1:]
    level = by_parent[: starts[1]]  # those whose parent is elsewhere
    order, n_roots = [level], len(level)
    while len(level):
        level = by_parent[ragged(starts[level + 1], n_children[level])]
        order.append(level)
    order = np.concatenate(order)
    return order, n_children[order], n_roots


def _tries(chains: DataFrame) -> DataFrame:
    """A trie of the chains of each partition. ``leaves``, ``saved`` and ``children`` are what lies below in other shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        rows = pa.Table.from_batches(rows).combine_chunks()
        column = lambda name: rows.column(name).combine_chunks()
        order, n_children, n_roots = level_order(column("node"), column("parent"))
        at = pa.array(order)
        glued = lambda name, some: pa.array([b"".join(x or ROOT for x in column(name).take(some).to_pylist())], pa.binary())
        one = lambda name: pa.ListArray.from_arrays([0, len(order)], column(name).take(at).cast(pa.int64()))
        out = {"shard": pa.array([rows.column("shard")[0].as_py()], pa.int32()), "n_roots": pa.array([n_roots], pa.int32()), "louds": pa.array([Louds.of(n_roots, n_children).write()], pa.binary())}
        out |= {"labels": glued("node", at), "parents": glued("parent", at[:n_roots])}
        yield pa.RecordBatch.from_pydict(out | {c: one(c) for c in (*_CHAIN, "leaves", "saved", "children")})

    return chains.mapInArrow(run, _TRIE)


def _rollups(tries: DataFrame) -> DataFrame:
    """Sums over the subtrees of every trie, a row a chain. ``parent`` is set for roots only; theirs lies elsewhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k] for c in batch.schema.names}
                value = {c: row[c].values.to_numpy(zero_copy_only=False).astype(np.int64) for c in (*_CHAIN, "leaves", "saved", "children")}
                n, n_roots = len(value["conv_id"]), row["n_roots"].as_py()
                louds = Louds.read(row["louds"].as_py(), n)
                parent = louds.parents()
                children = value["children"] + np.bincount(parent[n_roots:], minlength=n)
                leaves, saved = value["leaves"] + (children == 0), value["saved"] + value["weight"]
                for start, end in reversed(louds.levels()[1:]):
                    np.add.at(leaves, parent[start:end], leaves[start:end])
                    np.add.at(saved, parent[start:end], saved[start:end])
                cut = lambda raw, m: pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), m, [None, raw.as_buffer()]).cast(pa.binary())
                above = pa.concat_arrays([cut(row["parents"], n_roots), pa.nulls(n - n_roots, pa.binary())])
                inside = np.arange(n) >= n_roots
                out = {c: pa.array(value[c]) for c in _CHAIN[:4]} | {"node": cut(row["labels"], n), "parent": above, "parent_conv_id": pa.array(value["conv_id"][np.maximum(parent, 0)], mask=~inside)}
                yield pa.RecordBatch.from_pydict(out | {"n_children": pa.array(children), "n_leaves": pa.array(leaves), "saved": pa.array(saved)})

    return tries.mapInArrow(run, _ROLLUP)


def _chains(nodes: DataFrame) -> DataFrame:
    """Nodes with the same members: ``node`` is the last, ``parent`` lies above the first, ``anchor`` is of depth 1."""
    return nodes.groupBy("conv_id", "n_convs").agg(
        F.min("depth").alias("top"), F.max("depth").alias("bottom"), F.sum((F.col("n_convs") - 1) * F.col("n_bytes")).alias("weight"),
        F.max_by("node", "depth").alias("node"), F.min_by("parent", "depth").alias("parent"), F.min_by("first", "depth").alias("anchor"),
    )


def _route(chains: DataFrame, paths: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """(chains of the upper part, the others with the anchor of their shard)."""
    upper, light = [chains.where("top = 0")], []
    pending, depth = chains.where("top > 0"), 1
    while True:
        heavy = materialize(pending.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > limit).select("anchor"))
        if heavy.isEmpty():
            light.append(pending)
            break
        light.append(pending.join(heavy, "anchor", "left_anti"))
        below = pending.join(heavy, "anchor", "left_semi")
        upper.append(below.where(F.col("top") == depth))
        depth += 1
        at = paths.where(F.col("depth") == depth).select("conv_id", F.col("node").alias("anchor"))
        pending = materialize(below.where(F.col("top") >= depth).drop("anchor").join(at, "conv_id"))
    together = lambda parts: parts[0] if len(parts) == 1 else together([parts[0].unionByName(parts[1]), *parts[2:]])
    return together(upper), together(light)


def conversation_tries(chains: DataFrame, paths: DataFrame, limit: int = SHARD_CHAINS) -> tuple[DataFrame, DataFrame]:
    """(tries of all shards, chains of the upper part)."""
    spark = chains.sparkSession
    upper, light = _route(chains, paths, limit)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-2 * chains.count() // limit))
    nothing = {c: F.lit(0).cast("long") for c in ("leaves", "saved", "children")}
    dealt = light.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(n)).cast("int")).withColumns(nothing).repartitionById(n, F.col("shard"))
    return materialize(_tries(dealt)), materialize(upper)


def _merged(tries: DataFrame, upper: DataFrame) -> DataFrame:
    """The sums of all chains: those of the shards, and the upper part's with what its shards sum up to."""
    shards = materialize(_rollups(tries))
    roots = shards.where("parent is not null")
    below = roots.groupBy(F.col("parent").alias("node")).agg(F.sum("n_leaves").alias("leaves"), F.sum("saved").alias("saved"), F.count("*").alias("children"))
    filled = upper.join(below, "node", "left").na.fill(0, ["leaves", "saved", "children"]).withColumn("shard", F.lit(-1))
    top = materialize(_rollups(_tries(filled.coalesce(1))))  # one row for a whole shard below, and level, at most
    above = upper.select(F.col("node").alias("parent"), F.col("conv_id").alias("_above"))
    linked = roots.join(above, "parent", "left").withColumn("parent_conv_id", F.col("_above")).drop("_above")
    return shards.where("parent is null").unionByName(linked).unionByName(top)


def ends(paths: DataFrame) -> DataFrame:
    """node and the SHA-256 of the ids that end there, ascending and joined by commas."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids = None, []
        pieces: list[tuple[bytes, int, str]] = []
        for batch in batches:
            for x, conv in zip(batch.column("node").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
                if ids and (x != node or len(ids) >= PIECE_IDS):
                    pieces.append((node, ids[0], ",".join(map(str, ids))))
                    ids = []
                node = x
                ids.append(conv)
            yield made(pieces)
            pieces = []
        if ids:
            yield made([(node, ids[0], ",".join(map(str, ids)))])

    def made(pieces):
        columns = list(zip(*pieces, strict=True)) if pieces else [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.binary(), pa.int64(), pa.string()), strict=True)], ["node", "at", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node = state = None
        for batch in batches:
            done: list[tuple[bytes, str]] = []
            for x, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if x != node:
                    if node is not None:
                        done.append((node, state.hexdigest()))
                    node, state = x, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], ["node", "ends_sha256"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()], pa.string())], ["node", "ends_sha256"])

    last = paths.where("last").select("node", "conv_id")
    pieces = last.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(join, "node binary, at long, ids string")
    return pieces.repartition("node").sortWithinPartitions("node", "at").mapInArrow(digest, "node binary, ends_sha256 string")


def prefix_nodes(conversations: DataFrame, shard_chains: int = SHARD_CHAINS) -> DataFrame:
    """Every node of the rebuilt conversations with its sums."""
    paths = materialize(rebuilt_paths(conversations))
    nodes = materialize(paths.groupBy("node", "parent", "first", "depth", "n_bytes").agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")))
    chains = materialize(_chains(nodes))
    sums = materialize(_merged(*conversation_tries(chains, paths, shard_chains)).select("conv_id", "n_convs", "top", "bottom", "parent_conv_id", "n_children", "n_leaves", "saved"))
    earlier = Window.partitionBy("conv_id", "n_convs").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    shared = nodes.where("n_convs > 1").withColumn("_before", F.coalesce(F.sum((F.col("n_convs") - 1) * F.col("n_bytes")).over(earlier), F.lit(0)))
    rows = shared.unionByName(nodes.where("n_convs = 1").withColumn("_before", F.lit(0).cast("long")))  # a single member saves nothing, however long it is
    rows = rows.join(sums, ["conv_id", "n_convs"]).join(ends(paths), "node", "left")
    return rows.select(
        "conv_id", "depth", F.when(F.col("depth") > F.col("top"), F.col("conv_id")).otherwise(F.col("parent_conv_id")).alias("parent_conv_id"), "n_convs",
        F.when(F.col("depth") < F.col("bottom"), F.lit(1)).otherwise(F.col("n_children")).cast("long").alias("n_children"), "n_leaves", (F.col("saved") - F.col("_before")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )
