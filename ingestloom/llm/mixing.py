"""Mixing sources to target weights by cube-method balanced sampling.

Every source has a word target; a document's expected number of copies is its
source's target over its source's size. Whole copies are taken outright. The
fractional part is an inclusion probability, and the cube method moves the
vector of these probabilities along directions in the null space of the two
balancing constraints (documents taken, words taken) until almost all are 0 or
1. The flight runs in blocks of a source, so a source of any size is spread
over many tasks; a block leaves at most two open documents, which fly again
together, and what the last flight of a source leaves is a landing problem of
at most two documents, solved by enumeration.

Extra columns, whatever their names, are dropped by ``mix_documents`` and kept by
``apply_mix``. Very long texts are counted whole.

Defined results: null or blank text has size 0 and is never taken. A source
whose size is 0 has target 0. Null sources form one source, ordered last.
Repeated rows are separate documents; where all columns agree
``apply_mix`` takes one of them as often as the mix takes all. Reruns agree: order and random numbers
depend on the rows and the seed alone. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from ingestloom.llm.bytesview import blocks, word_counts
from ingestloom.llm.names import fresh
from ingestloom.llm.scratch import materialize

#: Documents of a block, on average.
BLOCK_DOCS = 2048
#: Source tables of at most so many rows are broadcast; larger ones are joined by shuffle.
BROADCAST_SOURCES = 10_000
EPSILON = 1e-9


def _row_key(docs: DataFrame) -> F.Column:
    """A number that rows share whose columns all agree, but for columns that cannot be hashed."""
    plain = [F.col(f"`{f.name}`") for f in docs.schema.fields if not any(kind in f.dataType.simpleString() for kind in ("map<", "variant"))]
    return F.xxhash64(*plain)


def document_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words, and the number of the row, of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch):
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "source": part.column("source"), "size": pa.array(word_counts(part.column("text")), pa.int64()), "key": part.column("key")})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"), _row_key(docs).alias("key")).mapInArrow(run, "doc_id long, source string, size long, key long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """source, source_size, n_docs, source_rank and target: ``share`` of all words dealt by weight, none above ``cap`` times its source.

    The excess over a cap goes to the other sources by weight until no source
    is above. Only sums over sources reach the driver.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    # one row a source; the order of all sources decides the weights
    ranked = totals.withColumn("source_rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("source_rank") % len(weights) + 1).cast("int"))
    ranked = materialize(ranked.withColumn("weight", weight).withColumn("cap", F.lit(cap) * F.col("source_size")))
    level, budget = 0.0, None
    while True:
        capped = F.col("weight") * F.lit(level) >= F.col("cap")
        total, open_weight, fixed, n_open = ranked.agg(F.sum("source_size"), F.sum(F.when(~capped, F.col("weight"))), F.sum(F.when(capped, F.col("cap"))), F.count(F.when(~capped, 1))).first()
        budget = share * (total or 0)
        if not n_open:
            break
        higher = max(0.0, budget - (fixed or 0.0)) / open_weight
        if higher <= level * (1 + 1e-12):
            break
        level = higher
    return ranked.withColumn("target", F.least(F.col("cap"), F.col("weight") * F.lit(level)).cast("double")).drop("weight", "cap")


def _move(p: list[float], at: tuple[int, ...], u: tuple[float, ...], draw: float) -> None:
    """One step of the flight: along ``u`` or against it as far as probabilities allow, with expectation zero."""
    forth = back = float("inf")
    for i, x in zip(at, u, strict=True):
        if x > 0:
            forth, back = min(forth, (1 - p[i]) / x), min(back, p[i] / x)
        elif x < 0:
            forth, back = min(forth, -p[i] / x), min(back, (p[i] - 1) / x)
    step = forth if draw * (forth + back) < back else -back
    for i, x in zip(at, u, strict=True):
        p[i] += step * x
        if p[i] < EPSILON:
            p[i] = 0.0
        elif p[i] > 1 - EPSILON:
            p[i] = 1.0


def fly(probabilities: np.ndarray, sizes: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Flight phase: keeps the sums of probabilities and of probability times size; at most two stay fractional."""
    p, size = probabilities.astype(float).tolist(), sizes.astype(float).tolist()
    draws = rng.random(2 * len(p) + 8).tolist()
    window: list[int] = []
    for i in range(len(p)):
        if not EPSILON < p[i] < 1 - EPSILON:
            p[i] = float(round(p[i]))
            continue
        window.append(i)
        if len(window) == 3:
            a, b, c = window
            u = (size[c] - size[b], size[a] - size[c], size[b] - size[a])  # orthogonal to (1, 1, 1) and to the sizes
            if not any(u):
                u = (1.0, -1.0, 0.0)
            _move(p, (a, b, c), u, draws.pop())
            window = [k for k in window if 0.0 < p[k] < 1.0]
    if len(window) == 2 and size[window[0]] == size[window[1]]:
        _move(p, tuple(window), (1.0, -1.0), draws.pop())
    return np.array(p)


def land(probabilities: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Landing phase over the few open documents: the choice whose words, then documents, are nearest to expectation."""
    p = probabilities.copy()
    at = np.flatnonzero((p > 0) & (p < 1))
    if len(at):
        choices = (np.arange(1 << len(at))[:, None] >> np.arange(len(at))) & 1
        off = choices - p[at]
        order = np.lexsort((np.abs(off.sum(axis=1)), np.abs(off @ sizes[at])))
        p[at] = choices[order[0]]
    return p


def _flight(df: DataFrame, seed: int, last: bool) -> DataFrame:
    """Flies each (source_rank, block) of doc_id, size, p; lands it if ``last``."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "doc_id", "key"], ascending=[False, True, True], na_position="last", kind="stable", ignore_index=True)
        rng = np.random.default_rng([seed, int(key[0]), int(key[1])])
        p = fly(rows.p.to_numpy(), rows["size"].to_numpy(), rng)
        if last:
            p = land(p, rows["size"].to_numpy(float))
        return rows.assign(p=p)

    # dealt by number: small rows would all be joined to one task, though a flight takes long
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, "source_rank", "block").groupBy("source_rank", "block").applyInPandas(run, df.schema)


def mix_copies(sizes: DataFrame, seed: int = 7, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, cap: float = 2.0, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken and key for rows of doc_id, source, size, key."""
    targets = source_targets(sizes, weights, share, cap)
    n_sources, most = targets.agg(F.count("*"), F.max("n_docs")).first()
    table = targets.select(F.col("source").alias("of"), "source_size", "target", "source_rank", "n_docs")
    if n_sources <= BROADCAST_SOURCES:
        table = F.broadcast(table)
    joined = sizes.join(table, sizes["source"].eqNullSafe(table["of"]), "left").drop("source", "of")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rated = joined.withColumn("whole", F.floor(rate + EPSILON).cast("long")).withColumn("p", F.greatest(F.lit(0.0), rate - F.floor(rate + EPSILON)))
    n_blocks = F.ceil(F.col("n_docs") / F.lit(block_docs))
    rated = rated.withColumn("block", F.pmod(F.xxhash64("doc_id", "size", "key"), n_blocks)).withColumn("p", F.when(F.col("size") > 0, F.col("p")).otherwise(0.0))
    fixed = rated.select("doc_id", "size", "source_size", "target", "source_rank", "block", "whole", "p", "key")
    blocks_left = -(-int(most or 0) // block_docs)
    done, turn = [], 0
    flown = _flight(fixed, seed, blocks_left <= 1)
    while blocks_left > 1:
        turn += 1
        blocks_left = -(-blocks_left // (block_docs // 2))
        flown = materialize(flown)
        is_open = (F.col("p") > 0) & (F.col("p") < 1)
        done.append(flown.where(~is_open))
        again = flown.where(is_open).withColumn("block", F.pmod(F.col("block"), F.lit(blocks_left)))
        flown = _flight(again, seed + turn, blocks_left <= 1)
    for part in done:
        flown = flown.unionByName(part)
    copies = F.col("whole") + F.round("p").cast("long")
    return flown.select("doc_id", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), "key")


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """Digest of the mix of all ``docs``: doc_id, size, source_size, target, taken."""
    sizes = materialize(document_sizes(docs))
    return mix_copies(sizes, **options).select("doc_id", "size", "source_size", "target", "taken")


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the columns of ``docs``, each document as often as it was taken; none without words is."""
    sizes = materialize(document_sizes(docs))
    doc, key, copies, rows = fresh(docs.columns, "doc", "key", "copies", "rows")
    taken = mix_copies(sizes, **options).where("size > 0").groupBy("doc_id", "key").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows"))
    taken = materialize(taken.where("copies > 0")).toDF(doc, key, copies, rows)
    same = docs["doc_id"].cast("long").eqNullSafe(taken[doc]) & (_row_key(docs) == taken[key])
    joined = docs.join(taken.hint("shuffle_hash"), same)
    repeat = F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))

    def dealt(some: DataFrame) -> DataFrame:
        return some.withColumn(fresh(some.columns, "nth")[0], repeat).select(*docs.columns)

    out = dealt(joined.where(F.col(rows) == 1))
    if taken.where(F.col(rows) > 1).isEmpty():
        return out
    one = joined.where(F.col(rows) > 1).groupBy(doc, key, copies).agg(F.first(F.struct(*[docs[c] for c in docs.columns])).alias("row"))
    return out.unionByName(dealt(one.select("row.*", copies)))
