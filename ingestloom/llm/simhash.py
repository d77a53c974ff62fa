"""SimHash near-duplicates by multi-index hashing.

A fingerprint is the majority vote, bit by bit, of the hashes of a text's word
shingles. Each fingerprint is cut into segments, and there is a table for each
segment that holds every fingerprint under its value there. A search enumerates
the Hamming ball of radius one around each of its own segments, fetches what the
tables hold under the members of the balls, and verifies each match by its
complete distance.

``near_duplicates`` links 64-bit fingerprints at ``DISTANCE`` or fewer differing
bits. With two segments of 32 bits one of them differs in at most one bit, so no
link is missed. A table entry of more than ``BUCKET`` fingerprints is split: what
it holds and what looks there differ by one bit at most in this segment, so they
must come within two bits in the other, and balls of radius one around both meet
in a member. A part then holds at most 33 fingerprints and meets at most 1 089.

``drop_near_duplicates`` takes ``DOCUMENT_WORDS`` words a shingle and wide
fingerprints, whose ``shape`` follows from the number of texts. Balls of radius one
round the segments of both texts meet where a segment differs in two bits at most,
which at similarity 0.8 happens in one of the segments with a chance of ``LEAST_MET``
or more, at every size of the corpus; segments are so long that a text meets few
others by chance. Matches are compared by complete distance, whose bound lies six
deviations above the mean at the least similarity, and then by the Jaccard similarity
of their whole sets of shingles. Texts of under ten words or so have votes too few
for these chances: four shingles of five are met with about 0.7. Groups are found through
any of their pairs. What is in an entry is first compared with its least member; only
where the entry then still holds several components are its other members compared,
by distance within the join, and none are left out.

Defined results: null text and text without words have fingerprint zero, which
``near_duplicates`` links like any other and ``drop_near_duplicates`` leaves
alone. Very long texts are processed whole. Repeated rows and exact copies share
a fingerprint and so a component; of rows that repeat doc_id and text one stays.
Null doc_ids take the component of their fingerprint and stand last where the
least doc_id is chosen. Extra columns, whatever their names, are dropped by
``near_duplicates`` and kept by ``drop_near_duplicates``. An empty table gives an
empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ingestloom.llm.bytesview import blocks, byte_view, mix, prefix_hashes, span_hashes, word_spans
from ingestloom.llm.components import connected_components
from ingestloom.llm.names import fresh
from ingestloom.llm.scratch import materialize

SHINGLE_WORDS = 3
SEED = 42
#: Segments of a 64-bit fingerprint; balls of radius one cover two differing bits in all.
SEGMENT_BITS = 32
DISTANCE = 2
#: Fingerprints of a table entry above which it is split by the other segment.
BUCKET = 64

#: Words of a shingle, similarity, and wide fingerprints of the de-duplication of whole documents.
DOCUMENT_WORDS = 5
MIN_SIMILARITY = 0.8
#: Chance at the least similarity that two texts are compared, others that a text may meet by chance, and bits that a segment may have.
LEAST_MET, BY_CHANCE, BITS = 0.92, 4, range(24, 49)


@dataclass(frozen=True)
class Shape:
    """Segments of a wide fingerprint, bits of each, and bits in all that may differ before shingles are compared."""

    segments: int
    bits: int
    distance: int


def shape(texts: int, least: float = MIN_SIMILARITY) -> Shape:
    """The shape of fewest table rows among those that bring similar texts together with a chance of ``LEAST_MET``.

    Two sets of similarity J have a cosine of 2J / (1 + J) if they are of one size, and more
    otherwise; a bit differs with the angle's share of a half turn. Of the ``texts`` a text meets
    ``BY_CHANCE`` others at most by chance, a pair counted once, so that the pairs grow as the texts do.
    """
    flip = math.acos(min(1.0, 2 * least / (1 + least))) / math.pi

    def needed(bits: int) -> int:
        met = sum(math.comb(bits, k) * flip**k * (1 - flip) ** (bits - k) for k in range(3))
        return math.ceil(math.log(1 - LEAST_MET) / math.log1p(-met)) if met < 1 else 1

    def by_chance(bits: int) -> float:
        return needed(bits) * texts * (1 + bits + math.comb(bits, 2)) / (2 << bits)

    bits = next((b for b in BITS if by_chance(b) <= BY_CHANCE), BITS[-1])
    segments = needed(bits)
    total = segments * bits
    return Shape(segments, bits, min(total, math.ceil(total * flip + 6 * math.sqrt(total * flip * (1 - flip)))))


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of a text, unsigned; zero without words."""
    from xxhash import xxh64_intdigest

    found = text.encode().lower().split() if text else []  # bytes: A-Z only, and exactly the six separators
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(found) > words:
        starts, ends = starts[: len(found) - words + 1], ends[words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    hashes = np.array([xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)], np.uint64)
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        bits = np.unpackbits(hashes[at : at + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id and fingerprint (as a signed long) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t.as_py(), words) for t in batch.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "fp": pa.array(prints, pa.int64())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _bits(n: int) -> list[int]:
    return [1 << b for b in range(n)]


def _segment(fp: Column, s: int) -> Column:
    """Segment ``s`` of a fingerprint, with the number of the table above it."""
    value = F.shiftrightunsigned(fp, s * SEGMENT_BITS).bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1))
    return value.bitwiseOR(F.lit(s << SEGMENT_BITS))


def _ball(value: Column, bits: int) -> Column:
    """The Hamming ball of radius one round a segment."""
    return F.array(value, *[value.bitwiseXOR(F.lit(b)) for b in _bits(bits)])


def fingerprint_links(prints: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(a, b): every pair of different fingerprints ``fp`` that a table entry brings together within ``DISTANCE`` bits."""
    tables = prints.select("fp", F.explode(F.array(*[_segment(F.col("fp"), s) for s in range(2)])).alias("key"))
    balls = prints.select("fp", F.explode(F.flatten(F.array(*[_ball(_segment(F.col("fp"), s), SEGMENT_BITS) for s in range(2)]))).alias("key"))
    sizes = materialize(tables.groupBy("key").agg(F.count("*").alias("n")))
    large = sizes.where(F.col("n") > bucket).select("key")
    entries = tables.join(sizes.where(F.col("n") <= bucket).select("key").hint("shuffle_hash"), "key").groupBy("key").agg(F.collect_list("fp").alias("held"))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= DISTANCE
    found = balls.join(entries.hint("shuffle_hash"), "key").select("fp", F.explode("held").alias("other")).where("other < fp").where(near)
    if large.isEmpty():
        return found.select(F.col("fp").alias("a"), F.col("other").alias("b"))

    # the other segment of a fingerprint that is in table 1 is segment 0, and the reverse
    def parts(rows: DataFrame) -> DataFrame:
        rest = F.when(F.col("key") < F.lit(1 << SEGMENT_BITS), _segment(F.col("fp"), 1)).otherwise(_segment(F.col("fp"), 0))
        return rows.join(large.hint("shuffle_hash"), "key").select("key", "fp", F.explode(_ball(rest, SEGMENT_BITS)).alias("part"))

    held = parts(tables).groupBy("key", "part").agg(F.collect_list("fp").alias("held"))  # 33 at most
    split = parts(balls).join(held.hint("shuffle_hash"), ["key", "part"]).select("fp", F.explode("held").alias("other")).where("other < fp").where(near)
    return found.unionByName(split).select(F.col("fp").alias("a"), F.col("other").alias("b"))


def fingerprint_components(prints: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(fp, component_id) of every fingerprint in ``prints`` (doc_id, fp); links at ``DISTANCE`` or fewer bits."""
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    # the table is small and its keys are many: spread it before they are made
    spread = nodes.select("fp").repartition(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    linked = connected_components(fingerprint_links(spread, bucket))
    rooted = materialize(nodes.join(linked, nodes["fp"] == linked["node"], "left").select("fp", "rep", F.coalesce("component", "fp").alias("root")))
    least = materialize(rooted.groupBy("root").agg(F.min("rep").alias("component_id")))
    return rooted.join(least, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, fingerprint in hexadecimal, and component_id of every document."""
    prints = materialize(fingerprints(docs, words))
    named = materialize(fingerprint_components(prints))
    joined = prints.join(named, "fp")
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- whole documents: wide fingerprints, exact similarity ---------------------------


def shingle_hashes(column: pa.Array, words: int = DOCUMENT_WORDS) -> list[np.ndarray]:
    """The different hashes of each text's shingles; a text of fewer words is one shingle, and one without words none."""
    data, offsets = byte_view(column)
    upper = (data >= 0x41) & (data <= 0x5A)
    starts, ends, first = word_spans(data, offsets)
    hashes = span_hashes(prefix_hashes(data + upper.astype(np.uint8) * np.uint8(32)), starts, ends)
    out = []
    for low, high in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        mine = hashes[low:high]
        n = max(1, len(mine) - words + 1) if len(mine) else 0
        total = np.zeros(n, np.uint64)
        for k in range(min(words, len(mine))):
            total = mix(total * np.uint64(0x9FB21C651E98DF25) + mine[k : k + n])
        out.append(np.unique(total))
    return out


def wide_fingerprint(hashes: np.ndarray, form: Shape) -> list[int]:
    """Segments of the wide fingerprint of a set of shingle hashes."""
    total = form.segments * form.bits
    votes = np.zeros(total, np.int64)
    for at in range(0, len(hashes), 1 << 12):
        part = hashes[at : at + (1 << 12)]
        wide = np.stack([mix(part + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) for k in range(-(-total // 64))], axis=1)
        votes += np.unpackbits(np.ascontiguousarray(wide).view(np.uint8), axis=1, bitorder="little")[:, :total].sum(axis=0, dtype=np.int64)
    bits = (2 * votes > len(hashes)).reshape(form.segments, form.bits)
    return (bits @ (1 << np.arange(form.bits))).tolist()


def _identified(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(F.col("text").cast("string")).alias("node"), F.col("text").cast("string").alias("text"))


def _wide_prints(docs: DataFrame, form: Shape) -> DataFrame:
    """doc_id, node (digest of the text) and segments of every document with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch):
                sets = shingle_hashes(part.column("text"))
                kept = [i for i, s in enumerate(sets) if len(s)]
                taken = pa.array(kept, pa.int64())
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id").take(taken), "node": part.column("node").take(taken), "segments": pa.array([wide_fingerprint(sets[i], form) for i in kept], pa.list_(pa.int64()))})

    return _identified(docs).mapInArrow(run, "doc_id long, node string, segments array<long>")


def _shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, s): sets of shingle hashes of the ``wanted`` (id, doc_id, node)."""
    texts, wanted = _identified(docs), wanted.toDF("id", "at", "of")
    there = texts["doc_id"].eqNullSafe(wanted["at"]) & (texts["node"] == wanted["of"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch):
                sets = [s.view(np.int64) for s in shingle_hashes(part.column("text"))]
                yield pa.RecordBatch.from_pydict({"id": part.column("id"), "s": pa.array(sets, pa.list_(pa.int64()))})

    sets = texts.join(wanted.hint("shuffle_hash"), there).select("id", "text").mapInArrow(run, "id long, s array<long>")
    return sets.groupBy("id").agg(F.first("s").alias("s"))  # rows that repeat doc_id and text


def _apart(form: Shape, left: str, right: str) -> Column:
    """Bits in which two wide fingerprints differ."""
    return sum((F.bit_count(F.get(left, i).bitwiseXOR(F.get(right, i))) for i in range(form.segments)), F.lit(0))


def _near(pairs: DataFrame, nodes: DataFrame, form: Shape) -> DataFrame:
    """The pairs (a, b) of node ids within the distance."""
    segments = nodes.select("id", "segments")
    left, right = (segments.toDF(side, f"_{side}") for side in ("a", "b"))
    return pairs.join(left, "a").join(right, "b").where(_apart(form, "_a", "_b") <= form.distance).select("a", "b")


def _similar(near: DataFrame, nodes: DataFrame, docs: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of node ids whose shingles are similar."""
    near = materialize(near)
    ends = near.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = materialize(_shingle_sets(docs, nodes.join(ends, "id").select("id", "doc_id", "node")))
    left, right = (sets.toDF(side, f"_{side}") for side in ("a", "b"))
    common, sizes = F.size(F.array_intersect("_a", "_b")), F.size("_a") + F.size("_b")
    return materialize(near.join(left, "a").join(right, "b").where(common >= F.lit(least) * (sizes - common) - 1e-9).select("a", "b"))


def document_links(docs: DataFrame, prints: DataFrame, form: Shape, least: float = MIN_SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, doc_id, node, segments), one for each different text, and their links (a, b)."""
    firsts = prints.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("segments").alias("segments"))
    nodes = materialize(firsts.select(F.monotonically_increasing_id().alias("id"), "doc_id", "node", "segments"))
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.get("segments", i).bitwiseOR(F.lit(i << form.bits)) for i in range(form.segments)]
    balls = nodes.repartition(tasks, "id").select("id", F.explode(F.flatten(F.array(*[_ball(k, form.bits) for k in keys]))).alias("key"))
    # one shuffle serves both the entries and what is in them
    balls = balls.repartition(tasks, "key")
    entries = balls.groupBy("key").agg(F.min("id").alias("first"), F.count("id").alias("n")).where("n > 1")
    hits = materialize(balls.join(entries.hint("shuffle_hash"), "key").select("key", "id", "first", "n"))
    found = _similar(_near(hits.where("id <> first").select(F.col("id").alias("a"), F.col("first").alias("b")).distinct(), nodes, form), nodes, docs, least)
    # entries of several members: what is not one component yet is compared with the others as well
    linked = materialize(connected_components(found))
    others = hits.where("n > 2 and id <> first").select("key", "id")  # all have been compared with the first
    named = materialize(others.join(linked, F.col("id") == F.col("node"), "left").select("key", "id", F.coalesce("component", "id").alias("component")))
    mixed = materialize(named.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.ceil(F.count("*") / F.lit(256)).cast("int").alias("parts")).where("low <> high").select("key", "parts"))
    if mixed.isEmpty():
        return nodes, found
    seekers = materialize(named.join(mixed.hint("shuffle_hash"), "key").join(nodes.select("id", "segments"), "id"))
    members = seekers.select("key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("id").alias("other"), F.col("component").alias("theirs"), F.col("segments").alias("held"))
    seekers = seekers.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    pairs = seekers.join(members, ["key", "part"]).where("id > other and component <> theirs").where(_apart(form, "segments", "held") <= form.distance)
    return nodes, found.unionByName(_similar(pairs.select(F.col("id").alias("a"), F.col("other").alias("b")).distinct(), nodes, docs, least))


def drop_near_duplicates(docs: DataFrame, least: float = MIN_SIMILARITY) -> DataFrame:
    """The columns of ``docs``; of each component of similar documents the one with the least doc_id stays."""
    form = shape(docs.count(), least)
    prints = materialize(_wide_prints(docs, form))
    nodes, links = document_links(docs, prints, form, least)
    linked = materialize(connected_components(links)).withColumnRenamed("node", "member")
    roots = materialize(nodes.join(linked, nodes["id"] == linked["member"], "left").select(F.col("node").alias("of"), F.coalesce("component", "id").alias("root")))
    rows = prints.groupBy("doc_id", "node").agg(F.count("*").alias("n"))
    rows = materialize(rows.join(roots, rows["node"] == roots["of"]).select("doc_id", "node", "n", "root"))
    place = F.struct(F.isnull("doc_id").alias("last"), "doc_id", "node")
    kept = materialize(rows.groupBy("root").agg(F.min(place).alias("stays"), F.sum("n").alias("size")).where("size > 1").select("root", "stays"))
    judged = rows.join(kept.hint("shuffle_hash"), "root").select("doc_id", "node", "n", (place == F.col("stays")).alias("first"))
    doc, text, once = fresh(docs.columns, "doc", "node", "once")
    fate = materialize(judged.where("n > 1 or not first").select("doc_id", "node", "first")).toDF(doc, text, once)
    same = docs["doc_id"].cast("long").eqNullSafe(fate[doc]) & (F.md5(docs["text"].cast("string")) == fate[text])
    joined = docs.join(fate.hint("shuffle_hash"), same, "left")
    out = joined.where(F.col(once).isNull()).select(*docs.columns)
    if fate.where(once).isEmpty():
        return out
    # rows that repeat the doc_id and the text of one that stays: any one of them, the same in every run
    orderly = [f.name for f in docs.schema.fields if "map" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    one = joined.where(once).groupBy(doc, text).agg(F.min_by(F.struct(*[F.col(c) for c in docs.columns]), F.struct(*orderly)).alias("row"))
    return out.unionByName(one.select("row.*"))
