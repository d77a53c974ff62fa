"""Fuzzy line de-duplication by MinHash, in native expressions only.

Every line of enough characters becomes the set of its character shingles, of
one length and from every character. Its signature is that of longer grams, of
``GRAM_BYTES`` bytes: unrelated lines have far fewer of them in common than
shingles, so few lines share a band by chance. Each gram is hashed once, and of
a line's hashes those are sampled that end in as many zero bits as its size asks
for: they are chosen by what they hold, so similar lines choose alike. Lines
about as long as a bound between two samplings have both signatures. The size is
that of the different words, so a line that repeats itself is sampled less or
not at all. Cheap bijections of the hash give the permutations whose minima form
the signature, aggregated in generated code.
Signatures are cut into bands. The texts of the lines that share a band are read
once, and the lines compared with the band's leader, the line whose bands are the
most crowded. A sketch of each of these lines, a small bitmap of half of the
beginnings of its shingles, rules most chance meetings out: a bit that only one
of two sketches has is a shingle that only one of the lines has, and similar
lines differ in few, so this loses no link. The others are compared by the exact
Jaccard similarity of their whole shingle sets. Bands whose lines
are not one component after that are finished exactly: each line outside the
largest component of its band meets the lines of the other components there, by
sketches and then, where a sketch fits, by bitmaps of the whole sets, which rule
pairs out without a loss as well; the sets of the rest are compared. So no link
between lines of a band that joins components is lost, and sets and pairs are
made only where lines are nearly alike. Lines linked this way, and equal lines,
form components by distributed union-find, and of each component the first line
(least doc_id, then least line number) stays.

Defined results: null text stays null and has no lines. Blank lines and lines
of fewer than ``MIN_CHARS`` characters always stay. Lines are equal where two
hashes of 64 and 32 bits and the places they lead to agree. Very long lines and
texts are processed whole. Rows that repeat doc_id and text count as one
document. Null doc_ids come first. Extra columns, whatever their names, are
dropped by ``line_digests`` and kept by ``drop_lines``. An empty table gives an
empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ingestloom.llm.components import connected_components, join_components
from ingestloom.llm.names import fresh
from ingestloom.llm.scratch import made, materialize, release_unread

MIN_CHARS = 16
#: Characters of a shingle.
SHINGLE_CHARS = 5
#: Bytes of the grams of a signature, and grams of a line that are sampled for one at least, as far as there are.
GRAM_BYTES, SAMPLED = 8, 16
#: Bytes of the words by which the different grams of a line are estimated.
WORD_BYTES = 6
#: Lines that would have the next level's size, were they so many times as long, have the signature of that level as well.
OVERLAP = 1.25
BANDS, ROWS = 12, 3
#: Longs of a set's bitmap and of a sketch, and lines of a block of a large band.
WORDS, SKETCH, BLOCK = 43, 12, 4096
MIN_SIMILARITY = 0.8


def permutations(n: int = BANDS * ROWS) -> list[tuple[int, int]]:
    """A shift and a mask for each permutation: h -> h xor (h << shift) xor mask is a bijection."""
    mask, out = 0, []
    for i in range(n):
        mask = (mask + 0x9E3779B97F4A7C15) % (1 << 64)
        x = (mask ^ (mask >> 30)) * 0xBF58476D1CE4E5B9 % (1 << 64)
        out.append((5 + 3 * i % 53, (x ^ (x >> 27)) - (1 << 63)))
    return out


def _document_key(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_id", F.xxhash64("text"))


def line_table(docs: DataFrame) -> DataFrame:
    """doc_id, text_id, n, line and its hash of every line that takes part."""
    lines = _document_key(docs).select("doc_id", "text_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    return lines.where(F.length("line") >= MIN_CHARS).where(F.length(F.btrim("line")) > 0).withColumns({"id": F.xxhash64("line"), "check": F.hash("line")})


def _bit(h: str, words: int) -> tuple[Column, Column]:
    """The long of a bitmap and the bit in it that a hash sets, computed once for the aggregates of ``_bits``."""
    return F.pmod(h, F.lit(words)).cast("int").alias("word"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned({h}, 32) & 63 as int))").alias("bit")


def _bits(words: int) -> list[Column]:
    """Aggregates: the longs w0, w1, ... of a bitmap. Of a value that can be null the generated code makes tests at every row."""
    return [F.bit_or(F.when(F.col("word") == k, F.col("bit")).otherwise(F.lit(0))).alias(f"w{k}") for k in range(words)]


def _grams(lines: DataFrame, size: int, *columns: Column) -> DataFrame:
    """``columns``, the bytes of a line, and a row with the place i of every ``size`` bytes of it; no line is shorter."""
    flat = lines.select(*columns, F.col("line").cast("binary").alias("bytes"))
    return flat.withColumn("i", F.explode(F.sequence(F.lit(1), F.octet_length("bytes") - size + 1)))


def minima(lines: DataFrame) -> DataFrame:
    """id, level and the keys of the bands of every different line's signatures."""
    # a line has hardly fewer grams than different words; one that repeats itself is not sampled as its length would have it
    words = F.size(F.array_distinct(F.split("line", " ")))
    sized = lines.select("id", "line", F.least(F.octet_length("line"), WORD_BYTES * words).alias("size"))
    level = F.greatest(F.lit(0), F.floor(F.log2(F.col("size") / SAMPLED))).cast("int")
    leveled = sized.withColumn("level", level)
    next_too = F.col("size") * F.lit(OVERLAP) >= 2 * SAMPLED * F.expr("shiftleft(1L, level)")
    # the masks tell which hashes a level samples; those of the next one are among those of a line's own
    levels = leveled.withColumn("above", F.when(next_too, F.col("level") + 1).otherwise(F.lit(-1)))
    of = [F.col("id"), F.col("level"), F.col("above"), F.expr("shiftleft(1L, level) - 1").alias("own"), F.expr("shiftleft(2L, level) - 1").alias("next")]
    hashed = _grams(levels, GRAM_BYTES, *of).select("id", "level", "above", "own", "next", F.xxhash64(F.substring("bytes", F.col("i"), F.lit(GRAM_BYTES))).alias("h"))
    sampled = hashed.where(F.col("h").bitwiseAND(F.col("own")) == 0)
    both = (F.col("above") >= 0) & (F.col("h").bitwiseAND(F.col("next")) == 0)
    kept = sampled.select("id", "h", F.explode(F.when(both, F.array("level", "above")).otherwise(F.array("level"))).alias("level"))
    least = [F.min(F.col("h").bitwiseXOR(F.shiftleft("h", shift)).bitwiseXOR(F.lit(mask))).alias(f"m{k}") for k, (shift, mask) in enumerate(permutations())]
    signed = kept.groupBy("id", "level").agg(*least)
    keys = [F.xxhash64(F.lit(b), *[F.col(f"m{b * ROWS + r}") for r in range(ROWS)]) for b in range(BANDS)]
    return signed.select("id", "level", F.array(*keys).alias("keys"))


def sketches(lines: DataFrame) -> DataFrame:
    """id, n and a bitmap (w0, w1, ...) of half of the first bytes of each line's shingles.

    Bytes that only one line has begin a shingle that only that line has. Up to
    three more grams of ``SHINGLE_CHARS`` bytes begin in the last characters of a
    line beyond ASCII, too late for a shingle. ``n`` makes up for them: besides
    that it is not below the size of the set.
    """
    wide = F.octet_length("line") != F.length("line")
    n = F.length("line") - SHINGLE_CHARS + 1 + F.when(wide, round(3 * (1 + MIN_SIMILARITY) / (1 - MIN_SIMILARITY))).otherwise(0)
    flat = _grams(lines, SHINGLE_CHARS, F.col("id"), n.alias("n"), wide.alias("wide"))
    first = F.substring("bytes", F.col("i"), F.lit(1))
    flat = flat.where(~F.col("wide") | (first < F.lit(b"\x80")) | (first >= F.lit(b"\xc0")))
    hashed = flat.select("id", "n", F.xxhash64(F.substring("bytes", F.col("i"), F.lit(SHINGLE_CHARS))).alias("h")).where(F.col("h") > 0)
    return hashed.select("id", "n", *_bit("h", SKETCH)).groupBy("id").agg(F.max("n").alias("n"), *_bits(SKETCH))


def signatures(lines: DataFrame) -> DataFrame:
    """Rows of ``minima``, and of ``sketches``, where ``sketched``."""
    keys, drawn = minima(lines).select("id", "keys", F.lit(False).alias("sketched")), sketches(lines).withColumn("sketched", F.lit(True))
    return keys.unionByName(drawn, allowMissingColumns=True)


def bands(signed: DataFrame) -> DataFrame:
    """id and key of each band of a signature."""
    return signed.select("id", F.explode("keys").alias("key"))


def _set(line: Column) -> Column:
    """The set of a line's shingles, as hashes.

    UTF-32 has four bytes a character, so a shingle is a range of bytes, where a
    regular expression takes three times as long. A variable holds the bytes: a
    column of the row would be copied for every shingle.
    """
    width = 4 * SHINGLE_CHARS
    held = F.array(F.encode(line, "UTF-32"))
    hashes = F.transform(held, lambda b: F.transform(F.sequence(F.lit(1), F.octet_length(b) - width + 1, F.lit(4)), lambda i: F.xxhash64(F.substring(b, i, F.lit(width)))))
    return F.array_distinct(F.get(hashes, F.lit(0)))


def shingle_sets(lines: DataFrame) -> DataFrame:
    """id and the set of shingle hashes."""
    return lines.select("id", _set(F.col("line")).alias("s"))


def similar(a: Column, b: Column, least: float = MIN_SIMILARITY) -> Column:
    """Whether two sets have Jaccard similarity ``least`` or more; sizes that rule it out are not intersected."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    shared = F.size(F.array_intersect(a, b)) * F.lit(1 + least) >= F.lit(least) * (F.size(a) + F.size(b)) - 1e-9
    return F.when(small < F.lit(least) * large - 1e-9, False).otherwise(shared)


def links(lines: DataFrame, first: DataFrame) -> DataFrame:
    """(a, b): verified links between different lines. ``first`` has one place (doc_id, text_id, n) of each id."""
    return linked_lines(lines, first)[0]


def linked_lines(lines: DataFrame, first: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The links between different lines, and (node, component) of the lines that they put below another."""
    before = made()
    signed = materialize(minima(lines).select("id", "keys"))
    keyed = bands(signed)
    # both signatures of a line can have a key
    shared = materialize(keyed.groupBy("key").agg(F.count("*").alias("size"), F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("key", "size"))
    # in these joins one side is large and the other small or unique: hashing the latter spares sorting the former
    members = materialize(keyed.join(shared.hint("shuffle_hash"), "key").select("key", "id", "size"))
    # how crowded a line's bands are: the common form of a group of variants is in more crowded ones than its variants
    crowd = materialize(members.groupBy("id").agg(F.sum("size").alias("crowd")))
    release_unread(members, before, crowd)
    table = materialize(members.join(crowd.hint("shuffle_hash"), "id").select("key", "id", "crowd"))
    leaders = materialize(table.groupBy("key").agg(F.max(F.struct("crowd", "id")).alias("x")).select("key", F.col("x.id").alias("leader")))
    # a leader meets every line of its key, so its row goes
    met = materialize(table.join(leaders.hint("shuffle_hash"), "key").where("id <> leader").select("key", "id", "leader").distinct())
    texts = _texts(crowd.select("id"), lines, first)
    drawn = materialize(sketches(texts))
    release_unread(texts, before, met, drawn)
    near = materialize(_near(met.select(F.greatest("id", "leader").alias("a"), F.least("id", "leader").alias("b")).distinct(), drawn))
    found = _judged(near, texts)
    release_unread(texts, before, met, drawn, found)
    # what the leaders leave: lines of one band that are not in one component yet, and of these the ones whose sketches fit
    linked = connected_components(found)
    rest = materialize(_unsettled(met.select("key", "id"), linked))
    release_unread(rest, before, texts, drawn, found, linked)
    fitting = materialize(_fitting(rest, drawn))
    release_unread(rest, before, texts, found, linked, fitting)
    if fitting.isEmpty():
        return found, linked
    texts = materialize(texts.join(fitting.hint("shuffle_hash"), "id", "left_semi"))
    release_unread(rest, before, texts, found, linked, fitting)
    pairs = materialize(_pairs(rest.join(fitting, "id", "left_semi"), texts))
    # the most promising pair of each line first: most pairs are in one component after that
    best = pairs.groupBy("a").agg(F.min(F.struct("apart", "b")).alias("x")).select("a", F.col("x.b").alias("b"))
    likely = _judged(best, texts)
    component = materialize(join_components(linked, likely))
    for side in ("a", "b"):
        pairs = pairs.join(component.select(F.col("node").alias(side), F.col("component").alias(f"_{side}")), side, "left")
    apart = pairs.where(F.coalesce("_a", "a") != F.coalesce("_b", "b")).select("a", "b")
    last = _judged(apart, texts)
    found = found.unionByName(likely).unionByName(last).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    return found, materialize(join_components(component, last))


def _texts(ids: DataFrame, lines: DataFrame, first: DataFrame) -> DataFrame:
    """id and line of some ids, read from the first place of each."""
    places = first.join(ids.distinct(), "id", "left_semi").select(F.col("at.doc_id").alias("_doc_id"), F.col("at.text_id").alias("_text_id"), F.col("at.n").alias("_n"))
    return materialize(lines.join(materialize(places).hint("shuffle_hash"), _same_place(lines), "left_semi").select("id", "line"))


def _alike() -> Column:
    """Whether two sketches (one's columns begin with _) allow similarity: each bit that one of them lacks is a shingle that one of the sets lacks."""
    differ = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"w{k}").bitwiseXOR(F.col(f"_w{k}"))) for k in range(SKETCH)])
    return differ * F.lit(1 + MIN_SIMILARITY) <= F.lit(1 - MIN_SIMILARITY) * (F.col("n") + F.col("_n")) + 1e-6


def _near(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sketches allow similarity."""
    left = sketches.withColumnRenamed("id", "a")
    right = sketches.toDF(*[f"_{c}" for c in sketches.columns]).withColumnRenamed("_id", "b")
    return pairs.join(left.hint("shuffle_hash"), "a").join(right.hint("shuffle_hash"), "b").where(_alike()).select("a", "b")


def _spread(rows: DataFrame, *by: str) -> DataFrame:
    """Rows dealt over all cores, where they are small and what is made of them takes long."""
    spark = rows.sparkSession
    return rows.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *by)


def _judged(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) that are similar."""
    left, right = (_spread(texts.select(F.col("id").alias(side), F.col("line").alias(f"_{side}")), side) for side in ("a", "b"))
    both = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b")
    # the variable of the transform holds both sets, so that each is made once and not wherever it is mentioned
    sets = F.array(F.struct(*[_set(F.col(c)).alias(c) for c in ("_a", "_b")]))
    same = F.get(F.transform(sets, lambda x: similar(x["_a"], x["_b"])), F.lit(0))
    return materialize(both.where(same).select("a", "b"))


def _unsettled(table: DataFrame, linked: DataFrame) -> DataFrame:
    """The rows of keys whose lines are in several components of the links found, with the component."""
    named = materialize(table.join(linked, table["id"] == linked["node"], "left").select(*table.columns, F.coalesce("component", "id").alias("component")))
    several = materialize(named.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key"))
    return named.join(several, "key", "left_semi")


def _bitmaps(sets: DataFrame) -> DataFrame:
    """id, size n of the set, words w0, w1, ... of a bitmap in which every shingle sets one bit, and its number of bits."""
    # of an outer explode no filter is inferred, which would make the array a second time
    flat = sets.select("id", F.size("s").alias("n"), F.explode_outer("s").alias("h")).select("id", "n", *_bit("h", WORDS))
    names = [f"w{k}" for k in range(WORDS)]
    return flat.groupBy("id", "n").agg(*_bits(WORDS)).withColumn("bits", reduce(lambda x, y: x + y, [F.bit_count(name) for name in names]))


def _dealt(table: DataFrame, maps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """By key and block, ``maps`` of every line, and (columns begin with _) of the lines outside the largest component of the key."""
    main = table.groupBy("key", "component").agg(F.count("*").alias("times")).groupBy("key").agg(F.max(F.struct("times", "component")).alias("x"), F.ceil(F.sum("times") / BLOCK).cast("int").alias("blocks"))
    main = materialize(main.select("key", F.col("x.component").alias("main"), "blocks"))
    dealt = materialize(table.join(main.hint("shuffle_hash"), "key").join(maps.hint("shuffle_hash"), "id").withColumn("outside", F.col("component") != F.col("main")).drop("main"))
    # without nulls the condition is short enough to be compiled
    values = [c for c in dealt.columns if c not in ("key", "blocks", "outside")]
    dealt = dealt.select("key", "blocks", F.coalesce("outside", F.lit(False)).alias("outside"), *[F.col(c) if c == "keys" else F.coalesce(c, F.lit(0)).alias(c) for c in values])
    every = dealt.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).drop("blocks")
    outside = dealt.where("outside").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("key", "block", *[F.col(c).alias(f"_{c}") for c in values])
    return _spread(every, "key", "block"), _spread(outside, "key", "block")


def _fitting(table: DataFrame, sketches: DataFrame) -> DataFrame:
    """The ids of ``table`` that share a key and no component with one whose sketch allows similarity."""
    every, outside = _dealt(table, sketches)
    fits = (every["key"] == outside["key"]) & (every["block"] == outside["block"]) & (F.col("component") != F.col("_component")) & _alike()
    # semi joins make a row a line, not a row a pair
    ids = [x.join(y.hint("merge"), fits, "left_semi").select(F.col(c).alias("id")) for x, y, c in ((every, outside, "id"), (outside, every, "_id"))]
    return ids[0].unionByName(ids[1]).distinct()


def _pairs(table: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b): lines that share a key and no component, as far as their bitmaps allow similarity, and how far apart these are.

    One line of such a pair, a, is outside the largest component of the key. A bit
    of one set's bitmap that the other's lacks stands for at least one shingle that
    the other lacks, and similar sets lack few of each other's. Lines that share
    several keys meet in the least of them only: they are in different components,
    so one of them is outside the largest in every key that they share.
    """
    keys = table.groupBy("id").agg(F.collect_set("key").alias("keys"))  # BANDS keys a signature at most
    maps = materialize(_bitmaps(materialize(shingle_sets(texts))).join(keys.hint("shuffle_hash"), "id"))
    common = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"w{k}").bitwiseAND(F.col(f"_w{k}"))) for k in range(WORDS)])
    least = F.lit(MIN_SIMILARITY / (1 + MIN_SIMILARITY)) * (F.col("n") + F.col("_n")) - 1e-9
    fits = (F.col("component") != F.col("_component")) & (~F.col("outside") | (F.col("_id") < F.col("id")))
    fits = fits & (F.least("n", "_n") >= F.lit(MIN_SIMILARITY) * F.greatest("n", "_n") - 1e-9)
    fits = fits & (common >= F.greatest(F.col("bits") - F.col("n"), F.col("_bits") - F.col("_n")) + least)
    every, outside = _dealt(table, maps)
    met = every.join(outside.hint("merge"), ["key", "block"]).where(fits).where(F.array_min(F.array_intersect("keys", "_keys")) == F.col("key"))
    return met.select(F.col("_id").alias("a"), F.col("id").alias("b"), (-common / (F.col("bits") + F.col("_bits"))).alias("apart"))


def _same_place(lines: DataFrame) -> Column:
    return lines["doc_id"].eqNullSafe(F.col("_doc_id")) & lines["text_id"].eqNullSafe(F.col("_text_id")) & (lines["n"] == F.col("_n"))


def removed_lines(docs: DataFrame) -> DataFrame:
    """doc_id, text_id and the numbers of the lines to remove, for documents that have any."""
    lines = line_table(docs)
    spots = lines.select("doc_id", "text_id", "n", "id", "check")  # read from the texts each time; hashing a line costs less than keeping it
    first = materialize(spots.groupBy("id").agg(F.min(F.struct("doc_id", "text_id", "n", "check")).alias("at"), F.count("*").alias("times")))
    linked = linked_lines(lines, first)[1]
    named = first.join(linked, first["id"] == linked["node"], "left").select("id", "at", "times", F.coalesce("component", "id").alias("group"))
    kept = materialize(named.groupBy("group").agg(F.min("at").alias("stays"), F.sum("times").alias("size")).where("size > 1").select("group", "stays"))
    where = materialize(named.join(kept, "group").select("id", F.col("at.check").alias("same"), F.struct("stays.doc_id", "stays.text_id", "stays.n").alias("stays")))
    gone = spots.join(where.hint("shuffle_hash"), "id").where(F.col("check") == F.col("same")).where(~F.struct("doc_id", "text_id", "n").eqNullSafe(F.col("stays")))
    return gone.groupBy("doc_id", "text_id").agg(F.collect_set("n").alias("gone"))


def _joined(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a further column of line numbers to remove (null for none), and that column's name."""
    doc, text, name = fresh(docs.columns, "in_doc", "in_text", "gone")
    gone = materialize(removed_lines(docs)).toDF(doc, text, name)
    same = docs["doc_id"].cast("long").eqNullSafe(gone[doc]) & (F.xxhash64(docs["text"].cast("string")) == gone[text])
    return docs.join(gone.hint("shuffle_hash"), same, "left").drop(doc, text), name


def _kept_text(text: Column, gone: Column) -> Column:
    lines = F.split(text, "\n")
    numbers = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    # a variable of the outer transform holds the lines, so that the text is split once and not for every line
    both = F.array(F.struct(lines.alias("lines"), numbers.alias("numbers")))
    joined = F.transform(both, lambda b: F.array_join(F.transform(b["numbers"], lambda i: F.get(b["lines"], i)), "\n"))
    return F.when(gone.isNull(), text).otherwise(F.get(joined, F.lit(0)))


def drop_lines(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` with later near-copies of lines cut from ``text``."""
    joined, name = _joined(docs)
    text = _kept_text(F.col("text"), F.col(name))
    return joined.select(*[text.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns])


def line_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed and the digest of the text that stays."""
    joined, name = _joined(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    text = F.coalesce(_kept_text(F.col("text"), F.col(name)), F.lit(""))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)
    return joined.select("doc_id", n_lines.cast("long").alias("n_lines"), F.coalesce(F.size(F.col(name)), F.lit(0)).cast("long").alias("n_removed"), F.sha2(text, 256).alias("kept_sha256"))
