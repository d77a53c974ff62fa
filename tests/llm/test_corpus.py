"""Operators over many documents, against brute force."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ingestloom.llm import components, covertree, fuzzy_lines, mixing, simhash, substrings

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, rep string, gone int"


def table(spark, texts, ids=None, sources=None):
    ids = range(len(texts)) if ids is None else ids
    sources = [None] * len(texts) if sources is None else sources
    return spark.createDataFrame([(i, t, None, s, None, "x", None, 1) for i, t, s in zip(ids, texts, sources, strict=True)], SCHEMA)


def groups(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, k) for k in range(2, 60)] + [(rng.randint(200, 300), rng.randint(200, 300)) for _ in range(60)] + [(7, 7), (400, 399)]
    frame = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in components.connected_components(frame).collect()}
    want = groups({n for e in edges for n in e}, edges)
    assert got == {n: c for n, c in want.items() if n != c}
    assert components.connected_components(frame.where("false")).count() == 0


def test_components_take_no_step_where_edges_are_stars(spark, monkeypatch):
    steps, star = [], components._star
    monkeypatch.setattr(components, "_star", lambda edges, large: steps.append(large) or star(edges, large))
    edges = [(k, 1) for k in range(2, 40)] + [(50, k) for k in (60, 61)] + [(70, 70)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 1 for k in range(2, 40)} | {60: 50, 61: 50} and not steps
    path = spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")
    assert {r.node: r.component for r in components.connected_components(path).collect()} == {2: 1, 3: 1} and steps == [True, False]


def test_components_joined_by_further_edges(spark):
    rng = random.Random(5)
    old, new = ([(rng.randint(1, 120), rng.randint(1, 120)) for _ in range(n)] for n in (50, 30))
    linked = components.connected_components(spark.createDataFrame(old, "a long, b long"))
    got = components.join_components(linked, spark.createDataFrame([*new, (7, 7), (None, 3)], "a long, b long")).collect()
    want = groups({n for e in old + new for n in e}, old + new)
    assert sorted((r.node, r.component) for r in got) == sorted((n, c) for n, c in want.items() if n != c)
    assert sorted(components.join_components(linked, spark.createDataFrame([], "a long, b long")).collect()) == sorted(linked.collect())


# --- near-duplicates -------------------------------------------------------------


def plain_fingerprint(text):
    from xxhash import xxh64_intdigest

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(spark):
    texts = ["", "One", "One TWO", "one two three four Five", "É é\x1cx  y\n z " * 9, "a " * 2000]
    for text in texts:
        assert simhash.fingerprint(text) == plain_fingerprint(text)
    frame = spark.createDataFrame([(t,) for t in texts[1:3]], "text string")
    native = [r.h % (1 << 64) for r in frame.select(F.xxhash64(F.lower("text")).alias("h")).collect()]
    assert native == [simhash.fingerprint(t) for t in texts[1:3]]


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(4)
    base = [" ".join(rng.choices("abcdefghij", k=120)) for _ in range(25)]
    texts = [None, "", " \n"] + base + [b.replace("a", "zz", 1) for b in base] + [b.upper() for b in base[:5]] + ["short", "short text", "x " * 30000]
    texts += [" ".join(w if i != k else "q" for i, w in enumerate(base[0].split())) for k in range(0, 120, 4)]
    ids = [3 * i + 1 for i in range(len(texts))]
    ids[10], ids[11] = None, ids[12]  # a null id, and one that two rows share
    prints = [plain_fingerprint(t) for t in texts]
    edges = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if (prints[a] ^ prints[b]).bit_count() <= 2]
    members = defaultdict(list)
    for at, root in groups(range(len(texts)), edges).items():
        members[root].append(at)
    want = Counter()
    for group in members.values():
        known = [ids[i] for i in group if ids[i] is not None]
        want.update((ids[i], f"{prints[i]:016x}", min(known) if known else None) for i in group)
    got = Counter(map(tuple, simhash.near_duplicates(table(spark, texts, ids)).collect()))
    # rows that share a doc_id tie their groups only by their texts
    assert got == want
    assert simhash.near_duplicates(table(spark, texts).where("false")).count() == 0


@pytest.mark.parametrize("bucket", [simhash.BUCKET, 1])
def test_fingerprint_links_are_exact(spark, bucket):
    rng = random.Random(9)
    seeds = [rng.getrandbits(64) for _ in range(20)]
    prints = list({s ^ (1 << a) ^ (1 << b) ^ (1 << c) for s in seeds for a, b, c in [[rng.randrange(64) for _ in range(3)] for _ in range(25)]} | set(seeds))
    frame = spark.createDataFrame([(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(prints)], "doc_id long, fp long")
    edges = [(a, b) for a, b in itertools.combinations(range(len(prints)), 2) if (prints[a] ^ prints[b]).bit_count() <= 2]
    want = groups(range(len(prints)), edges)
    got = {r.fp % (1 << 64): r.component_id for r in simhash.fingerprint_components(frame, bucket).collect()}
    assert got == {p: want[i] for i, p in enumerate(prints)}


def test_one_document_of_a_group_stays(spark):
    docs = table(spark, ["a b c d e", "a b c d e", "other words go here", None, "A B C D E"], [5, 2, 7, 9, 2])
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(docs).collect()) == [2, 7, 9]
    assert simhash.drop_near_duplicates(docs).columns == docs.columns


def test_similar_documents_against_all_pairs(spark):
    rng = random.Random(12)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8))) for _ in range(500)]
    base = [rng.choices(vocabulary, k=rng.randint(60, 300)) for _ in range(30)]
    texts = [None, "", "one", "one two", "ONE two", " ".join(vocabulary * 20)]
    for words in base:
        texts.append(" ".join(words))
        for edits in (1, 1, 2, 30):
            copy = list(words)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = "changed"
            texts.append("\n".join(copy))
    ids = [None if i % 17 == 3 else 1000 - i for i in range(len(texts))]
    sets = [{" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in ((t or "").lower().split() for t in texts)]
    edges = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    members = defaultdict(list)
    for at, root in groups(range(len(texts)), edges).items():
        members[root].append(at)
    want = {min((ids[i] is None, ids[i] or 0, hashlib.md5((texts[i] or "").encode()).hexdigest()) for i in group) for group in members.values()}
    got = [(r.doc_id is None, r.doc_id or 0, hashlib.md5((r.text or "").encode()).hexdigest()) for r in simhash.drop_near_duplicates(table(spark, texts, ids)).collect()]
    assert len(got) == len(set(got)) and want <= set(got) and len(got) - len(want) <= 0.05 * (len(texts) - len(want))
    again = table(spark, ["same text"] * 5 + [None, None, ""], [4, 4, 2, 2, None, 6, 6, 7])
    assert sorted((r.doc_id, r.text) for r in simhash.drop_near_duplicates(again).collect() if r.text is not None) == [(2, "same text"), (7, "")]
    assert simhash.drop_near_duplicates(again).count() == 4 and simhash.drop_near_duplicates(again.where("false")).count() == 0


def made_pairs(rng, n, least, most):
    """Pairs of texts of their own words whose five-word shingles have a similarity in [least, most)."""
    made = []
    for at in range(n):
        total = rng.randint(60, 250)
        words = [f"w{at}x{k}" for k in range(total + 4)]
        choices = [k for k in range(total) if least <= (total - k) / (total + k) < most]
        k = rng.choice(choices)
        made.append((" ".join(words), " ".join([*words[: len(words) - k], *(f"v{at}x{j}" for j in range(k))])))
    return made


def test_recall_of_similar_documents_by_band_of_similarity(spark):
    rng = random.Random(8)
    for least, most, recall in ((0.8, 0.85, 0.9), (0.85, 0.9, 0.95), (0.9, 0.95, 0.99), (0.7, 0.78, 0.0)):
        pairs = made_pairs(rng, 400, least, most)
        docs = table(spark, [t for p in pairs for t in p])
        gone = docs.count() - simhash.drop_near_duplicates(docs).count()
        assert gone >= recall * len(pairs), (least, gone)
        if most < 0.8:
            assert gone == 0  # similarity is exact


def test_chance_meetings_grow_as_texts_do():
    """Pairs that meet by chance, by reckoning, at sizes between the smallest shape and the largest."""
    for texts in (10**3, 39_000, 192_732, 10**6, 15 * 10**6, 10**8):
        form = simhash.shape(texts)
        pairs = form.segments * (1 + form.bits + math.comb(form.bits, 2)) * texts * texts / (2 << form.bits)
        assert pairs <= simhash.BY_CHANCE * texts


def test_shapes_of_wide_fingerprints():
    assert simhash.shape(0, 1.0) == simhash.Shape(1, 24, 0)
    flip = math.acos(1.6 / 1.8) / math.pi
    for texts in (0, 10**5, 10**7, 10**9):
        form = simhash.shape(texts)
        met = sum(math.comb(form.bits, k) * flip**k * (1 - flip) ** (form.bits - k) for k in range(3))
        assert 1 - (1 - met) ** form.segments >= simhash.LEAST_MET
        # a text meets few others by chance, and random fingerprints are beyond the distance
        assert texts * form.segments * (1 + form.bits + math.comb(form.bits, 2)) / 2**form.bits < 600
        total = form.segments * form.bits
        assert form.distance < total / 2 - 4 * math.sqrt(total) / 2


def test_an_entry_of_many_components_is_compared_whole(spark):
    """Texts of one wide fingerprint stand in the same entries; only those that are similar are linked."""
    docs = table(spark, [f"{k // 2} b c d e {k // 2}" if k % 2 else f"{k // 2} b c d e {k // 2} f" for k in range(12)])
    form = simhash.Shape(2, 24, 48)
    prints = simhash._wide_prints(docs, form).withColumn("segments", F.array(F.lit(3), F.lit(5)).cast("array<long>"))
    _, links = simhash.document_links(docs, prints, form, 0.6)
    assert links.count() == 6 and links.where("a <= b").count() == 0


# --- exact search -----------------------------------------------------------------


def test_search_against_brute_force(spark):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(6, 8))
    vectors = (centers[rng.integers(0, 6, 900)] + 0.2 * rng.normal(size=(900, 8))).astype(np.float32)
    vectors[500:520] = vectors[499]  # ties
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    rows += [(1000, None), (1100, []), (1200, [1.0, None]), (1300, [float("nan")] * 8), (1400, [float("inf")] * 8), (None, [1.0] * 8), (200, rows[200][1]), (1500, [1e30] * 8)]
    got = defaultdict(list)
    for r in covertree.top_inner_products(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    usable = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    limit = (1 << 63) - 1
    for at, (i, v) in enumerate(usable):
        if i % 100 == 0 and i not in (200, 1500):
            scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for k, (j, w) in enumerate(usable) if k != at)[:10]
            assert got[i] == [(n + 1, j, max(-limit - 1, min(limit, -s))) for n, (s, j) in enumerate(scores)]
    assert len(got[200]) == 20  # each of the two rows is a query


def test_search_with_few_rows(spark):
    frame = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (100, [-1.0, 3.0])], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, covertree.top_inner_products(frame).collect())) == [(0, 1, 1, 2 * 1024**2), (0, 2, 100, -(1024**2)), (100, 1, 0, -(1024**2)), (100, 2, 1, -2 * 1024**2)]
    assert covertree.top_inner_products(frame.where("false")).count() == 0


# --- mixing ---------------------------------------------------------------------


def plain_targets(sizes, share=1.5, cap=2.0):
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, fixed = share * sum(sizes.values()), {}
    while True:
        open_ = [s for s in order if s not in fixed]
        rest = total - sum(fixed.values())
        level = rest / sum(weight[s] for s in open_) if open_ else 0
        over = [s for s in open_ if weight[s] * level >= cap * sizes[s]]
        if not over:
            return {s: fixed.get(s, weight[s] * level) for s in order}
        fixed |= {s: cap * sizes[s] for s in over}


def test_mix(spark):
    rng = random.Random(6)
    sources = ["b", "a", None, "ä", "z", "empty", "hot"]
    docs = [(i, "w " * rng.choice([0, 1, 5, 30, 200]), s) for i, s in enumerate(rng.choices(sources[:5], k=400) + ["hot"] * 900)] + [(5000, None, "empty")]
    docs += [(7, "w w", "a")] * 3
    frame = table(spark, [d[1] for d in docs], [d[0] for d in docs], [d[2] for d in docs])
    got = mixing.mix_documents(frame).collect()
    size = Counter()
    for _, text, source in docs:
        size[source] += len((text or "").split())
    targets, taken = plain_targets(size), Counter()
    by_target = {round(t, 6): s for s, t in targets.items()}
    for r in got:
        source = by_target[round(r.target, 6)]
        taken[source] += r.taken
        assert r.source_size == size[source] and (r.taken == 0 if r.size == 0 else r.taken % r.size == 0) and r.taken <= 2 * r.size
    assert len(got) == len(docs) and all(abs(taken[s] - t) <= 200 for s, t in targets.items())
    again = mixing.mix_documents(frame.repartition(7)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    small = mixing.mix_copies(mixing.document_sizes(frame), block_docs=64).groupBy("target").agg(F.sum("taken").alias("t"), F.sum("copies").alias("n")).collect()
    assert all(abs(r.t - r.target) <= 400 for r in small)
    mix = mixing.apply_mix(frame)
    assert mix.columns == frame.columns and mix.agg(F.sum(F.size(F.split(F.trim("text"), " ")))).first()[0] == sum(taken.values())
    assert mixing.mix_documents(frame.where("false")).count() == 0


def test_flight_keeps_its_sums():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 10, 500):
        sizes = rng.integers(1, 1000, n)
        p = rng.random(n)
        flown = mixing.fly(p, sizes, rng)
        assert np.isclose(flown.sum(), p.sum()) and np.isclose(flown @ sizes, p @ sizes) and ((flown > 0) & (flown < 1)).sum() <= 2
        assert set(mixing.land(flown, sizes.astype(float))) <= {0.0, 1.0}
    flights = np.mean([mixing.fly(np.full(6, 0.3), np.arange(1, 7), np.random.default_rng(k)) for k in range(4000)], axis=0)
    assert np.allclose(flights, 0.3, atol=0.03)  # every document keeps its probability


# --- repeated passages ------------------------------------------------------------


def plain_removed(texts, window):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + window] for b in raw for i in range(len(b) - window + 1))
    out = []
    for b in raw:
        covered = np.zeros(len(b), bool)
        for i in range(len(b) - window + 1):
            if seen[b[i : i + window]] > 1:
                covered[i : i + window] = True
        spans = int((np.diff(np.concatenate([[0], covered.astype(int)])) == 1).sum())
        out.append((len(b), int(covered.sum()), spans, hashlib.sha256(bytes(x for x, c in zip(b, covered, strict=True) if not c)).hexdigest()))
    return out


@pytest.mark.parametrize("many, segment", [(substrings.MANY, substrings.SEGMENT), (2, 500)])
def test_repeats_against_brute_force(spark, monkeypatch, many, segment):
    rng = random.Random(8)
    word = lambda n: " ".join("".join(rng.choices("abcdeé", k=rng.randint(1, 7))) for _ in range(n))
    passages = [word(150) for _ in range(4)]
    texts = [None, "", "short", "a" * 399, "b" * 400, "c" * 401, "ab" * 700]
    for _ in range(40):
        body = [word(rng.randint(5, 120)) for _ in range(3)]
        p = rng.choice(passages)
        cut = rng.randint(0, len(p) // 2)
        texts.append(body[0] + p[cut : cut + rng.randint(300, 700)] + body[1] + (passages[0] if rng.random() < 0.5 else "") + body[2])
    texts += [texts[10], texts[11][:500], word(400), word(400)]
    ids = [None, *range(1, len(texts))]
    docs = table(spark, texts, ids)
    ranges = substrings.repeat_ranges
    monkeypatch.setattr(substrings, "repeat_ranges", lambda d, w: ranges(d, w, many, segment))
    got = Counter(map(tuple, substrings.remove_repeats(docs).collect()))
    assert got == Counter((i, *rest) for i, rest in zip(ids, plain_removed(texts, 400), strict=True))


def test_repeats_of_no_rows_and_cut_texts(spark):
    docs = table(spark, ["x" + "héllo wörld " * 60, None, "plain"])
    assert substrings.remove_repeats(docs.where("false")).count() == 0
    cut = substrings.drop_repeats(docs)
    assert cut.columns == docs.columns and {r.doc_id: r.text for r in cut.collect()} == {0: "x", 1: None, 2: "plain"}
    twice = table(spark, ["same " * 90 + "tail one", "same " * 90 + "tail one"], [1, 1])
    assert [r.n_removed for r in substrings.remove_repeats(twice).collect()] == [458, 458]


def test_factors_against_brute_force():
    rng = random.Random(3)
    for n in (1, 2, 7, 40, 120):
        text = bytes(rng.choices(b"ab", k=n))
        data = np.frombuffer(text, np.uint8)
        order, _ = substrings.suffix_order(data)
        assert order.tolist() == sorted(range(n), key=lambda i: text[i:])

        def common(i, j, text=text):
            k = 0
            while max(i, j) + k < len(text) and text[i + k] == text[j + k]:
                k += 1
            return k

        lcp = np.array([0, *map(common, order[:-1].tolist(), order[1:].tolist())])
        previous, following = substrings.factor_lengths(order, lcp)
        assert previous.tolist() == [max((common(i, j) for j in range(i)), default=0) for i in range(n)]
        assert following.tolist() == [max((common(i, j) for j in range(i + 1, n)), default=0) for i in range(n)]
        for window in (1, 3, 8):
            starts = np.arange(max(0, n - window + 1))
            if len(starts):
                assert substrings.repeated_starts(data, np.full(n, n), starts, window, True).tolist() == (previous[starts] >= window).tolist()
                assert substrings.repeated_starts(data, np.full(n, n), starts, window).tolist() == (np.maximum(previous, following)[starts] >= window).tolist()


# --- fuzzy lines ------------------------------------------------------------------


def shingles(line):
    return {line[i : i + 5] for i in range(len(line) - 4)}


def plain_lines(texts):
    spots = defaultdict(list)
    for i, text in enumerate(texts):
        for n, line in enumerate((text or "").split("\n") if text is not None else []):
            if len(line) >= fuzzy_lines.MIN_CHARS and line.strip(" "):
                spots[line].append((i, n))
    lines = list(spots)
    sets = [shingles(x) for x in lines]
    edges = [(a, b) for a, b in itertools.combinations(range(len(lines)), 2) if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    places = defaultdict(list)
    for at, root in groups(range(len(lines)), edges).items():
        places[root] += spots[lines[at]]
    gone = {p for all_ in places.values() for p in sorted(all_)[1:]}
    return [None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone) for i, t in enumerate(texts)]


def test_lines_against_all_pairs(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 7)))
    base = [[word() for _ in range(40)] for _ in range(12)]
    texts = [None, "", "\n\n", "tiny\ntiny", "日本語の長い行です。同じ文字が続きます。" * 3, "日本語の長い行です。同じ文字が続きます。" * 3 + "終", " " * 40, "y" * 9000]
    for _ in range(60):
        lines = []
        for _ in range(rng.randint(1, 5)):
            words = list(rng.choice(base)) if rng.random() < 0.6 else [word() for _ in range(30)]
            for _ in range(rng.choice([0, 0, 1, 2])):
                words[rng.randrange(len(words))] = word()
            lines.append(" ".join(words))
        texts.append("\n".join(lines))
    docs = table(spark, texts)
    want = plain_lines(texts)
    got = {r.doc_id: r.text for r in fuzzy_lines.drop_lines(docs).collect()}
    # banding may miss a link near the threshold, never make one
    differing = [i for i, t in enumerate(want) if got[i] != t]
    assert len(differing) <= 2 and all(len(got[i]) >= len(want[i]) for i in differing)
    digests = {r.doc_id: r for r in fuzzy_lines.line_digests(docs).collect()}
    assert digests[3].n_removed == 0 and digests[0].n_lines == 0 and digests[5].n_removed == 1
    assert all(digests[i].kept_sha256 == hashlib.sha256((t or "").encode()).hexdigest() for i, t in got.items())
    assert fuzzy_lines.drop_lines(docs.where("false")).count() == 0 and fuzzy_lines.drop_lines(docs).columns == docs.columns
    repeated = table(spark, ["the very same line of text here", "the very same line of text here"], [1, 1])
    assert fuzzy_lines.drop_lines(repeated).count() == 2


def test_no_link_of_a_crowded_band_is_lost(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))
    fixed, first, second = [word() for _ in range(18)], [word() for _ in range(300)], [word() for _ in range(300)]
    variants = {(rng.randrange(300), rng.randrange(300)) for _ in range(900)}
    rows = [" ".join([*fixed[:4], first[i], *fixed[4:12], second[j], *fixed[12:]]) for i, j in sorted(variants)]
    docs = table(spark, ["\n".join(rows[k : k + 50]) for k in range(0, len(rows), 50)])
    lines = fuzzy_lines.line_table(docs)
    sets = {r.id: set(r.s) for r in fuzzy_lines.shingle_sets(lines).collect()}
    shared = defaultdict(list)
    for r in fuzzy_lines.bands(fuzzy_lines.signatures(lines)).collect():
        shared[r.key].append(r.id)
    pairs = {tuple(sorted(p)) for ids in shared.values() for p in itertools.combinations(ids, 2)}
    edges = [(a, b) for a, b in pairs if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    places = lines.groupBy("id").agg(F.min(F.struct("doc_id", "text_id", "n", "check")).alias("at"), F.count("*").alias("times"))
    got = [(r.a, r.b) for r in fuzzy_lines.links(lines, places).collect()]
    assert max(map(len, shared.values())) > 100 and set(got) <= {(max(p), min(p)) for p in edges}
    assert groups(sets, got) == groups(sets, edges)


def test_one_changed_character_of_a_short_line(spark):
    rng = random.Random(7)
    lines = [" ".join("".join(rng.choices("abcdefghijkl", k=rng.randint(4, 7))) for _ in range(10)) for _ in range(20)]
    lines += ["".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(22)) for _ in range(5)]
    typos = [x[:30] + "#" + x[31:] if len(x) > 30 else x[:-1] + "#" for x in lines]
    got = fuzzy_lines.drop_lines(table(spark, ["\n".join(lines), "\n".join(typos)])).orderBy("doc_id").collect()
    # banding may miss a link
    assert got[0].text == "\n".join(lines) and len(got[1].text.split("\n")) <= 2


def test_lines_linked_to_different_leaders_are_compared(spark, monkeypatch):
    rng = random.Random(3)
    paths = []
    for k in range(24):  # each line is similar to the next one only, and all of a path share one band
        chars = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=130))
        paths.append([f"p{k:02d}:{chars[at : at + 90]}" for at in (0, 5, 10, 15)])
    docs = table(spark, ["\n".join(p) for p in paths])
    path = fuzzy_lines.line_table(docs).select("id", F.xxhash64(F.substring("line", 1, 4)).alias("key"))
    bands = fuzzy_lines.bands
    monkeypatch.setattr(fuzzy_lines, "bands", lambda signed: bands(signed).drop("key").distinct().join(path, "id"))
    got = {r.doc_id: r.text for r in fuzzy_lines.drop_lines(docs).collect()}
    assert got == {k: p[0] for k, p in enumerate(paths)}


def test_bitmaps_rule_out_no_similar_pair(spark):
    rng = random.Random(9)
    base = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(50)]
    lines = []
    for k in range(90):
        words = list(base)
        for at in rng.sample(range(50), k % 15):
            words[at] = "".join(rng.choices("abcdefgh", k=6))
        lines.append((k, " ".join(words)))
    texts = spark.createDataFrame(lines, "id long, line string")
    # the first 60 lines are one component, the others are alone
    rows = spark.createDataFrame([(1, k, 0 if k < 60 else k) for k, _ in lines], "key long, id long, component long")
    got = [tuple(sorted((r.a, r.b))) for r in fuzzy_lines._pairs(rows, texts).collect()]
    sets = [shingles(x) for _, x in lines]
    pairs = [p for p in itertools.combinations(range(90), 2) if p[1] >= 60]
    alike = {(a, b) for a, b in pairs if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    assert len(got) == len(set(got)) and alike <= set(got) <= set(pairs) and 0 < len(alike) <= len(got) < len(pairs) / 2


def test_lines_that_share_a_band_by_chance_are_not_compared(spark, monkeypatch):
    rng = random.Random(21)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(400)]
    texts = [" ".join(rng.choices(words, k=40)) for _ in range(40)]
    texts += [x + " more" for x in texts[:5]]
    # every line shares its one band with all others
    monkeypatch.setattr(fuzzy_lines, "bands", lambda signed: signed.select("id").distinct().withColumn("key", F.lit(1).cast("long")))
    counts, judged, sets = Counter(), fuzzy_lines._judged, fuzzy_lines.shingle_sets
    monkeypatch.setattr(fuzzy_lines, "_judged", lambda pairs, x: counts.update(judged=pairs.count()) or judged(pairs, x))
    monkeypatch.setattr(fuzzy_lines, "shingle_sets", lambda x: counts.update(sets=x.count()) or sets(x))
    got = {r.doc_id: r.text for r in fuzzy_lines.drop_lines(table(spark, texts)).collect()}
    assert got == {k: "" if k >= 40 else x for k, x in enumerate(texts)}
    assert counts["judged"] <= 20 and counts["sets"] <= 10


def test_sketches_rule_out_no_similar_lines(spark):
    rng = random.Random(22)
    lines = set()
    for letters in ("abcdefghijklmnopqrstuvwxyz", "éabcdeà ", "".join(chr(0x4E00 + k) for k in range(300))):
        for size in (20, 60, 95, 99, 104, 124, 130, 400, 1500):
            line = rng.choices(letters, k=size)
            for _ in range(8):
                lines.add("x" + "".join(line))
                for _ in range(max(1, size // 60)):
                    line[rng.randrange(size)] = rng.choice(letters)
    lines = sorted(lines)
    signed = fuzzy_lines.signatures(fuzzy_lines.line_table(table(spark, lines))).where("sketched").drop("keys", "marked", "sketched").cache()
    ids = {r.id: shingles(r.line) for r in fuzzy_lines.line_table(table(spark, lines)).collect()}
    assert sorted(r.id for r in signed.collect()) == sorted(ids)
    pairs = signed.select(F.col("id").alias("a")).crossJoin(signed.select(F.col("id").alias("b"))).where("a < b")
    near = {(r.a, r.b) for r in fuzzy_lines._near(pairs, signed).collect()}
    every = list(itertools.combinations(sorted(ids), 2))
    similar = {(a, b) for a, b in every if 5 * len(ids[a] & ids[b]) >= 4 * len(ids[a] | ids[b])}
    assert len(similar) > 100 and similar <= near and len(near) < len(every) / 4


def test_unrelated_lines_hardly_share_bands(spark):
    rng = random.Random(31)
    syllables = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=2)) for _ in range(16)]
    lines = [" ".join("".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(70)) for _ in range(600)]
    keys = fuzzy_lines.bands(fuzzy_lines.signatures(fuzzy_lines.line_table(table(spark, lines)))).distinct()
    assert keys.groupBy("key").count().where("count > 1").count() <= 8


def test_sampling_keeps_lines_that_repeat_themselves(spark):
    rng = random.Random(32)
    texts = []
    for k in range(12):
        words = [f"{k}" + "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=5)) for _ in range(1 + k // 2)]
        texts += ["\n".join(" ".join(words * n) for n in (40, 90, 700)), "".join(words * 50) + "é" * (k % 2)]
    got = {r.doc_id: r.text for r in fuzzy_lines.drop_lines(table(spark, texts)).collect()}
    assert got == dict(enumerate(plain_lines(texts)))
    assert all(got[i].count("\n") == 0 for i in range(0, len(texts), 2))


def test_shingles_are_of_code_points_and_need_no_regular_expression(spark):
    # letters of one, two, three and four bytes; before, a shingle also began in the middle of a surrogate pair
    lines = ["plain words in a plain line", "é à ü ö ß " * 4, "日本語の長い行です。同じ文字が続きます。", "a😀b🎉c𝒳d" * 5, "😀🎉" * 12]
    rows = spark.createDataFrame(list(enumerate(lines)), "id long, line string")
    sets = fuzzy_lines.shingle_sets(rows)
    assert [len(r.s) for r in sets.orderBy("id").collect()] == [len(shingles(x)) for x in lines]
    hashed = spark.createDataFrame([(k, x) for k, line in enumerate(lines) for x in shingles(line)], "id long, x string")
    # a shingle's hash is that of its characters in UTF-32
    want = hashed.groupBy("id").agg(F.collect_set(F.xxhash64(F.encode("x", "UTF-32"))).alias("s"))
    assert {r.id: set(r.s) for r in sets.collect()} == {r.id: set(r.s) for r in want.collect()}
    assert "regexp" not in sets._jdf.queryExecution().toString()
