"""Operators that look at one document at a time, against plain Python."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ingestloom.llm import bytesview, importance, lines_crf, pii, secrets

bpe = pytest.importorskip("ingestloom.llm.bpe")
public_tokenizers = pytest.importorskip("public_tokenizers")
PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, kept string, spans int"
AWKWARD = [None, "", " ", "\n\n", "word", "\x00\x1c\x85", "é" * 500, "日本語のテキスト😀" * 40, "x" * 60_000, "a.b" * 20_000, "1-" * 20_000, "ha " * 3000, "+1 (" * 9000, "a@" * 20_000]


def table(spark, texts):
    rows = [(i if t != "word" else None, t, None, None, None, "clash", None, 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[:3], SCHEMA)


TEXT = st.text(st.sampled_from("ab  \n\t'sé1.\x1c\xa0　日😀<|endoftext|>THE"), max_size=60)


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXT, max_size=6))
def test_encoding_is_tiktokens(texts):
    import tiktoken

    coder = bpe.load(PATH, PATTERN)
    plain = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=coder.ranks, special_tokens={})
    for text, ids in zip(texts, coder.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode_ordinary(text)
        assert coder.decode_bytes(ids) == text.encode()
        starts, ends = coder.offsets(ids)
        assert all(coder.decode_bytes(ids[4 * k : 4 * k + 4]) in text[s:e].encode() for k, (s, e) in enumerate(zip(starts, ends, strict=True)))


def test_encoding_of_runs_and_long_chunks():
    import tiktoken

    coder = bpe.load(PATH, PATTERN)
    plain = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=coder.ranks, special_tokens={})
    texts = [unit * n for unit in ("a", "ha", "anan", " ", "\n", ".", "é") for n in (1, 2, 3, 7, 50, 333)]
    assert [np.frombuffer(x, "<u4").tolist() for x in coder.encode(texts)] == [plain.encode_ordinary(t) for t in texts]


def test_encoding_frames(spark):
    docs = table(spark, AWKWARD)
    digests = {r.doc_id: r for r in bpe.round_trip_digests(docs, PATH, PATTERN).collect()}
    for i, text in enumerate(AWKWARD):
        if text != "word":
            assert digests[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    encoded = bpe.encode_documents(docs, PATH, PATTERN, with_offsets=True)
    assert {r.text for r in bpe.decode_documents(encoded, PATH, PATTERN).collect()} == {t or "" for t in AWKWARD}
    assert bpe.round_trip_digests(docs.where("false"), PATH, PATTERN).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.sampled_from("ab \n\t\x1cé日"), max_size=30)), min_size=1, max_size=8))
def test_word_views(texts):
    column = pa.array(texts, pa.string())
    words = [(t or "").encode().split() for t in texts]
    assert bytesview.word_counts(column).tolist() == list(map(len, words))
    data, offsets = bytesview.byte_view(column)
    starts, ends, heads = bytesview.word_spans(data, offsets)
    assert [data[s:e].tobytes() for s, e in zip(starts, ends, strict=True)] == [w for ws in words for w in ws]
    sums = bytesview.prefix_hashes(data)
    hashes = bytesview.span_hashes(sums, starts, ends).tolist() if len(starts) else []
    assert len(set(hashes)) == len({w for ws in words for w in ws})


def test_blocks_cover_all_rows():
    batch = pa.RecordBatch.from_pydict({"text": pa.array(["a" * 10, None, "b" * 50, "", "c" * 5], pa.string())}).slice(1)
    parts = list(bytesview.blocks(batch, limit=12))
    assert sum(p.num_rows for p in parts) == 4 and [t for p in parts for t in p.column("text").to_pylist()] == batch.column("text").to_pylist()


# --- secrets -------------------------------------------------------------------


def plain_secrets(text):
    kinds = ((r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 8), (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16), (r"[0-9a-f]+", lambda m: len(m[0]) >= 32))
    return sorted((m.start(), k, m.end()) for k, (pattern, good) in enumerate(kinds) for m in re.finditer(pattern, text or "") if good(m))


PIECES = ["password", "SECRET", "token", "Api_Key", "apikey", "=", ":", " ", '"', "'", "abcdefgh", "x1", "AKIA", "ABCDEFGHIJKL1", "0123456789abcdef", "é", "K", "ſecret", "\n", "passwd"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=14))
def test_base_secrets(pieces):
    text = "".join(pieces)
    assert [s for s in secrets.find_secrets(text) if s[1] < 3] == plain_secrets(text)


def test_guess_costs():
    costs = [secrets.guess_cost(v) for v in ("password", "password123", "P@ssw0rd2020", "qwertyuiop", "aaaaaaaaaaaa", "20200101", "k9Xv2Lq8Zt4W")]
    assert max(costs[:-1]) < secrets.MIN_LOG10_GUESSES < costs[-1]
    assert secrets.guess_cost("x7" * 10_000) < secrets.MIN_LOG10_GUESSES
    assert [k for _, k, _ in secrets.find_secrets("my passphrase is k9Xv2Lq8Zt4W, keep it")] == [3]
    assert secrets.find_secrets("the bearer walked on, and the login was fine: passphrase is tomorrow") == []


def exhaustive_cost(value, words):
    """Cheapest segmentation, by trying every cut; patterns are stated anew."""
    import math
    from functools import lru_cache

    low, plain = value.lower(), "".join(secrets.LOOKALIKES.get(c, c) for c in value.lower())
    alphabet = secrets._alphabet(value)
    year, month, day = "(19|20)[0-9]{2}", "(0[1-9]|1[0-2])", "(0[1-9]|[12][0-9]|3[01])"

    @lru_cache(None)
    def pattern(s, e):
        part, n, found = value[s:e], e - s, []
        for spelled, times in ((low, 1), (plain, 4)):
            if spelled[s:e] in words and 3 <= n <= 24:
                found.append(math.log10(words[spelled[s:e]] * times * (1 if part == low[s:e] else 4) + 1))
        if any(re.fullmatch(f"{year}{sep}{month}{sep}{day}|{day}{sep}{month}{sep}{year}", part) for sep in ("", "-", "/", "[.]", "_")):
            found.append(math.log10(365 * 120))
        if re.fullmatch(year, part):
            found.append(math.log10(120))
        for p in range(1, 5):
            if n >= 2 * p and all(part[i] == part[i - p] for i in range(p, n)):
                found.append(p * math.log10(alphabet) + math.log10(n))
        if n >= 4 and all((a, b) in secrets._TOUCH for a, b in zip(low[s:e], low[s + 1 : e], strict=False)):
            found.append(math.log10(47) + n * math.log10(3))
        if n >= 3 and {ord(b) - ord(a) for a, b in zip(low[s:e], low[s + 1 : e], strict=False)} in ({1}, {-1}):
            found.append(math.log10(26 * n))
        return min(found, default=math.inf)

    @lru_cache(None)
    def best(end, after_brute):
        """Cheapest for what is before ``end``; two brute-force spans never touch."""
        if not end:
            return 0.0
        out = math.inf
        for s in range(end):
            paid = 0.0 if not s else secrets.SEGMENT_COST
            out = min(out, best(s, False) + pattern(s, end) + paid)
            if not after_brute:
                out = min(out, best(s, True) + (end - s) * math.log10(alphabet) + paid)
        return out

    return best(len(value), False)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from(["2020", "0101", "1999-12-31", "pass", "p4ssword", "Secret", "qwer", "abcd", "aaaa", "7", "x", "Z", "-", "31", "987"]), min_size=1, max_size=4).map("".join))
def test_guess_cost_is_the_least(value):
    words = {"password": 1, "secret": 2, "pass": 3, "word": 4, "swo": 5}
    assert abs(secrets.guess_cost(value, words) - exhaustive_cost(value, words)) < 1e-9


def test_hidden_dates_and_contexts():
    assert secrets.guess_cost("2020200101") < secrets.guess_cost("2020938471")
    for text in ("aws_secret_access_key is Xk2mQ9vLrT7bNz4w", "DB_PWD: Xk2mQ9vLrT7bNz4w", "login password: Xk2#mQ9vLrT7bNz4w", "login credentials: Xk2#mQ9vLrT7bNz4w"):
        at = text.index("Xk2")
        assert (at, 3, len(text)) in secrets.find_secrets(text), text
    words = secrets.vocabulary_words(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    assert len(words) > 5000 and secrets.guess_cost("Password", words) < 1


def test_secret_frames(spark):
    docs = table(spark, [*AWKWARD, "token = 'abcdefgh12345678' end"])
    found = {r.doc_id: r for r in secrets.scan_secrets(docs).collect()}
    assert found[len(AWKWARD)].n_assign == 1 and found[0].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert {r.text for r in secrets.redact_secrets(docs).collect()} >= {"[SECRET]' end", None}
    assert secrets.scan_secrets(docs.where("false")).count() == 0


def test_redaction_takes_the_spans_of_the_scan(spark):
    values = ["mountainwindow7", "kitchenharvest42", "qX9vLr72Tz", "abcabcabc1", "government2024history", "Zk3pW8nQ1"]
    docs = table(spark, [f"credentials: password is {v} and more" for v in values])
    ranks, judged = public_tokenizers.path("byte_bpe_50k.tiktoken"), []
    for vocabulary in (None, ranks):
        scanned = {r.doc_id: bool(r.spans) for r in secrets.scan_secrets(docs, vocabulary=vocabulary).collect()}
        masked = {r.doc_id: "[SECRET]" in r.text for r in secrets.redact_secrets(docs, vocabulary=vocabulary).collect()}
        assert masked == scanned
        judged.append(scanned)
    assert judged[0] != judged[1] and any(judged[1].values())


# --- personal data ----------------------------------------------------------------


def luhn(digits):
    twice = [2 * int(c) for c in digits[-2::-2]]
    return (sum(int(c) for c in digits[::-2]) + sum(v - 9 if v > 9 else v for v in twice)) % 10 == 0


def plain_pii(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
    )
    spans = sorted((m.start(), k, m.end()) for k, (_, pattern, good) in enumerate(kinds) for m in re.finditer(pattern, text or "") if good(m))
    return ",".join(f"{kinds[k][0]}:{s}:{e}" for s, k, e in spans)


def test_base_pii_is_plain_regexes(spark):
    rng = random.Random(3)
    pieces = ["a@b.c", "x@y", "@d.e", "_q", ".", "-", " ", "1", "23", "255", "256", "0001", "+1 ", "(555) ", "4111 1111 1111 1111", "4242424242424242", "é", "😀", "378282246310005", "5555-5555-5555-4444", "1.2.3.4", ".5", "+4915112345678", "%", "x"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(1, 9))) for _ in range(3000)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.scan_pii(rows).collect():
        want = plain_pii(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest(), texts[r.doc_id]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [want.count(f"{kind}:") for kind in pii.BASE_KINDS]


def test_added_pii(spark):
    texts = ["pay to IBAN GB82 WEST 1234 5698 7654 32 now", "GB83 WEST 1234 5698 7654 32", "ssn 078-05-1120", "code 078-05-1120", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in pii.scan_pii(rows).collect()}
    assert spans == {0: "iban:12:39", 1: "", 2: "ssn:4:15", 3: "", 4: ""}
    texts = {r.doc_id: r.text for r in pii.redact_pii(spark.createDataFrame([(1, "mail é@x me@x.org or +49 151 12345678!"), (2, None)], "doc_id long, text string")).collect()}
    assert texts == {1: "mail é@x [EMAIL] or [PHONE]!", 2: None}


def test_pii_frames(spark):
    docs = table(spark, AWKWARD)
    for r in pii.scan_pii(docs).collect():
        if r.doc_id is not None:
            assert r.base_sha256 == hashlib.sha256(plain_pii(AWKWARD[r.doc_id]).encode()).hexdigest()
    assert pii.scan_pii(docs.where("false")).count() == 0


def test_very_many_spans(spark):
    n = 20_000
    text = " ".join(f"a{i}@b.org" for i in range(n))
    got = pii.scan_pii(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()[0]
    assert got.n_email == n and got.base_sha256 == hashlib.sha256(plain_pii(text).encode()).hexdigest()


# --- line rules ---------------------------------------------------------------------


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    threes = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {j for i, t in enumerate(threes) if threes.count(t) > 1 for j in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab \n\t#|é\x1c日"), max_size=80))
def test_counts(text):
    assert lines_crf.count_words(text.encode())[:5] == plain_counts(text)


def test_verdicts():
    field = lines_crf.LineCRF(np.array([-1.0, 9.0] + [0.0] * 8))
    words = [f"word{i}" for i in range(50)]
    cases = [None, "", " ".join(words[:49]), " ".join(words), "a b c " * 20, " ".join(words) + " x y z" * 17, "# | #\n" * 60 + " ".join(words), "\n".join(words)]
    for text in cases:
        n, chars, symbols, lines, repeats, failed, content, kept = lines_crf.judge(text, field)
        assert (n, chars, symbols, lines, repeats) == plain_counts(text)
        assert failed == (n < 50 or 100 * repeats > 50 * n) and (content is None) == failed
        if failed:
            assert not kept
        else:
            marks = sum(len(x.split()) for x in text.split("\n") if set(x) <= set("#| "))
            assert kept == (content >= 0.5) and np.isclose(content, 1 - marks / n)


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    for _ in range(30):
        field = lines_crf.LineCRF(rng.normal(size=len(lines_crf.FEATURES)), rng.normal(size=(2, 2)))
        x = rng.random((rng.integers(1, 8), len(lines_crf.FEATURES)))

        def score(path, x=x, field=field):
            return sum(path * (x @ field.emission)) + sum(field.transition[a, b] for a, b in zip(path, path[1:], strict=False))

        every = [np.array([(k >> i) & 1 for i in range(len(x))]) for k in range(1 << len(x))]
        assert np.isclose(score(field.viterbi(x)), max(map(score, every)))


def prose(rng, n):
    return " ".join("".join(rng.choices(["an", "re", "tion", "th", "e", "ou"], k=rng.randint(1, 4))) for _ in range(n))


def test_trained_field_tells_held_out_documents_apart(spark):
    rng = random.Random(5)
    good = ["\n".join(prose(rng, 30) + "." for _ in range(4)) for _ in range(80)]
    poor = ["\n".join(" | ".join(prose(rng, 1) for _ in range(30)) for _ in range(4)) for _ in range(80)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(good + poor)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 80), 0) for i in range(160) if i % 2], "doc_id long, quality int, toxic int")
    field = lines_crf.train_on_labels(docs, labels)
    held = [r for r in lines_crf.apply_rules(docs, field).collect() if r.doc_id % 2 == 0]
    assert sum(r.kept == (r.doc_id < 80) for r in held) / len(held) > 0.95
    verdicts = lines_crf.apply_rules(table(spark, AWKWARD), field).collect()
    assert len(verdicts) == len(AWKWARD) + 3 and not any(r.kept for r in verdicts if r.doc_id in (0, 1, 2))
    untrained = lines_crf.train_on_labels(docs, labels.where("false"))
    assert all(r.kept for r in lines_crf.apply_rules(docs.where("doc_id < 5"), untrained).collect())


# --- importance resampling --------------------------------------------------------


def test_buckets_are_plain_ngrams():
    texts = ["The cat, the CAT!", None, "", "a_b ## c"]
    grams, rows = importance.ngram_buckets(pa.array(texts, pa.string()), 1 << 30)
    counts = [np.bincount(rows, minlength=4)[i] for i in range(4)]
    tokens = [re.findall(r"\w+|[^\w\s]+", (t or "").lower()) for t in texts]
    assert counts == [len(t) + max(0, len(t) - 1) for t in tokens]
    assert len(set(grams[rows == 0])) == len(set(tokens[0])) + len(set(zip(tokens[0], tokens[0][1:], strict=False)))


def test_resampling_on_held_out_documents(spark):
    rng = random.Random(7)
    good = [prose(rng, 80) for _ in range(150)]
    poor = [" ".join(w + "%%%" for w in prose(rng, 80).split()) for _ in range(50)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(good + poor)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 150), 0) for i in range(200) if i % 2], "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in importance.select_documents(docs, labels).collect()}
    held = [i for i in range(0, 200, 2)]
    assert sum((i in kept) == (i < 150) for i in held) / len(held) > 0.95
    assert importance.select_documents(docs, labels, share=0.2).count() == 40
    assert importance.select_documents(docs, labels.where("false")).count() == 200
    assert importance.select_documents(docs.where("false"), labels).count() == 0
    awkward = table(spark, AWKWARD)
    assert importance.filter_documents(awkward, labels).columns == awkward.columns


def test_selection_is_gumbel_top_k(spark):
    """Models, weights, draws and the k largest, stated plainly."""
    import math
    from collections import Counter

    rng = random.Random(3)
    texts = [prose(rng, rng.randint(0, 60)) + rng.choice(["", " ##", " %% %%"]) for _ in range(80)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(40)], "doc_id long, quality int, toxic int")
    grams, rows = importance.ngram_buckets(pa.array(texts, pa.string()))
    mine = [grams[rows == i].tolist() for i in range(len(texts))]
    fitted = importance.sample_labels(labels).fitted
    raw, target = Counter(g for m in mine for g in m), Counter(g for i in fitted for g in mine[i])
    size = importance.BUCKETS
    ratio = lambda g: math.log((target[g] + 1) / (target.total() + size)) - math.log((raw[g] + 1) / (raw.total() + size))
    weights = [sum(map(ratio, m)) for m in mine]
    draws = {r.doc_id: r.g for r in docs.select("doc_id", importance.gumbel(F.col("doc_id")).alias("g")).collect()}
    order = sorted(range(len(texts)), key=lambda i: -(weights[i] + draws[i]))
    got = importance.select_documents(docs, labels, share=25 / len(texts)).collect()
    assert {r.doc_id for r in got} == set(order[:25])
    assert all(abs(r.log_weight - weights[r.doc_id]) < 1e-9 and r.n_ngrams == len(mine[r.doc_id]) for r in got)


def test_the_share_follows_the_labels_and_the_seed_the_sample(spark):
    rng = random.Random(9)
    texts = [prose(rng, rng.randint(1, 12)) + rng.choice(["", " ##"]) for _ in range(300)] + ["word " * 30_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(150)], "doc_id long, quality int, toxic int")
    first, again, other = ({r.doc_id for r in importance.select_documents(docs, labels, seed=s).collect()} for s in (1, 1, 2))
    assert first == again != other and len(first) == len(other) == round(len(texts) * 2 / 3)
    with pytest.raises(ValueError):
        importance.fit(docs, labels, share=1.5)
    ratios, cut = importance.fit(docs, labels)
    scores = importance.score_documents(importance._texts(docs), ratios)
    lost, kept = importance.held_out_error(scores, importance.sample_labels(labels), cut)
    assert 0 <= lost <= 1 and 0 <= kept <= 1


def test_inclusion_frequencies_over_seeds(spark):
    """Draws of 400 seeds against sampling without replacement, one by one in proportion to the weights."""
    weights, k, seeds = np.log(np.array([8.0, 4, 4, 2, 1, 1, 0.5, 0.25])), 3, 400
    frame = spark.range(len(weights)).withColumn("w", F.element_at(F.lit(weights.tolist()), (F.col("id") + 1).cast("int")))
    drawn = frame.join(spark.range(seeds).withColumnRenamed("id", "seed")).withColumn("v", F.col("w") + importance.TEMPERATURE * importance.gumbel(F.col("id"), F.col("seed")))
    top = drawn.groupBy("seed").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("v")).alias("v"), "id"))), 1, k).alias("t")).select(F.explode("t.id").alias("id")).groupBy("id").count()
    got = np.zeros(len(weights))
    for r in top.collect():
        got[r.id] = r["count"] / seeds
    rng, want = np.random.default_rng(5), np.zeros(len(weights))
    for _ in range(20_000):
        want[rng.choice(len(weights), k, replace=False, p=np.exp(weights) / np.exp(weights).sum())] += 1 / 20_000
    assert abs(got - want).max() < 0.09 and got.sum() == pytest.approx(k)


def test_kth_largest(spark):
    rng = random.Random(1)
    values = [round(rng.gauss(0, 1), 3) for _ in range(3000)] + [0.5] * 500
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (1, 2, 700, 1000, 1500, 3499, 3500):
        assert importance.kth_largest(frame, k) == sorted(values, reverse=True)[k - 1]
