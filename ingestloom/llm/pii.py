"""Personal data by patterns, checksums and context, in native expressions only.

Regular expressions propose spans; Luhn confirms card numbers and mod-97
confirms bank account numbers (IBAN); words near a span raise its score. Kinds
email, ip, card and phone are the base; iban is added when its checksum holds,
and ssn (three, two and four digits) only where a context word lifts its score
to the threshold.

Positions come from one split and one extraction by the same pattern: the
pieces between matches and the matches alternate, so running lengths give the
offsets. Patterns start only where a longest match can start and are possessive
inside, so no text makes them backtrack over itself or recurse deeply.

Defined results: null text is empty; a text without spans has the digest of the
empty string. Offsets are code points, ends exclusive. Rows are independent:
repeated rows give repeated results. Extra columns, whatever their names, are
dropped by ``scan_pii`` and kept by ``redact_pii``. Very long texts and texts of
very many spans are scanned whole. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ingestloom.llm.names import fresh

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn")

#: Code points on either side of a span in which context words count.
CONTEXT_WIDTH = 48
CONTEXT_LIFT = 0.35
MIN_SCORE = 0.6
#: Matches of a text whose places are summed together.
CHUNK = 256

# How each kind is spelled. Where the longest match can begin is
# stated by look-behind; \G lets an address begin where the last one ended.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: What a text must hold for the pattern to be tried; a cheap test in front.
NEEDS = {"email": "@", "phone": "+", "ssn": "-"}
SCORES = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.4}
CONTEXT = {
    "email": r"(?i)e-?mail|contact|reach|write",
    "ip": r"(?i)\bip\b|address|host|server|login",
    "card": r"(?i)card|visa|master|credit|payment|cvv",
    "phone": r"(?i)phone|call|tel|mobile|cell|fax",
    "iban": r"(?i)iban|account|bank|transfer",
    "ssn": r"(?i)\bssn\b|social\x20security|\bsin\b|tax\x20id",
}
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"


def luhn_holds(digits: Column) -> Column:
    """Whether a string of at most 19 digits passes the Luhn test."""
    padded = F.lpad(digits, 19, "0")
    total = F.lit(0)
    for at in range(19):
        digit = F.ascii(F.substring(padded, at + 1, 1)) - 48
        total = total + (F.when(digit > 4, 2 * digit - 9).otherwise(2 * digit) if (19 - at) % 2 == 0 else digit)
    return total % 10 == 0


def mod97_holds(compact: Column) -> Column:
    """Whether a bank account number without spaces has remainder 1 when its head goes last and letters count from 10."""
    turned = F.split(F.concat(F.substring(compact, 5, 64), F.substring(compact, 1, 4)), "")

    def step(total: Column, char: Column) -> Column:
        code = F.ascii(char)
        return F.when(char == "", total).when(code >= 65, (total * 100 + code - 55) % 97).otherwise((total * 10 + code - 48) % 97).cast("int")

    return F.aggregate(turned, F.lit(0), step) == 1


def _holds(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$")
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "card":
        return luhn_holds(digits)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    if kind == "iban":
        compact = F.replace(match, F.lit(" "), F.lit(""))
        return F.length(compact).between(15, 34) & mod97_holds(compact)
    return F.lit(True)


_SPAN = "array<struct<start:int,kind:int,end:int,score:double>>"


def _running(pairs: Column) -> Column:
    """Start and end of every match, given (piece, match) pairs in order; in proportion to their number.

    Arrays that grow by one element are copied each time, so they grow inside
    chunks only, and chunks are joined at the end.
    """
    one = "struct<start:int,end:int>"
    state = f"struct<at:int,found:array<{one}>>"
    outer = f"struct<at:int,found:array<array<{one}>>>"

    def step(s: Column, pair: Column) -> Column:
        start = s["at"] + F.length(pair["piece"])
        end = start + F.length(pair["match"])
        return F.struct(end.alias("at"), F.concat(s["found"], F.array(F.struct(start.alias("start"), end.alias("end")))).alias("found")).cast(state)

    def chunk(s: Column, first: Column) -> Column:
        begun = F.struct(s["at"].alias("at"), F.array().cast(f"array<{one}>").alias("found"))
        inner = F.aggregate(F.slice(pairs, first, F.lit(CHUNK)), begun, step)
        # the one-element array binds the inner result, which is used twice
        return F.get(F.transform(F.array(inner), lambda r: F.struct(r["at"].alias("at"), F.concat(s["found"], F.array(r["found"])).alias("found"))), F.lit(0)).cast(outer)

    empty = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{one}>>").alias("found"))
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(pairs), F.lit(1)), F.lit(CHUNK)), empty, chunk, lambda s: F.flatten(s["found"]))


def _spans(kind: str, text: Column, matches: Column) -> Column:
    """Confirmed spans of one kind, given the matches of its pattern in ``text``.

    Context is what stands beside a span, as far back and forth as two matches
    of its kind, so that no part of the text is read more than a few times.
    """
    number = KINDS.index(kind)
    n = F.size(matches)

    def placed(pieces: Column, found: Column) -> Column:
        pairs = F.zip_with(F.slice(pieces, F.lit(1), n), found, lambda p, m: F.struct(p.alias("piece"), m.alias("match")))
        # what stands before and behind a match: its own pieces, and the next ones with the matches between
        nothing = F.array(F.lit(""))
        tails = F.transform(pieces, lambda p: F.right(p, F.lit(CONTEXT_WIDTH)))
        heads = F.transform(pieces, lambda p: F.left(p, F.lit(CONTEXT_WIDTH)))
        columns = [
            found.alias("match"),
            _running(pairs).alias("span"),
            F.slice(tails, F.lit(1), n).alias("before"),
            F.slice(F.concat(nothing, found), F.lit(1), n).alias("match_before"),
            F.slice(F.concat(nothing, tails), F.lit(1), n).alias("further_before"),
            F.slice(heads, F.lit(2), n).alias("behind"),
            F.slice(F.concat(found, nothing), F.lit(2), n).alias("match_behind"),
            F.slice(F.concat(heads, nothing), F.lit(3), n).alias("further_behind"),
        ]
        return F.arrays_zip(*columns)

    def scored(z: Column) -> Column:
        before = F.right(F.concat(z["further_before"], z["match_before"], z["before"]), F.lit(CONTEXT_WIDTH))
        behind = F.left(F.concat(z["behind"], z["match_behind"], z["further_behind"]), F.lit(CONTEXT_WIDTH))
        near = F.concat_ws(" ", before, behind)
        score = F.lit(SCORES[kind]) + F.when(near.rlike(CONTEXT[kind]), F.lit(CONTEXT_LIFT)).otherwise(F.lit(0.0))
        return F.struct(z["span"]["start"].alias("start"), F.lit(number).alias("kind"), z["span"]["end"].alias("end"), F.least(F.lit(1.0), score).alias("score"))

    both = F.array(F.struct(F.split(text, PATTERNS[kind], -1).alias("pieces"), matches.alias("matches")))  # binds both, so that the text is split once
    zipped = F.flatten(F.transform(both, lambda b: placed(b["pieces"], b["matches"])))
    confirmed = F.transform(F.filter(zipped, lambda z: _holds(kind, z["match"])), scored)
    if kind not in BASE_KINDS:
        confirmed = F.filter(confirmed, lambda span: span["score"] >= MIN_SCORE)
    return F.when(n > 0, confirmed).otherwise(F.array().cast(_SPAN)).cast(_SPAN)


def _spell(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_spans(docs: DataFrame, text_column: str = "text", whole: str = "_text", found: str = "found") -> DataFrame:
    """The columns of ``docs``, the text as ``whole``, never null, and ``found``: all spans by start, then kind."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    names = fresh([*docs.columns, whole, found], *KINDS)
    at = docs.select(*columns, F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit("")).alias(whole))
    none = F.array().cast("array<string>")
    matches = []
    for kind, name in zip(KINDS, names, strict=True):
        some = F.regexp_extract_all(whole, F.lit(PATTERNS[kind]), F.lit(0))
        matches.append((F.when(F.contains(F.col(whole), F.lit(NEEDS[kind])), some).otherwise(none) if kind in NEEDS else some).alias(name))
    at = at.select(*columns, whole, *matches)
    spans = F.concat(*[_spans(kind, F.col(whole), F.col(name)) for kind, name in zip(KINDS, names, strict=True)])
    return at.select(*columns, whole, F.array_sort(spans).alias(found))


def scan_pii(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base kinds, digest of the base spans, all spans, and the least and mean score."""
    found = find_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    base = F.filter("found", lambda s: s["kind"] < len(BASE_KINDS))
    kinds = F.transform("found", lambda s: s["kind"])
    counts = [(F.size("found") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(BASE_KINDS)]
    least = F.array_min(F.transform("found", lambda s: s["score"]))
    return found.select("doc_id", *counts, F.sha2(_spell(base), 256).alias("base_sha256"), _spell(F.col("found")).alias("spans"), least.alias("least_score"))


def redact_pii(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` with every span of ``text`` replaced by its kind in brackets; what overlaps an earlier span merges into it."""
    names = F.array(*map(F.lit, KINDS))
    whole, spans = fresh(docs.columns, "whole", "found")
    found = find_spans(docs, "text", whole, spans)
    state = "struct<at:int,out:array<string>>"

    def step(s: Column, span: Column) -> Column:
        piece = F.substring(F.col(whole), s["at"] + 1, span["start"] - s["at"])
        mark = F.concat(F.lit("["), F.upper(F.get(names, span["kind"])), F.lit("]"))
        fresh = F.struct(span["end"].alias("at"), F.concat(s["out"], F.array(piece, mark)).alias("out")).cast(state)
        merged = F.struct(F.greatest(s["at"], span["end"]).alias("at"), s["out"].alias("out")).cast(state)
        return F.when(span["start"] >= s["at"], fresh).otherwise(merged)

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    joined = F.aggregate(F.col(spans), start, step, lambda s: F.concat(F.array_join(s["out"], ""), F.substring(F.col(whole), s["at"] + 1, F.length(whole))))
    return found.withColumn("text", F.when(F.col("text").isNotNull(), joined)).select(*docs.columns)
