"""Secret scans: fixed credential patterns, and values that are costly to guess.

Base kinds are found by pattern. The method adds spans of kind ``guess``: a
value that stands in a credential context, outside base spans, mixes letters
and digits, and whose guess cost is high. The cost is that of the cheapest
segmentation of the value into dictionary words, dates, repeats, keyboard walks
and brute-force spans, by dynamic programming over end positions.

Defined results: null text is empty; a text without spans has the digest of the
empty string. Offsets are code points, ends exclusive. Whole texts and whole
values are processed, very long ones as well; the dynamic programme takes time in
proportion to the value's length. Repeated rows give repeated results. Extra
columns, whatever their names, are dropped by ``scan_secrets`` and kept by
``redact_secrets``. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
from collections.abc import Iterator, Mapping
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ingestloom.llm.bytesview import blocks

KINDS = ("assign", "access", "hex", "guess")
#: log10 of the guesses from which a value counts as a secret.
MIN_LOG10_GUESSES = 12.0
#: log10 paid for each segment after the first.
SEGMENT_COST = 0.5

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")  # a maximal run, as any match of 32 or more is
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api")

_CONTEXT_WORDS = ("pass", "pwd", "credential", "secret", "access", "private", "auth", "bearer", "login", "token", "api")
_CONTEXT = re.compile(
    r"""(?<![A-Za-z0-9])(?:pass(?:word|wd|phrase|code)?|pwd|credentials?|secret(?:[_-]?access)?[_-]?key|(?:client[_-]?)?secret|(?:access|private|api)[_-]?key|auth(?:orization)?(?:[_-]?(?:token|key))?|bearer|login|token)["']?(?:\x20*[:=]\x20*|\x20+is\x20+|\x20+)["']?([^\s"'<>,;]{8,})""",
    re.ASCII | re.IGNORECASE,
)

# Common words and passwords, the most common first.
COMMON_WORDS = """password 123456 qwerty letmein admin welcome monkey dragon master login abc123 football baseball
shadow sunshine princess iloveyou trustno1 superman batman michael jordan hunter ranger buster soccer hockey killer
george charlie andrew thomas jessica michelle pepper ginger summer winter spring autumn secret access test guest
root user default changeme company server system database backup service public private token example sample demo
temp temporary internal production staging development hello world love money freedom computer internet google
github oracle mysql postgres redis docker kubernetes windows linux ubuntu apple orange banana cookie coffee flower
purple yellow silver golden diamond phoenix thunder lightning tiger eagle falcon panther lion bear wolf""".split()
KEYBOARD_ROWS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
LOOKALIKES = {"@": "a", "4": "a", "3": "e", "1": "l", "!": "i", "0": "o", "$": "s", "5": "s", "7": "t"}

_COMMON = {word: rank for rank, word in enumerate(COMMON_WORDS, 1)}
#: Letters of a vocabulary word at least, and of any word at most.
_WORD_LETTERS = (4, 24)
_YEAR, _MONTH, _DAY = r"(?:19|20)\d\d", r"(?:0[1-9]|1[0-2])", r"(?:0[1-9]|[12]\d|3[01])"
#: Each date at each place: look-ahead, so that matches may overlap, and one pattern for each form.
_DATES = tuple((re.compile(f"(?=({form}))"), math.log10(guesses)) for form, guesses in ((rf"{_YEAR}([-/._]?){_MONTH}\2{_DAY}", 365 * 120), (rf"{_DAY}([-/._]?){_MONTH}\2{_YEAR}", 365 * 120), (_YEAR, 120)))
#: Parts of a run (repeat, walk, sequence) of up to so many characters are all tried; of a longer one what starts where it does.
RUN_PARTS = 64


def _neighbours() -> set[tuple[str, str]]:
    """Ordered pairs of keys that touch, and the same key twice in a walk counts as a repeat instead."""
    place = {key: (row, at + row * 0.5) for row, keys in enumerate(KEYBOARD_ROWS) for at, key in enumerate(keys)}
    return {(a, b) for a, (r, x) in place.items() for b, (s, y) in place.items() if a != b and abs(r - s) <= 1 and abs(x - y) <= 1}


_TOUCH = _neighbours()


@lru_cache(maxsize=4)
def vocabulary_words(path: str) -> Mapping[str, int]:
    """Words and ranks: the common ones, then the words of a rank file (``base64(token) rank`` a line) in its order.

    Ranks of a trained vocabulary grow as words get rarer, so they stand for the
    order in which a guesser would try them.
    """
    words = dict(_COMMON)
    with open(path, "rb") as file:
        for line in filter(bytes.strip, file):
            word = base64.b64decode(line.split()[0]).strip().lower()
            if _WORD_LETTERS[0] <= len(word) <= _WORD_LETTERS[1] and word.isalpha() and (spelled := word.decode("ascii", "ignore")):
                words.setdefault(spelled, len(words) + 1)
    return words


def _alphabet(value: str) -> int:
    """Size of the alphabet that a guesser would try, from the classes of the value's characters."""
    classes = ((str.islower, 26), (str.isupper, 26), (str.isdigit, 10))
    size = sum(n for test, n in classes if any(map(test, value)))
    return size + (33 if any(not c.isalnum() for c in value) else 0) or 10


def _segments(value: str, words: Mapping[str, int] = _COMMON) -> list[list[tuple[int, float]]]:
    """For each end position the (start, log10 guesses) of patterns that end there."""
    n, low, per_character = len(value), value.lower(), math.log10(_alphabet(value))
    plain = "".join(LOOKALIKES.get(c, c) for c in low)
    ending: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
    for start in range(n):
        for length in range(3, min(_WORD_LETTERS[1], n - start) + 1):
            for spelled, times in ((low, 1), (plain, 4)):
                if (rank := words.get(spelled[start : start + length])) is not None:
                    upper = 1 if value[start : start + length] == low[start : start + length] else 4
                    ending[start + length].append((start, math.log10(rank * times * upper + 1)))
    for form, guesses in _DATES:
        for match in form.finditer(value):
            ending[match.end(1)].append((match.start(1), guesses))
    # runs with a period of one to four characters, walks over touching keys, and steps through the alphabet
    for period in range(1, 5):
        _runs(ending, n, lambda i, p=period: i >= p and value[i] == value[i - p], 2 * period, lambda k, p=period: p * per_character + math.log10(k), lead=period)
    _runs(ending, n, lambda i: i > 0 and (low[i - 1], low[i]) in _TOUCH, 4, lambda k: math.log10(47) + k * math.log10(3))
    for step in (1, -1):
        _runs(ending, n, lambda i, s=step: i > 0 and ord(low[i]) - ord(low[i - 1]) == s, 3, lambda k: math.log10(26 * k))
    return ending


def _runs(ending, n, goes_on, least, cost, lead=1) -> None:
    """Adds runs of positions that go on from the one before, ``lead`` positions earlier, and their parts."""
    start = None
    for i in range(n):
        if not goes_on(i):
            start = None
            continue
        start = i - lead if start is None else start
        for begin in {start, *range(max(start, i + 1 - RUN_PARTS), i + 2 - least)}:
            if i + 1 - begin >= least:
                ending[i + 1].append((begin, cost(i + 1 - begin)))


def guess_cost(value: str, words: Mapping[str, int] = _COMMON) -> float:
    """log10 of the guesses for the cheapest segmentation of ``value``."""
    n, per_character = len(value), math.log10(_alphabet(value))
    ending = _segments(value, words)
    infinity = float("inf")
    brute, closed = [infinity] * (n + 1), [infinity] * (n + 1)  # cheapest with and without a brute-force span at the end
    closed[0] = 0.0
    for end in range(1, n + 1):
        opened = closed[end - 1] + (SEGMENT_COST if end > 1 else 0.0)
        brute[end] = min(brute[end - 1], opened) + per_character
        closed[end] = min((min(brute[s], closed[s]) + cost + (SEGMENT_COST if s else 0.0) for s, cost in ending[end]), default=infinity)
    return min(brute[n], closed[n])


def find_secrets(text: str | None, threshold: float = MIN_LOG10_GUESSES, words: Mapping[str, int] = _COMMON) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of all spans, in order."""
    if not text:
        return []
    low = text.lower()
    spans: list[tuple[int, int, int]] = []
    if any(word in low for word in _ASSIGN_WORDS):
        spans += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    spans += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    if any(word in low for word in _CONTEXT_WORDS):
        base, at = list(spans), 0
        while (m := _CONTEXT.search(text, at)) is not None:
            value = m[1].rstrip(".!?:)]}#&%*")
            start, end = m.start(1), m.start(1) + len(value)
            at = start  # a rejected value may hold the name of the next one
            if len(value) < 8 or not any(map(str.isdigit, value)) or not any(map(str.isalpha, value)):
                continue
            if not _meets(base, start, end) and guess_cost(value, words) >= threshold:
                spans.append((start, 3, end))
                at = end
    return sorted(spans)


def _meets(spans: list[tuple[int, int, int]], start: int, end: int) -> bool:
    return any(s < end and start < e for s, _, e in spans)


def _spell(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scan_secrets(docs: DataFrame, threshold: float = MIN_LOG10_GUESSES, vocabulary: str | None = None) -> DataFrame:
    """doc_id, counts of base kinds and of guessed ones, digest of the base spans, and all spans.

    ``vocabulary`` is the rank file whose words the guesser knows besides the common ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary_words(vocabulary) if vocabulary else _COMMON
        for batch in batches:
            for part in blocks(batch):
                found = [find_secrets(t.as_py(), threshold, words) for t in part.column("text")]
                counts = {f"n_{kind}": pa.array([sum(s[1] == k for s in spans) for spans in found], pa.int64()) for k, kind in enumerate(KINDS)}
                digest = [hashlib.sha256(_spell([s for s in spans if s[1] < 3]).encode()).hexdigest() for spans in found]
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), **counts, "base_sha256": pa.array(digest, pa.string()), "spans": pa.array(list(map(_spell, found)), pa.string())})

    out = "doc_id long, n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, out).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess")


def redact_secrets(docs: DataFrame, mark: str = "[SECRET]", threshold: float = MIN_LOG10_GUESSES, vocabulary: str | None = None) -> DataFrame:
    """The columns of ``docs`` with every span of ``text`` that ``scan_secrets`` finds replaced by ``mark``; overlapping spans merge."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary_words(vocabulary) if vocabulary else _COMMON
        for batch in batches:
            texts = []
            for t in batch.column("text"):
                text, at, out = t.as_py(), 0, []
                for start, _, end in find_secrets(text, threshold, words):
                    if end > at:
                        out += [text[at:start], mark] if start >= at else []
                        at = end
                texts.append(text if text is None else "".join(out) + text[at:])
            yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))

    return docs.mapInArrow(run, docs.schema)
