"""Quality rules: lines labelled content or boilerplate by a linear-chain CRF.

Counts of words, symbols, repeated lines and repeated word triples fail a
document outright. Every other document's lines are decoded by Viterbi with a
conditional random field of two states, and the share of words in content lines
decides whether it stays. The field is trained on a bounded sample of labelled
documents: lines of good documents are content, lines of poor ones boilerplate
at first, and two rounds of decoding let poor documents have content lines.

Training reads whole texts of the sampled documents. Very long line sequences
are fitted in segments of ``SEGMENT_LINES``, none left out.

Defined results: null text has no words and fails. Lines without words have no
label and no weight; a document that does not fail has words. Documents of any
length are decoded whole. Without labels of both kinds every line is content.
Repeated rows give repeated results; extra columns, whatever their names, are
dropped. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ingestloom.llm.bytesview import blocks

#: Labelled documents fitted on, at most: those with the least hashes, as many of either kind.
MAX_LABELLED = 1_200
#: Lines of a training sequence; longer documents give several.
SEGMENT_LINES = 64
#: Share of words in content lines from which a document stays.
CONTENT_SHARE = 0.5
MIN_WORDS = 50

_SYMBOLS = frozenset(b"#*$%&|<>")
_SYMBOL_DELETE = bytes(set(range(256)) - _SYMBOLS)
_UPPER_DELETE = bytes(set(range(256)) - set(range(0x41, 0x5B)))
_DIGIT_DELETE = bytes(set(range(256)) - set(range(0x30, 0x3A)))
_PUNCT_DELETE = bytes(set(range(256)) - set(b"!\"'(),-./:;=?@[\\]^_`{}~+"))
_CONTINUATION = bytes(range(0x80, 0xC0))
FEATURES = ("bias", "symbols", "upper", "digits", "marks", "word_length", "repeated_words", "repeated_line", "short", "log_words")


def count_words(text: bytes) -> tuple[int, int, int, int, int, list[list[bytes]]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and the words of each line."""
    lines = [line.split() for line in text.split(b"\n")]
    words = [word for line in lines for word in line]
    chars = len(b"".join(words).translate(None, _CONTINUATION))
    symbols = len(text.translate(None, _SYMBOL_DELETE))
    seen: set[bytes] = set()
    repeated_lines = 0
    for raw, line in zip(text.split(b"\n"), lines, strict=True):
        if line:
            repeated_lines += raw in seen
            seen.add(raw)
    return len(words), chars, symbols, repeated_lines, _repeat_words(words), lines


def _repeat_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words which the text holds twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    _, pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)
    _, which, times = np.unique(pairs[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
    again = times[which] > 1
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift : n - 2 + shift] |= again
    return int(covered.sum())


def line_features(lines: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Features of every line with words, and its number of words."""
    rows, sizes = [], []
    seen: set[bytes] = set()
    for words in lines:
        if not words:
            continue
        n, joined = len(words), b" ".join(words)
        length = len(joined) - n + 1
        rows.append(
            (
                1.0,
                min(1.0, 4 * len(joined.translate(None, _SYMBOL_DELETE)) / length),
                min(1.0, 2 * len(joined.translate(None, _UPPER_DELETE)) / length),
                min(1.0, 4 * len(joined.translate(None, _DIGIT_DELETE)) / length),
                min(1.0, 5 * len(joined.translate(None, _PUNCT_DELETE)) / length),
                min(2.0, length / n / 8),
                1 - len(set(words)) / n if n > 4 else 0.0,
                float(joined in seen),
                float(n < 4),
                min(1.0, np.log1p(n) / 5),
            )
        )
        sizes.append(n)
        seen.add(joined)
    return np.array(rows, float).reshape(-1, len(FEATURES)), np.array(sizes, np.int64)


class LineCRF:
    """Two states, content (0) and boilerplate (1): emission weights of state 1 and transition weights."""

    def __init__(self, emission: np.ndarray | None = None, transition: np.ndarray | None = None):
        self.emission = np.zeros(len(FEATURES)) if emission is None else emission
        self.transition = np.zeros((2, 2)) if transition is None else transition

    def viterbi(self, features: np.ndarray) -> np.ndarray:
        """The most likely states of the lines of one document."""
        score = (features @ self.emission).tolist()
        if not score:
            return np.zeros(0, np.int64)
        (t00, t01), (t10, t11) = self.transition.tolist()
        a, b, back = 0.0, score[0], []
        for s in score[1:]:
            back.append((a + t00 < b + t10, a + t01 < b + t11))
            a, b = max(a + t00, b + t10), max(a + t01, b + t11) + s
        state = int(b > a)
        states = [state]
        for pair in reversed(back):
            state = int(pair[state])
            states.append(state)
        return np.array(states[::-1], np.int64)

    def fit(self, sequences: list[np.ndarray], states: list[np.ndarray], steps: int = 80, rate: float = 0.5, decay: float = 1e-3) -> None:
        """Gradient ascent of the mean log likelihood; all sequences advance together, line by line."""
        order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
        longest = max(map(len, sequences))
        x = np.zeros((len(order), longest, len(FEATURES)))
        y = np.zeros((len(order), longest), np.int64)
        for row, i in enumerate(order):
            x[row, : len(sequences[i])], y[row, : len(states[i])] = sequences[i], states[i]
        alive = np.array([[sum(len(sequences[i]) > t for i in order)] for t in range(longest)])[:, 0]
        total = alive.sum()
        velocity_e, velocity_t = np.zeros_like(self.emission), np.zeros_like(self.transition)
        for _ in range(steps):
            score = x @ self.emission
            forward = np.zeros((longest, len(order), 2))
            forward[0, :, 1] = score[:, 0]
            for t in range(1, longest):
                n = alive[t]
                step = forward[t - 1, :n, :, None] + self.transition
                forward[t, :n] = np.logaddexp(step[:, 0], step[:, 1])
                forward[t, :n, 1] += score[:n, t]
            backward = np.zeros((longest, len(order), 2))
            grad_e, grad_t = np.zeros_like(self.emission), np.zeros_like(self.transition)
            for t in range(longest - 1, -1, -1):
                n, ahead = alive[t], alive[t + 1] if t + 1 < longest else 0
                if ahead:
                    emit = backward[t + 1, :ahead].copy()
                    emit[:, 1] += score[:ahead, t + 1]
                    step = self.transition + emit[:, None, :]
                    backward[t, :ahead] = np.logaddexp(step[:, :, 0], step[:, :, 1])
                    joint = forward[t, :ahead, :, None] + step
                    joint = np.exp(joint - np.logaddexp.reduce(joint.reshape(ahead, 4), axis=1)[:, None, None])
                    grad_t -= joint.sum(axis=0)
                    np.add.at(grad_t, (y[:ahead, t], y[:ahead, t + 1]), 1)
                both = forward[t, :n] + backward[t, :n]
                p = np.exp(both[:, 1] - np.logaddexp(both[:, 0], both[:, 1]))
                grad_e += (y[:n, t] - p) @ x[:n, t]
            velocity_e = 0.9 * velocity_e + rate * (grad_e / total - decay * self.emission)
            velocity_t = 0.9 * velocity_t + rate * (grad_t / total - decay * self.transition)
            self.emission = self.emission + velocity_e
            self.transition = self.transition + velocity_t

    def content_share(self, lines: list[list[bytes]]) -> float:
        """Share of a document's words that lie in content lines."""
        features, sizes = line_features(lines)
        if not len(sizes):
            return 0.0
        return float(sizes[self.viterbi(features) == 0].sum() / sizes.sum())


def train(good: list[np.ndarray], poor: list[np.ndarray], rounds: int = 2) -> LineCRF:
    """A field fitted on the line features of good and of poor documents."""
    crf = LineCRF()
    sequences, owners, kinds = [], [], []
    for kind, some in ((0, good), (1, poor)):
        for features in some:
            if len(features):
                parts = np.array_split(features, -(-len(features) // SEGMENT_LINES))
                sequences += parts
                owners += [len(kinds)] * len(parts)
                kinds.append(kind)
    if len(set(kinds)) < 2:
        return crf
    states = [np.full(len(s), kinds[o]) for s, o in zip(sequences, owners, strict=True)]
    for turn in range(rounds + 1):
        crf.fit(sequences, states)
        if turn < rounds:
            states = [crf.viterbi(s) if kinds[o] else np.zeros(len(s), np.int64) for s, o in zip(sequences, owners, strict=True)]
            marked = {o for s, o in zip(states, owners, strict=True) if s.any()}
            for i, o in enumerate(owners):  # a poor document has some boilerplate
                if kinds[o] and o not in marked:
                    states[i] = np.ones(len(sequences[i]), np.int64)
    return crf


def train_on_labels(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> LineCRF:
    """A field fitted on the documents of a bounded sample of labels; features are made on the executors."""
    chosen = []
    for quality in (0, 1):
        rows = labels.where((F.col("quality") == quality) & F.col("doc_id").isNotNull()).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit // 2).collect()
        chosen += [(r.doc_id, quality) for r in rows]
    if not chosen:
        return LineCRF()
    marked = F.broadcast(docs.sparkSession.createDataFrame(chosen, "id long, quality int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch):
                flat = [line_features([line.split() for line in t.as_py().encode().split(b"\n")])[0].ravel() for t in part.column("text")]
                yield pa.RecordBatch.from_pydict({"id": part.column("id"), "quality": part.column("quality"), "flat": pa.array(flat, pa.list_(pa.float64()))})

    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text"))
    sampled = texts.join(marked, texts["doc"] == marked["id"]).where("text is not null").select("id", "quality", "text").mapInArrow(run, "id long, quality int, flat array<double>")
    rows = sampled.groupBy("id", "quality").agg(F.min("flat").alias("flat")).collect()  # rows that repeat a doc_id give one text
    found = {kind: [np.array(r.flat, float).reshape(-1, len(FEATURES)) for r in sorted(rows, key=lambda r: r.id) if r.quality == kind] for kind in (0, 1)}
    return train(found[1], found[0])


def judge(text: str | None, crf: LineCRF, share: float = CONTENT_SHARE) -> tuple[int, int, int, int, int, bool, float | None, bool]:
    """The five counts, base_failed, the content share (null if failed) and kept."""
    words, chars, symbols, dup_lines, repeats, lines = count_words(text.encode() if text else b"")
    failed = words < MIN_WORDS or 100 * repeats > 50 * words
    content = None if failed else crf.content_share(lines)
    return words, chars, symbols, dup_lines, repeats, failed, content, not failed and content >= share


def apply_rules(docs: DataFrame, crf: LineCRF, share: float = CONTENT_SHARE) -> DataFrame:
    """Counts and verdict of every document."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "content_share", "kept")
    kinds = (*[pa.int64()] * 5, pa.bool_(), pa.float64(), pa.bool_())
    emission, transition = crf.emission, crf.transition

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = LineCRF(emission, transition)
        for batch in batches:
            for part in blocks(batch):
                rows = [judge(t.as_py(), field, share) for t in part.column("text")]
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), **{name: pa.array([r[k] for r in rows], kind) for k, (name, kind) in enumerate(zip(names, kinds, strict=True))}})

    out = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, kept boolean"
    order = ("doc_id", *names[:6], "kept", "content_share")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, out).select(*order)
