"""Quality classifier: importance resampling with hashed n-gram models.

Unigrams and bigrams of lower-cased tokens (runs of word bytes, runs of marks)
are hashed into a fixed number of buckets. One generative model is counted over
all documents, one over a bounded sample of documents labelled good. A
document's log weight is the sum of the log ratios of its n-grams: of the
probability of its n-grams under the target model over that under the raw one.
The documents are sampled by Gumbel top-k: each log weight gets a Gumbel draw
that depends on the doc_id and the seed alone, and the k largest stay, which is
a sample without replacement in proportion to the weights. k is a share of the
corpus: a parameter, by default the share of good documents among the labels.

Defined results: null and empty text has no n-grams and log weight 0. Without
a good label there is no target and every document stays. Rows tied at the cut
all stay. Repeated
rows are scored alike. Extra columns are dropped by ``select_documents`` and
kept by ``filter_documents``,
whatever their names. Very long texts are scored whole. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ingestloom.llm.bytesview import SEPARATORS, blocks, byte_view, mix, prefix_hashes, span_hashes
from ingestloom.llm.names import fresh
from ingestloom.llm.scratch import materialize

BUCKETS = 1 << 17
#: Labelled documents that are fitted on, at most: those with the least hashes.
MAX_LABELLED = 20_000
SMOOTHING = 1.0
#: Scale of the Gumbel draws; 1 samples in proportion to the weights, less is nearer to the k largest.
TEMPERATURE = 1.0
SEED = 11
#: A good document lost counts as many poor ones kept, when the threshold is chosen.
LOSS_OF_GOOD = 4.0
_BINS = 2048

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
#: 0 separator, 1 byte of a word, 2 mark.
_CLASS = np.full(256, 2, np.uint8)
_CLASS[SEPARATORS] = 0
_CLASS[[*range(0x30, 0x3A), *range(0x41, 0x5B), 0x5F, *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1


def ngram_buckets(column: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every n-gram, unigrams first within a row, and the row of each."""
    data, offsets = byte_view(column)
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = _CLASS[data]
    first = np.ones(len(data), bool)
    first[1:] = kind[1:] != kind[:-1]
    first[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = np.flatnonzero(first)
    ends = np.append(starts[1:], len(data))
    real = kind[starts] > 0
    starts, ends = starts[real], ends[real]
    rows = np.searchsorted(offsets, starts, side="right") - 1
    words = span_hashes(prefix_hashes(_LOWER[data]), starts, ends)
    pairs = mix(words[:-1] * np.uint64(0xD6E8FEB86659FD93) + words[1:])
    same = rows[:-1] == rows[1:]
    grams = np.concatenate([words, pairs[same]]) % np.uint64(buckets)
    return grams.astype(np.int64), np.concatenate([rows, rows[:-1][same]])


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


@dataclass(frozen=True)
class Labelled:
    """doc_ids of a bounded sample of labels: good and poor ones that are held out, and good ones that the target model is fitted on."""

    good: np.ndarray
    poor: np.ndarray
    fitted: np.ndarray
    share: float  #: of good documents among the sample


def sample_labels(labels: DataFrame, limit: int = MAX_LABELLED) -> Labelled:
    """``limit`` labels at most. Every other good document is fitted on, unless it is toxic; a document scores higher under a model that has counted it."""
    rows = labels.where("doc_id is not null and quality is not null").select("doc_id", (F.col("quality") == 1).alias("good"), (F.coalesce(F.col("toxic"), F.lit(0)) == 0).alias("clean"))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "good", "clean").limit(limit).collect()
    good = [r for r in rows if r.good]
    fitted = np.unique(np.array([r.doc_id for r in good[::2] if r.clean], np.int64))
    held = np.setdiff1d(np.array([r.doc_id for r in good[1::2]], np.int64), fitted)
    return Labelled(held, np.unique(np.array([r.doc_id for r in rows if not r.good], np.int64)), fitted, len(good) / max(len(rows), 1))


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("doc_id").fill_null(-1 << 62).to_numpy(zero_copy_only=False)


def log_ratios(docs: DataFrame, good: np.ndarray, buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> np.ndarray:
    """Log of target over raw probability for each bucket; raw counts are of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            for part in blocks(batch):
                grams, rows = ngram_buckets(part.column("text"), buckets)
                raw += np.bincount(grams, minlength=buckets)
                chosen = np.isin(_ids(part), good)
                if chosen.any():
                    target += np.bincount(grams[chosen[rows]], minlength=buckets)
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(used, pa.int64()), "raw": pa.array(raw[used]), "target": pa.array(target[used])})

    counts = _texts(docs).mapInArrow(run, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    found = counts.toPandas()  # one row a bucket at most
    raw, target = np.full(buckets, smoothing), np.full(buckets, smoothing)
    raw[found.bucket] += found.raw
    target[found.bucket] += found.target
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def score_documents(docs: DataFrame, ratios: np.ndarray, ngrams: str = "_ngrams", weight: str = "_weight") -> DataFrame:
    """The columns of ``docs``, then the number of n-grams and the log weight of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)  # as large as the number of buckets, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            for part in blocks(batch):
                grams, rows = ngram_buckets(part.column("text"), len(table))
                counts = np.bincount(rows, minlength=part.num_rows)
                weights = np.bincount(rows, weights=table[grams], minlength=part.num_rows)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(counts, pa.int64()), pa.array(weights, pa.float64())], names=[*part.schema.names, ngrams, weight])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(ngrams, LongType()), StructField(weight, DoubleType())]))


def held_out_error(scores: DataFrame, sample: Labelled, cut: float) -> tuple[float, float]:
    """A report: the shares of held-out good documents below ``cut`` and of poor ones above it."""
    spark = scores.sparkSession
    marked = spark.createDataFrame([(int(i), kind) for kind, some in ((True, sample.good), (False, sample.poor)) for i in some], "id long, good boolean")
    found = scores.join(F.broadcast(marked), scores["doc_id"] == marked["id"])  # as many rows as the sample
    row = found.agg(F.avg(F.when(F.col("good"), (F.col("_weight") < F.lit(cut)).cast("int"))), F.avg(F.when(~F.col("good"), (F.col("_weight") >= F.lit(cut)).cast("int")))).first()
    return row[0] or 0.0, row[1] or 0.0


def gumbel(doc_id: F.Column, seed: int | F.Column = SEED) -> F.Column:
    """A standard Gumbel draw that depends on doc_id and seed alone."""
    uniform = (F.shiftrightunsigned(F.xxhash64(F.coalesce(doc_id.cast("long"), F.lit(-1).cast("long")), F.lit(seed).cast("int")), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(uniform))


def kth_largest(values: DataFrame, k: int, column: str = "v") -> float:
    """The value that k rows reach or exceed, by histograms that narrow to it; only bins reach the driver."""
    low, high = values.agg(F.min(column), F.max(column)).first()
    above = 0
    while low < high:
        width = (high - low) / _BINS
        inside = values.where(F.col(column).between(low, high)) if above else values.where(F.col(column) >= low)
        bins = F.least(F.lit(_BINS - 1), F.floor((F.col(column) - F.lit(low)) / F.lit(width))) if width > 0 else F.lit(0)
        table = inside.groupBy(bins.cast("int").alias("bin")).agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).orderBy(F.desc("bin")).collect()
        for row in table:
            if above + row.n >= k:
                break
            above += row.n
        if row.n == 1 or len(table) == 1 and (row.low, row.high) == (low, high):
            return float(row.low)
        low, high = row.low, row.high
    return float(low)


def _drawn(temperature: float, seed: int, weight: str = "_weight") -> F.Column:
    return F.col(weight) + temperature * gumbel(F.col("doc_id"), seed)


def fit(docs: DataFrame, labels: DataFrame, share: float | None = None, temperature: float = TEMPERATURE, seed: int = SEED, limit: int = MAX_LABELLED, buckets: int = BUCKETS) -> tuple[np.ndarray, float]:
    """(log ratios of the buckets, least drawn weight of a document that stays). ``share`` of all rows stay, to the nearest row."""
    if share is not None and not 0 <= share <= 1:
        raise ValueError("share lies between 0 and 1")
    sample = sample_labels(labels, limit)
    if not len(sample.fitted):
        return np.zeros(buckets), -np.inf
    ratios = log_ratios(docs, sample.fitted, buckets)
    scores = materialize(score_documents(_texts(docs), ratios).select("doc_id", "_weight"))
    n = scores.count()
    k = round((sample.share if share is None else share) * n)
    if k <= 0:
        return ratios, np.inf
    if k >= n:
        return ratios, -np.inf
    return ratios, kth_largest(scores.select(_drawn(temperature, seed).alias("v")), k)


def select_documents(docs: DataFrame, labels: DataFrame, temperature: float = TEMPERATURE, seed: int = SEED, **options) -> DataFrame:
    """doc_id, n_ngrams, log_weight and kept (always true) of the sampled documents."""
    ratios, cut = fit(docs, labels, temperature=temperature, seed=seed, **options)
    taken = score_documents(_texts(docs), ratios).where(_drawn(temperature, seed) >= F.lit(cut))
    return taken.select("doc_id", F.col("_ngrams").alias("n_ngrams"), F.col("_weight").alias("log_weight"), F.lit(True).alias("kept"))


def filter_documents(docs: DataFrame, labels: DataFrame, temperature: float = TEMPERATURE, seed: int = SEED, **options) -> DataFrame:
    """The columns of ``docs`` for the sampled documents; they are scored as they are read, so no text is shuffled."""
    ratios, cut = fit(docs, labels, temperature=temperature, seed=seed, **options)
    names = fresh(docs.columns, "_ngrams", "_weight")
    return score_documents(docs, ratios, *names).where(_drawn(temperature, seed, names[1]) >= F.lit(cut)).select(*docs.columns)
