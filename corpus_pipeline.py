"""A training-data pipeline over ``documents``: five stages, each one operator.

Defined results, for each stage and the whole: null texts pass the classifier
or not as texts without n-grams do, have no lines, are no near-duplicates, and
are never mixed in (they have no words). Null doc_ids, sources and languages are
values like others. Of rows that repeat a text the SimHash stage keeps one.
Texts of any length are processed whole. Extra columns, whatever their names,
pass through all stages but the last. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def stage(function: Stage) -> Stage:
    """A stage whose intermediate tables go at once, but for those that its result reads."""

    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        from ingestloom.llm import scratch

        before = scratch.made()
        out = function(spark, docs, sf_dir)
        scratch.release_unread(out, before)
        return out

    return run_stage


@stage
def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling takes stay."""
    from ingestloom.llm.importance import filter_documents

    return filter_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@stage
def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later near-copies of lines go from the texts."""
    from ingestloom.llm.fuzzy_lines import drop_lines

    return drop_lines(docs)


@stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar documents stays: five words a shingle, similarity 0.8 or more."""
    from ingestloom.llm.simhash import drop_near_duplicates

    return drop_near_duplicates(docs)


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    from ingestloom.llm.mixing import apply_mix

    return apply_mix(docs)


@stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of their decoding."""
    import public_tokenizers

    from ingestloom.llm.bpe import round_trip_digests

    return round_trip_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", classify),
    ("line dedup", dedup_lines),
    ("SimHash near-dedup", near_dedup),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode),
]

#: SQL can express neither the trained classifier nor the tokenizer.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``, each written and read by the next; what was read is deleted."""
    from ingestloom.llm import scratch

    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), scratch.made()
    for k, (_, function) in enumerate(STAGES):
        docs = function(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.materialize(docs)
            scratch.release_unread(docs, before)
    return docs
