"""Columns of a user that are named like those the operators use inside."""

import pytest

from ingestloom.llm import fuzzy_lines, importance, mixing, pii, secrets, simhash, substrings

INSIDE = "id key copies rows doc node once gone ranges in_doc in_text found whole email quality _weight _ngrams row nth".split()


@pytest.mark.parametrize(
    "keeps",
    [simhash.drop_near_duplicates, mixing.apply_mix, fuzzy_lines.drop_lines, substrings.drop_repeats, pii.redact_pii, secrets.redact_secrets, lambda d: importance.filter_documents(d, d.sparkSession.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int"))],
    ids="simhash mixing lines repeats pii secrets importance".split(),
)
def test_clashing_columns_are_kept(spark, keeps):
    text = "some words of mail a@b.org that are long enough to be a line of text " * 8
    rows = [(1, text, "s", *[f"u{k}" for k in range(len(INSIDE))]), (2, "other " + text, None, *["v"] * len(INSIDE)), (None, None, None, *[None] * len(INSIDE))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in INSIDE))
    out = keeps(docs)
    assert out.columns == docs.columns
    theirs = {tuple(r[c] for c in INSIDE) for r in docs.collect()}
    assert {tuple(r[c] for c in INSIDE) for r in out.collect()} <= theirs
