import datetime as dt
import enum
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ingestloom.functions.casting import ColumnRules, cast_column, cast_value
from ingestloom.functions.nulls import is_null_value
from ingestloom.model import ColumnModel


def cast_all(spark, values, kind, rules=None, **model):
    rows = spark.createDataFrame(list(enumerate(values)), "i long, s string")
    value, failed = cast_column(F.col("s"), ColumnModel("c", kind, **model), rules=rules, table="t")
    out = rows.select("i", value.alias("v"), failed.alias("f")).orderBy("i").collect()
    return [r.v for r in out], [r.f for r in out]


def test_integers(spark):
    got, failed = cast_all(spark, ["123", "42.0", "  7  ", "+5", "007", "abc", "", None, "1.80", "2.5", "1e3", "99999999999999999999", "1_000", "-12.00"], "integer")
    assert got == [123, 42, 7, 5, 7, None, None, None, None, None, None, None, None, -12]
    assert failed == [False] * 5 + [True, False, False, True, True, True, True, True, False]


def test_floats(spark):
    got, failed = cast_all(spark, ["1.80", "2.50", "2", "x", "nan", " 3 "], "float")
    assert got == [1.8, 2.5, 2.0, None, None, 3.0]
    assert failed == [False, False, False, True, False, False]


def test_booleans(spark):
    got, _ = cast_all(spark, ["yes", "no", "T", "f", " 1 ", "0", "on", "1.0", "TRUE"], "boolean")
    assert got == [True, False, True, False, True, False, None, None, True]


def test_dates(spark):
    day = dt.date(2017, 8, 24)
    got, _ = cast_all(spark, ["20170824", "24-AUG-2017", "2017-08-24", "24/08/2017", "2017-08-24T12:00:00", "2017-99-99", "Aug 24 2017", "2017824"], "date")
    assert got == [day] * 4 + [None] * 4


def test_datetimes(spark):
    midnight = dt.datetime(2017, 8, 24)
    texts = ["2017-08-24T12:34:56", "2017-08-24 12:34", "20170824", "24/08/2017", "2017-08-24", "2017-08-24 something", "2017-99-99", "not a date", "20170824T123456", "2017-08-24 10:30 PM", "2017-08-24T12:34:56Z"]
    got, _ = cast_all(spark, texts, "datetime")
    noon = dt.datetime(2017, 8, 24, 12, 34, 56)
    assert got == [noon, noon.replace(second=0), midnight, midnight, midnight, None, None, None, noon, dt.datetime(2017, 8, 24, 22, 30), noon]


@pytest.mark.parametrize("text", ["NULL", " null ", "NaN", "N/A", "none", "", "None", None, "na", " \t"])
def test_null_sentinels(spark, text):
    assert cast_all(spark, [text], "string") == ([None], [False])
    assert is_null_value(text)


def test_text(spark):
    got, _ = cast_all(spark, [" keep me ", "007", "1.50", "1.0", "+5", "-0.00", "abcdefgh", "1.2.3", "100"], "string", length=7)
    assert got == ["keep me", "7", "1.5", "1", "5", "0", "abcdefg", "1.2.3", "100"]
    assert cast_all(spark, ["007"], "string", canonical=False)[0] == ["007"]


def canonical(text):
    """The rule in plain Python, over decimals short enough to print without an exponent."""
    from decimal import Decimal

    value = Decimal(text)
    whole = format(value.normalize(), "f")
    return "0" if whole in ("-0", "0") else whole


@settings(max_examples=5, deadline=None)
@given(st.lists(st.from_regex(r"[+-]?[0-9]{1,9}(\.[0-9]{1,5})?", fullmatch=True), min_size=20, max_size=60))
def test_canonical_numbers(spark, texts):
    assert cast_all(spark, texts, "string")[0] == [canonical(t) for t in texts]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(max_size=12), min_size=10, max_size=40))
def test_any_text_casts(spark, texts):
    for kind in ("integer", "float", "boolean", "date", "datetime", "string"):
        assert len(cast_all(spark, texts, kind)[0]) == len(texts)


class Role(enum.Enum):
    FIRST = "first author"
    LAST = "last author"


class Grade(enum.IntEnum):
    LOW = 1
    HIGH = 2


def test_enum_rules(spark):
    rules = ColumnRules()
    rules.register("t", "c", enum_type=Role)
    assert cast_all(spark, ["first author", " last author ", "BOGUS", "", None], "string", rules) == (["FIRST", "LAST", None, None, None], [False, False, True, False, False])
    rules.register("t", "c", enum_type=Grade)
    assert cast_all(spark, ["1", "2.0", "99"], "string", rules) == (["LOW", "HIGH", None], [False, False, True])
    assert cast_value(spark, Grade.HIGH, ColumnModel("c"), rules, "t") == "HIGH"


def test_scalar_rules(spark):
    rules = ColumnRules()
    rules.register("t", "c", scalar=lambda v: {"S": "S", "C": "C"}[v])
    assert cast_all(spark, ["S", "BOGUS", "C", None], "string", rules) == (["S", None, "C", None], [False, True, False, False])
    with pytest.raises(ValueError):
        rules.register("t", "c")
    with pytest.raises(ValueError):
        rules.register("t", "c", scalar=str, enum_type=Role)


def test_single_values(spark):
    told = []
    assert cast_value(spark, 42.0, ColumnModel("c", "integer")) == 42
    assert cast_value(spark, 2.5, ColumnModel("c", "integer"), on_error=told.append) is None
    assert cast_value(spark, math.nan, ColumnModel("c", "float"), on_error=told.append) is None
    assert told == [2.5]
