"""Date-times in text, against the standard library's ISO reader and a table of free spellings."""

import datetime as dt

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ingestloom.functions.casting import to_datetime
from ingestloom.functions.datetimes import iso_datetime

DAY = dt.datetime(2017, 8, 24)


def parse(spark, texts, how=to_datetime):
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, s string")
    return [r.v for r in rows.select("i", how(F.col("s")).alias("v")).orderBy("i").collect()]


def at(hour, minute=0, second=0, micro=0):
    return DAY.replace(hour=hour, minute=minute, second=second, microsecond=micro)


SPELLINGS = {
    "2017-08-24 10:30 PM": at(22, 30),
    "2017-08-24 10:30pm": at(22, 30),
    "2017-08-24 12:05 am": at(0, 5),
    "2017-08-24 12:05:09 p.m.": at(12, 5, 9),
    "2017-08-24 10 PM": at(22),
    "2017-08-24 at 10:30": at(10, 30),
    "2017-08-24, at 10:30:15": at(10, 30, 15),
    "10:30 2017-08-24": at(10, 30),
    "10:30:15, 2017-08-24": at(10, 30, 15),
    "10:30 PM on 2017-08-24": at(22, 30),
    "Thursday, 2017-08-24": at(0),
    "Thu 2017-08-24 7:05": at(7, 5),
    "thu. 2017-08-24 7:05": at(7, 5),
    "2017-08-24 Thursday 7:05 EST": at(7, 5),
    "2017-08-24 7:05 UTC": at(7, 5),
    "2017-08-24 7:05 +0300": at(7, 5),
    "2017-08-24 7:05:10 GMT-03:00": at(7, 5, 10),
    "2017-08-24 7:05 -0300 (BRST)": at(7, 5),
    "2017-08-24 10h": at(10),
    "2017-08-24 10h36": at(10, 36),
    "2017-08-24 10h36m28.5s": at(10, 36, 28, 500000),
    "2017-08-24 10 hours 36 minutes": at(10, 36),
    " 2017-08-24 ": at(0),
    "2017-08-24 7:05:10.1234567": at(7, 5, 10, 123456),
    "2017-08-24 something": None,
    "2017-08-24 at noon": None,
    "2017-08-24 25:00": None,
    "2017-08-24 10:61 pm": None,
    "2017-08-24 13:30 PM": None,
    "2017-08-24 10:30 Aug": None,
    "2017-08-24 10:30 AUG": None,
    "2017-08-24 2017-08-25": None,
    "2017-99-99 10:30 PM": None,
    "2017-08-24 PM": None,
    "2017-08-24 10:30 11:30": None,
    "Aug 24 2017 10:30": None,
    "10:30": None,
    "": None,
    None: None,
    "2017/08/24 10:30": None,
}


def test_spellings(spark):
    assert dict(zip(SPELLINGS, parse(spark, list(SPELLINGS)), strict=True)) == SPELLINGS


def iso(text):
    try:
        return dt.datetime.fromisoformat(text).replace(tzinfo=None)
    except ValueError:
        return None


def test_iso_spellings(spark):
    days = ["2017-08-24", "20170824", "2020-W53-7", "2021-W53-1", "2017-W34", "2017W344", "2017W34", "2017-W00-1", "2017-W34-8", "2017-02-29", "2017-13-01"]
    times = ["", "T12", "T12:34", " 12:34:56", "x12:34:56.7", "T12:34:56,123456789", "T1234", "T123456", "T123456.5", "T12:34Z", "T12:34+03:00", "T1234-0330", "T12:34:56.25+03:00:30", "T25:00", "T12:60", "T12:3", "T", "-0300", "T12:34 "]
    texts = [d + t for d in days for t in times]
    assert dict(zip(texts, parse(spark, texts, iso_datetime), strict=True)) == {t: iso(t) for t in texts}


@settings(max_examples=5, deadline=None)
@given(st.lists(st.datetimes(dt.datetime(1900, 1, 1)), min_size=20, max_size=40))
def test_what_is_printed_is_read(spark, moments):
    for form, cut in (("%Y-%m-%d %I:%M:%S %p", {"microsecond": 0}), ("%H:%M:%S.%f on %A, %Y-%m-%d", {}), ("%Y-%m-%dT%H:%M:%S.%f", {}), ("%a %Y-%m-%d %Hh%Mm%Ss", {"microsecond": 0}), ("%G-W%V-%u %H%M", {"microsecond": 0, "second": 0})):
        assert parse(spark, [m.strftime(form) for m in moments]) == [m.replace(**cut) for m in moments]
