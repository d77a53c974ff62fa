"""Date-times in text as expressions: ISO 8601 spellings, and an ISO date among words and a time of day.

Zones are read and dropped. Whatever does not fit, or names a moment that does
not exist, is null; nothing raises.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_CLOCK = r"\d{2}(?::\d{2}(?::\d{2}(?:[.,]\d+)?)?)?|\d{4}(?:\d{2}(?:[.,]\d+)?)?"
_OFFSET = r"Z|[+-](?:\d{2}(?::\d{2}(?::\d{2}(?:\.\d+)?)?)?|\d{4}(?:\d{2})?)"
#: What follows the date of an ISO date-time: any one character, the time, a zone.
_ISO_TIME = rf"(?:[\s\S]({_CLOCK})(?:{_OFFSET})?)?$"
_EXTENDED = r"^(\d{4}-\d{2}-\d{2})" + _ISO_TIME
_COMPACT = rf"^(\d{{8}})(?:[^\d]({_CLOCK})(?:{_OFFSET})?)?$"
_WEEK = r"^(\d{4})(?:-W(\d{2})(?:-(\d)(?!\d))?|W(\d{2})(\d)?)" + _ISO_TIME

_DATE = r"(?<![\d-])(\d{4}-\d{2}-\d{2})(?![\d-])"
# Words of free spellings that carry no part of the moment.
FILLER_WORDS = ("at", "on", "and", "of", "ad", "t", "st", "nd", "rd", "th")
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
# Three letters that begin the name of a month, so are no zone.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_NOISE = r"(?i)(?<![a-z])(?:" + "|".join((*FILLER_WORDS, *(rf"{day[:3]}(?:{day[3:]})?" for day in WEEKDAYS))) + r")(?![a-z])\.?"
_HALF = r"(?:\s?(?i:([ap])(?: ?m)?)(?![A-Za-z]))"
_ZONE = rf"(?:\s?(?:(?!(?i:{'|'.join(MONTHS)}))[A-Z]{{1,5}}|z|utc|gmt)(?![A-Za-z]))?(?:\s?[+-]\d{{1,2}}(?::?\d{{2}})?)?(?:\s?\([A-Z]{{3,5}}\))?$"
#: Times of day: pattern, and the groups of hour, minute, second, fraction and half of the day (0: none).
_TIMES = (
    (rf"^(\d{{1,2}}):(\d{{2}})(?::(\d{{2}})(?:[.,](\d{{1,6}})\d*)?)?{_HALF}?{_ZONE}", (1, 2, 3, 4, 5)),
    (rf"^(\d{{1,2}})\s?(?i:h|hours?)(?:\s?(\d{{1,2}})(?:\s?(?i:m|minutes?)(?:\s?(\d{{1,2}})(?:\.(\d{{1,6}})\d*)?\s?(?i:s|seconds?))?)?)?{_HALF}?{_ZONE}", (1, 2, 3, 4, 5)),
    (rf"^(\d{{1,2}}){_HALF}{_ZONE}", (1, 0, 0, 0, 2)),
)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once; keeps long expressions out of generated code, which has a size limit."""
    return F.transform(F.array(value), body)[0]


def _moment(day: Column, clock: Column) -> Column:
    """A date and a time of day as digits, of which a part at the end may be missing."""
    digits = F.rpad(F.regexp_replace(F.substring_index(F.translate(clock, ",", "."), ".", 1), ":", ""), 6, "0")
    fraction = F.rpad(F.substring(F.regexp_extract(clock, r"[.,](\d+)$", 1), 1, 6), 6, "0")
    time = F.concat_ws(":", F.substring(digits, 1, 2), F.substring(digits, 3, 2), F.substring(digits, 5, 2))
    return F.concat(day, F.lit(" "), time, F.lit("."), fraction).try_cast("timestamp_ntz")


def _week_day(text: Column) -> Column:
    """The date of a year, week and day of the week as text; null where the year has no such week."""
    part = lambda k: F.regexp_extract(text, _WEEK, k)
    week = F.concat(part(2), part(4)).try_cast("int")
    weekday = F.coalesce(F.concat(part(3), part(5)).try_cast("int"), F.lit(1))
    first = F.date_trunc("week", F.concat(part(1), F.lit("-01-04")).try_cast("date")).cast("date")
    thursday = F.date_add(first, (week - 1) * 7 + 3)  # its year is the week's year
    valid = week.between(1, 53) & weekday.between(1, 7) & (F.year(thursday) == part(1).try_cast("int"))
    return F.when(valid, F.date_add(first, (week - 1) * 7 + weekday - 1).cast("string"))


def iso_datetime(text: Column) -> Column:
    """Dates with or without dashes, and week dates, then any one character and a time with or without colons."""
    compact = F.regexp_replace(F.regexp_extract(text, _COMPACT, 1), r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")
    return (
        F.when(text.rlike(_EXTENDED), _moment(F.regexp_extract(text, _EXTENDED, 1), F.regexp_extract(text, _EXTENDED, 2)))
        .when(text.rlike(_COMPACT), _moment(compact, F.regexp_extract(text, _COMPACT, 2)))
        .when(text.rlike(_WEEK), _let(text, lambda t: _moment(_week_day(t), F.regexp_extract(t, _WEEK, 6))))
    )


def free_datetime(text: Column) -> Column:
    """One ISO date, and around it nothing but filler words, a weekday and one time of day with a zone.

    The time is ``10:30``, ``10:30:15.5``, ``10h 30m 5s`` or ``10 pm``; a half of
    the day takes hours to 12. The weekday is not held against the date.
    """
    one = F.regexp_count(text, F.lit(_DATE)) == 1
    return F.when(one, _let(text, lambda t: _let(_around(t), lambda around: _beside(F.regexp_extract(t, _DATE, 1), around))))


def _around(text: Column) -> Column:
    """What is left of a text without its date, filler words and punctuation that is no part of a time or zone."""
    around = F.regexp_replace(F.regexp_replace(text, _DATE, " "), _NOISE, " ")
    around = F.regexp_replace(around, r"[;'/]|[.,](?!\d)|(?<!\d)[.,]|(?<![\d:a-zA-Z ])-|-(?!\d)", " ")
    return F.trim(F.regexp_replace(around, r"\s+", " "))


def _beside(day: Column, around: Column) -> Column:
    """A date at the time of day that the rest of the text is."""
    found = F.when(around == "", day.try_cast("timestamp_ntz"))
    for pattern, groups in _TIMES:
        hour, minute, second, fraction, half = (F.regexp_extract(around, pattern, g) if g else F.lit("") for g in groups)
        number = hour.try_cast("int")
        of_day = F.when(half == "", number).when(number <= 12, number % 12 + F.when(F.lower(half) == "p", 12).otherwise(0))
        time = F.concat_ws(":", F.lpad(of_day.cast("string"), 2, "0"), F.lpad(minute, 2, "0"), F.lpad(second, 2, "0"))
        moment = F.concat(day, F.lit(" "), time, F.lit("."), F.rpad(fraction, 6, "0")).try_cast("timestamp_ntz")
        found = found.when(around.rlike(pattern), F.when(of_day.isNotNull(), moment))
    return found
