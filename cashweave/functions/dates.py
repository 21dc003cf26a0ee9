"""Date coercion."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cashweave.functions.text import py_strip

# A clock time (with fraction, AM/PM, zone) behind the date; the calendar date
# is the one written, whatever the zone.
_TIME = (r"(?i)(?:[T ,]+\d{1,2}:\d{2}(?::\d{2}(?:[.,]\d+)?)?\s*(?:[ap]\.?m\.?)?\s*"
         r"(?:Z|UTC|GMT|[+-]\d{2}:?\d{2}|[+-]\d{2})?)$")
_WEEKDAY = r"(?i)^(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*[., ]+"
_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
_MONTH_NAME = (r"^(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|"
               r"sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)$")
_PIVOT = 69     # two-digit years from here on are of the last century


def _month(word: Column) -> Column:
    """Number (as text) of a month's English name, else null."""
    at = F.instr(F.lit(_MONTHS), F.substring(word, 1, 3))
    return F.when(word.rlike(_MONTH_NAME), ((at + 2) / 3).cast("int").cast("string"))


def date_parts(c: Column) -> Column:
    """The words of a date text without weekday and time, as an array."""
    day = F.regexp_replace(F.regexp_replace(c, _TIME, ""), _WEEKDAY, "")
    return F.split(F.lower(F.regexp_replace(day, r"(?i)(\d)(?:st|nd|rd|th)\b", "$1")), r"[-/., ]+")


def date_words(parts: Column) -> dict[str, Column]:
    """The three words, and the numbers of the first two if they name months."""
    words = {k: F.get(parts, F.lit(i)) for i, k in enumerate("abc")}
    return {**words, "n": F.size(parts), "ma": _month(words["a"]), "mb": _month(words["b"])}


def date_of_words(w: dict[str, Column]) -> Column:
    """Calendar date of three words (year first, month first, day first where
    the first number can't be a month, or with a month's name) or of eight
    digits; anything else is null."""
    a, b, c, named_a, named_b = w["a"], w["b"], w["c"], w["ma"].isNotNull(), w["mb"].isNotNull()
    year_first = a.rlike(r"^\d{4}$")
    day_first = named_b | a.rlike(r"^(?:1[3-9]|2\d|3[01])$")
    century = F.when(F.length(c) > 2, F.lit("")).when(c >= str(_PIVOT), F.lit("19")).otherwise(F.lit("20"))
    year = F.when(year_first, a).when(F.length(c).isin(2, 4), F.concat(century, c))
    month = F.when(named_a, w["ma"]).when(named_b, w["mb"]).when(year_first | day_first, b).otherwise(a)
    day = F.when(year_first, c).when(day_first, a).otherwise(b)
    written = F.when(w["n"] == 3, F.concat(year, F.lit("-"), month, F.lit("-"), day)) \
        .when((w["n"] == 1) & (F.length(a) == 8),
              F.concat(F.substring(a, 1, 4), F.lit("-"), F.substring(a, 5, 2), F.lit("-"), F.substring(a, 7, 2)))
    return F.try_to_date(written, "yyyy-M-d")


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, within one expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def with_date(df: DataFrame, source: str, target: str) -> DataFrame:
    """Add ``target``, the date of the trimmed text ``source``, step by step,
    so that every step is computed once per row inside generated code."""
    rest = df.columns
    df = df.withColumn("__parts", date_parts(F.col(source)))
    df = df.select(*rest, *[c.alias(f"__{k}") for k, c in date_words(F.col("__parts")).items()])
    return df.select(*[c for c in rest if c != target],
                     date_of_words({k: F.col(f"__{k}") for k in ("a", "b", "c", "n", "ma", "mb")}).alias(target))


def coerce_date(c: Column | str, formats: Sequence[str] | None = None,
                source_type: T.DataType | None = None, trimmed: bool = False) -> Column:
    """Calendar date from a raw column; unparseable text -> null.

    ``formats`` pins the accepted patterns (e.g. ``["dd/MM/yyyy"]`` for a
    day-first bank). By default ISO dates and times (with fraction, offset or
    ``Z``), eight digits, month-first and unmistakable day-first numbers, and
    dates with a month's name are read, each value on its own.
    """
    col = F.col(c) if isinstance(c, str) else c
    if isinstance(source_type, T.DateType):
        return col
    if isinstance(source_type, (T.TimestampType, T.TimestampNTZType)):
        return F.to_date(col)
    s = col.cast("string") if trimmed else py_strip(col.cast("string"))
    if formats is not None:
        return F.coalesce(*[F.try_to_date(s, f) for f in formats], F.lit(None).cast("date"))
    return _let(date_parts(s), lambda parts: _let(F.struct(*[c.alias(k) for k, c in date_words(parts).items()]), lambda w: date_of_words(
        {k: w[k] for k in ("a", "b", "c", "n", "ma", "mb")})))


def iso_date(c: Column | str) -> Column:
    """``YYYY-MM-DD`` text of a date."""
    col = F.col(c) if isinstance(c, str) else c
    return F.date_format(col, "yyyy-MM-dd")
