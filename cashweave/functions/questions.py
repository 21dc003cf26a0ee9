"""Question parsing (X9, X10, J2) as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cashweave.schema import (
    CATEGORY_SYNONYMS, GENERAL_INTENT, INTENT_PATTERNS, QUESTION_AMOUNT_PATTERN, TAX_CATEGORIES,
)

_WORD = r"[\p{L}\p{N}_]"


def _java_word_bounded(pattern: str) -> str:
    """Python ``(?i)\\b(...)\\b`` with Python's Unicode word boundary."""
    body = pattern.replace("(?i)", "")
    if body.startswith("\\b"):
        body = f"(?<!{_WORD})(?={_WORD})" + body[2:]
    if body.endswith("\\b"):
        body = body[:-2] + f"(?<={_WORD})(?!{_WORD})"
    return "(?i)" + body


def route_intent(question: Column | str) -> Column:
    """First matching intent in fixed order, else "general" (X10)."""
    q = F.coalesce(F.col(question) if isinstance(question, str) else question, F.lit(""))
    out = None
    for intent, pattern in INTENT_PATTERNS:
        cond = q.rlike(_java_word_bounded(pattern))
        out = F.when(cond, F.lit(intent)) if out is None else out.when(cond, F.lit(intent))
    return out.otherwise(F.lit(GENERAL_INTENT))


def question_amount(question: Column | str) -> Column:
    """First number in the question, commas removed, as a double."""
    q = F.col(question) if isinstance(question, str) else question
    found = F.regexp_extract(F.coalesce(q, F.lit("")), QUESTION_AMOUNT_PATTERN, 1)
    return F.when(found != "", F.regexp_replace(found, ",", "").cast("double"))


def question_category(question: Column | str) -> Column:
    """Category named in the question (J2): category names first, then
    synonyms, each in fixed order, as case-folded substrings; else null."""
    q = F.lower(F.coalesce(F.col(question) if isinstance(question, str) else question, F.lit("")))
    out = None
    for name in TAX_CATEGORIES:
        cond = q.contains(F.lit(name.lower()))
        out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    for word, name in CATEGORY_SYNONYMS:
        out = out.when(q.contains(F.lit(word)), F.lit(name))
    return out
