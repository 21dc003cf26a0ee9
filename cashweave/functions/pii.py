"""Masking of personal data.

Five patterns, applied in this order, as ``regexp_replace``. Word characters,
digits and word boundaries are spelled out as Unicode classes, so that they
match what Python's ``re`` matches.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_W = r"[\p{L}\p{N}_]"
_D = r"\p{Nd}"
_B_BEFORE_WORD = rf"(?<!{_W})"
_B = rf"(?:(?<={_W})(?!{_W})|(?<!{_W})(?={_W}))"

# The patterns and their order, with Python's Unicode classes.
JAVA_PII_PATTERNS: tuple[tuple[str, str], ...] = (
    (rf"[\p{{L}}\p{{N}}_.+-]+@[\p{{L}}\p{{N}}_-]+\.[\p{{L}}\p{{N}}_.-]+", "[EMAIL]"),
    (rf"{_B_BEFORE_WORD}{_D}{{3}}-{_D}{{2}}-{_D}{{4}}{_B}", "[SSN]"),
    (rf"{_B_BEFORE_WORD}(?:{_D}[ -]?){{13,19}}{_B}", "[CARD]"),
    (rf"(?:(?:\+?{_D}{{1,3}}[ .-]?)?\(?{_D}{{3}}\)?[ .-]?{_D}{{3}}[ .-]?{_D}{{4}})", "[PHONE]"),
    (rf"{_B_BEFORE_WORD}{_D}{{8,}}{_B}", "[ACCT]"),
)


def mask_pii(c: Column | str) -> Column:
    """Masked text; null becomes the empty string."""
    col = F.col(c) if isinstance(c, str) else c
    out = F.coalesce(col.cast("string"), F.lit(""))
    for pattern, token in JAVA_PII_PATTERNS:
        out = F.regexp_replace(out, pattern, token)
    return out
