"""Text helpers with Python ``str`` semantics, written as JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cashweave.schema import TOKEN_PATTERN

# Python's str.isspace() set: Unicode White_Space plus the four ASCII
# information separators \x1c-\x1f.
PY_SPACE = r"[\p{IsWhite_Space}\x1c-\x1f]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c: Column | str) -> Column:
    """``str.strip()``: remove leading and trailing whitespace."""
    return F.regexp_replace(_col(c), f"^{PY_SPACE}+|{PY_SPACE}+$", "")


def canon_description(c: Column | str) -> Column:
    """Trim, lower-case, collapse whitespace runs to one space."""
    s = F.lower(py_strip(F.coalesce(_col(c).cast("string"), F.lit(""))))
    return F.regexp_replace(s, f"{PY_SPACE}+", " ")


def tokenize(c: Column | str) -> Column:
    """ASCII word tokens of two or more characters, lower-cased (X11).

    The match runs on the original text and lower-casing follows, as in the
    embedder we match.
    """
    found = F.regexp_extract_all(F.coalesce(_col(c), F.lit("")), F.lit(TOKEN_PATTERN), 1)
    return F.transform(found, lambda t: F.lower(t))
