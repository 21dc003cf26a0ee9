"""Money parsing and money text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cashweave.schema import AMOUNT_STRIP_CHARS, AMOUNT_TYPE, NULL_AMOUNT_TOKENS
from cashweave.functions.numeric import py_round
from cashweave.functions.text import py_strip

_STRIP_CLASS = "[" + "".join("\\" + ch if ch in "\\^]-[" else ch for ch in AMOUNT_STRIP_CHARS) + "]"


def coerce_amount(c: Column | str, dtype: T.DecimalType = AMOUNT_TYPE, trimmed: bool = False) -> Column:
    """Exact amount from bank text.

    null / blank / "nan" / "none" / "null" -> null; "(x)" -> -x; currency
    symbols, thousands separators and spaces removed; anything else that is
    not a decimal number -> null. ``trimmed`` says the text is already
    stripped (a staged column), which keeps the expression small.
    """
    col = F.col(c) if isinstance(c, str) else c
    s = col.cast("string") if trimmed else py_strip(col.cast("string"))
    negative = s.startswith("(") & s.endswith(")")
    body = F.when(negative, s.substr(F.lit(2), F.length(s) - F.lit(2))).otherwise(s)
    body = F.regexp_replace(body, _STRIP_CLASS, "")
    # Only plain decimal syntax (optional sign, digits, optional fraction,
    # optional exponent); this rejects "Infinity", "NaN" and "1_000".
    valid = body.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")
    value = F.when(valid, body.try_cast(dtype))
    blank = (s == "") | F.lower(s).isin(*NULL_AMOUNT_TOKENS)
    return F.when(col.isNull() | blank, F.lit(None).cast(dtype)) \
        .when(negative, -value).otherwise(value)


def inexact_amount(c: Column | str, amount: Column | str, dtype: T.DecimalType = AMOUNT_TYPE) -> Column:
    """Whether text that is a number does not fit the amount type exactly:
    too large (``amount`` is null) or of too many decimals. Such rows are
    rejected with a reason, never rounded."""
    col = F.col(c) if isinstance(c, str) else c
    got = F.col(amount) if isinstance(amount, str) else amount
    digits = F.regexp_replace(col, r"[^0-9.eE+-]", "")
    number = digits.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")
    too_fine = digits.rlike(rf"\.[0-9]{{{dtype.scale}}}[0-9]*[1-9]")
    lost = digits.rlike("[eE]-") & (F.abs(got.cast("double")) != F.abs(digits.try_cast("double")))
    return F.coalesce(number & (got.isNull() | too_fine | lost), F.lit(False))


def plain_amount_text(amount: Column | str) -> Column:
    """All digits of a decimal, never in scientific form, in any session."""
    col = F.col(amount) if isinstance(amount, str) else amount
    return F.regexp_replace(F.format_number(col, AMOUNT_TYPE.scale), ",", "")


def canon_amount_text(amount: Column | str) -> Column:
    """Decimal as plain text without trailing zeros: 4200.00 -> "4200" (X4)."""
    return F.regexp_replace(plain_amount_text(amount), r"\.?0+$", "")


def record_amount_text(amount: Column | str) -> Column:
    """Decimal as plain text, two decimals at least: "4200.00", "4200.005" (P4)."""
    return F.regexp_replace(plain_amount_text(amount), r"(\.[0-9]{2}[0-9]*?)0+$", "$1")


def money_text(x: Column | str) -> Column:
    """Python's f"${x:,.2f}" (X19): "$1,234.50", "$-5.00"."""
    col = F.col(x) if isinstance(x, str) else x
    return F.concat(F.lit("$"), F.format_number(col, 2))


def percent_text(x: Column | str) -> Column:
    """Python's f"{float(x or 0):.0%}" (X29); null counts as 0, ties go to even."""
    col = F.col(x) if isinstance(x, str) else x
    share = py_round(F.coalesce(col.cast("double"), F.lit(0.0)) * 100, 0)
    return F.concat(share.cast("long").cast("string"), F.lit("%"))
