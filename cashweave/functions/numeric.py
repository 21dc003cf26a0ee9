"""Python-compatible rounding of doubles (Q9)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPLIT = 134217729.0  # 2**27 + 1: Dekker split of a double into two 26-bit halves


def py_round(x: Column, ndigits: int) -> Column:
    """``round(x, ndigits)`` as Python computes it for floats: the decimal
    with ``ndigits`` places nearest to the exact binary value of ``x``, ties
    to even.

    Spark's ``round`` is half-up on the shortest decimal form of ``x``, which
    differs when that form sits exactly on a tie. Starting from Spark's
    result ``s``, the tie just below it is ``T / (2 * 10**n)`` with ``T`` odd;
    the sign of ``T - 2 * 10**n * x`` is computed exactly (Dekker split,
    Sterbenz subtraction), which tells whether ``x`` lies below, on or above
    that tie.
    """
    scale = 10 ** ndigits
    m = float(2 * scale)
    a = F.abs(x)
    s = F.round(a, ndigits)
    k = F.round(s * F.lit(float(scale)))            # integer-valued double
    t = k * F.lit(2.0) - F.lit(1.0)                 # odd: 2 * scale * (tie below s)
    c = a * F.lit(_SPLIT)
    hi = c - (c - a)
    lo = a - hi
    resid = (t - F.lit(m) * hi) - F.lit(m) * lo      # sign exact: > 0 means x below the tie
    down = (k - F.lit(1.0)) / F.lit(float(scale))
    up = k / F.lit(float(scale))
    even_down = F.pmod(k, F.lit(2.0)) == 1.0         # k odd -> k-1 is the even neighbour
    mag = F.when(k < 1, up) \
        .when(resid > 0, down) \
        .when((resid == 0) & even_down, down) \
        .otherwise(up)
    return F.when(x.isNull(), F.lit(None).cast("double")) \
        .when(x < 0, -mag).otherwise(mag)
