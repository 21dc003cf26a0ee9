"""Piecewise-linear trend of a running balance, with change points.

Per account the zero-filled daily balance is cut into the segments whose
separate least-squares lines leave the least squared error in total. For each
number of segments the best cuts are found exactly, by dynamic programming: the
best k segments up to a day are the best k - 1 up to an earlier day and one
line from there, and a line's error comes from prefix sums in constant time.
The number of segments is the one of least

    n * ln(error / n + 0.0001) + penalty * segments * ln(n)

(n days, balances in currency units, the floor is a squared cent). Of equal
cuts the earlier one counts, of equal numbers the smaller.

A group is one account's calendar, a row a day, so a busy account is no larger
than a quiet one; transactions are summed by day before. Lines, weekday
effects and the projection are Spark aggregates over the days.

An account of fewer than ``2 * min_days`` days is one segment; one of a single
day has slope 0 and its balance as intercept. Accounts without rows do not
appear, an empty table gives an empty result. Days are unique by account after
``daily_series``, so repeated transactions only add up.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cashweave.operators.forecast import daily_series, running_balance
from cashweave.session import ship_package

CHANGING_METHOD = "changing_trend"
MAX_SEGMENTS = 6
MIN_DAYS = 14
PENALTY = 3.0               # slope, intercept and cut of a segment
ERROR_FLOOR = 0.0001


def best_cuts(y: np.ndarray, max_segments: int, min_days: int, penalty: float) -> list[int]:
    """First days of the segments of ``y`` (one value a day), 0 included."""
    n = len(y)
    most = max(1, min(max_segments, n // min_days))
    if most == 1:
        return [0]
    t, v = np.arange(n, dtype=float), y - y[0]
    sy, sty, syy = (np.concatenate([[0.0], np.cumsum(x)]) for x in (v, t * v, v * v))

    def error(first: np.ndarray, end: int) -> np.ndarray:
        days = (end - first).astype(float)
        total, middle = sy[end] - sy[first], (first + end - 1) / 2.0
        across = sty[end] - sty[first] - middle * total
        spread = np.maximum(days * (days * days - 1.0) / 12.0, 1.0)
        return np.maximum(syy[end] - syy[first] - total * total / days - across * across / spread, 0.0)

    best = np.full((most, n + 1), np.inf)
    cut = np.zeros((most, n + 1), dtype=np.int64)
    for end in range(min_days, n + 1):
        best[0, end] = error(np.array([0]), end)[0]
        starts = np.arange(min_days, end - min_days + 1)
        if len(starts):
            last = error(starts, end)
            for k in range(1, most):
                totals = best[k - 1, starts] + last
                at = int(np.argmin(totals))
                best[k, end], cut[k, end] = totals[at], starts[at]
    count = np.arange(1, most + 1)
    k = int(np.argmin(n * np.log(best[:, n] / n + ERROR_FLOOR) + penalty * count * np.log(n)))
    firsts, end = [], n
    for layer in range(k, 0, -1):
        end = int(cut[layer, end])
        firsts.append(end)
    return [0, *reversed(firsts)]


def _segmented_days(txns: DataFrame, starting_balances: DataFrame | float, max_segments: int, min_days: int,
                    penalty: float) -> DataFrame:
    """account_id, date, t (days since the first), balance, segment (from 1),
    slope, intercept (of the day's segment, at t = 0)."""
    if max_segments < 1 or min_days < 3:
        raise ValueError("a trend needs one segment or more of three days or more")
    days = running_balance(daily_series(txns), starting_balances).select("account_id", "date", "balance")
    kind = days.schema["account_id"].dataType.simpleString()

    def number(days: pd.DataFrame) -> pd.DataFrame:
        days = days.sort_values("date", ignore_index=True)
        firsts = best_cuts(days["balance"].to_numpy(dtype=float), max_segments, min_days, penalty)
        t = np.arange(len(days))
        return days.assign(t=t.astype(float), segment=np.searchsorted(firsts, t, side="right"))

    ship_package(txns.sparkSession)
    cut = days.groupBy("account_id").applyInPandas(number, f"account_id {kind}, date date, balance double, t double, segment long")
    # one exchange for the lines and for all sums by account
    line = Window.partitionBy("account_id", "segment")
    return cut.repartition("account_id") \
        .withColumn("slope", F.coalesce(F.regr_slope("balance", "t").over(line), F.lit(0.0))) \
        .withColumn("intercept", F.coalesce(F.regr_intercept("balance", "t").over(line), F.avg("balance").over(line)))


def trend_segments(txns: DataFrame, starting_balances: DataFrame | float = 0.0, max_segments: int = MAX_SEGMENTS,
                   min_days: int = MIN_DAYS, penalty: float = PENALTY) -> DataFrame:
    """(account_id, segment, first_date, last_date, n_days, slope, intercept,
    error): the lines of each account; ``slope`` is a day's change, ``intercept``
    the line's value on the account's first day, ``error`` the squared error."""
    days = _segmented_days(txns, starting_balances, max_segments, min_days, penalty)
    off = F.col("balance") - F.col("intercept") - F.col("slope") * F.col("t")
    return days.groupBy("account_id", "segment").agg(
        F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count(F.lit(1)).alias("n_days"),
        F.first("slope").alias("slope"), F.first("intercept").alias("intercept"), F.sum(off * off).alias("error"))


def changing_trend_projection(txns: DataFrame, starting_balances: DataFrame | float = 0.0, horizon_days: int = 90,
                              max_segments: int = MAX_SEGMENTS, min_days: int = MIN_DAYS, penalty: float = PENALTY) -> DataFrame:
    """(account_id, day_no, date, projected_balance, backend): the last
    segment's line carried on, plus the weekday's mean distance from the lines
    over all segments (0 for a weekday without days)."""
    days = _segmented_days(txns, starting_balances, max_segments, min_days, penalty)
    off = F.col("balance") - F.col("intercept") - F.col("slope") * F.col("t")
    effects = [F.coalesce(F.avg(F.when(F.dayofweek("date") == d, off)), F.lit(0.0)) for d in range(1, 8)]
    fit = days.groupBy("account_id").agg(
        F.max("date").alias("d1"), F.max("t").alias("t1"), F.max_by("slope", "t").alias("slope"),
        F.max_by("intercept", "t").alias("intercept"), F.array(*effects).alias("effects"))
    ahead = F.sequence(F.lit(1), F.lit(int(horizon_days))) if horizon_days >= 1 else F.array().cast("array<int>")
    proj = fit.select("*", F.explode(ahead).alias("day_no")).withColumn("date", F.date_add("d1", F.col("day_no")))
    line = F.col("intercept") + F.col("slope") * (F.col("t1") + F.col("day_no"))
    return proj.select("account_id", "day_no", "date",
                       (line + F.element_at("effects", F.dayofweek("date"))).alias("projected_balance"),
                       F.lit(CHANGING_METHOD).alias("backend"))
