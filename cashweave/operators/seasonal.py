"""Trend + weekly-seasonal balance projection.

Re-aimed from an optional single-machine forecasting library: the same
purpose (trend plus day-of-week effect fitted to the running balance, h days
ahead) expressed as aggregates, with no numeric parity to that library
claimed. Per account:

* balance_t = start + cumulative daily net over the zero-filled series,
  t = days since the first date;
* trend by least squares (``regr_slope`` / ``regr_intercept``);
* weekday effect = mean residual per day of week;
* projection_t = intercept + slope * t + effect(weekday), t past the last day.

Everything runs on the daily table (one row per account-day), so a busy
account costs no more than a quiet one after the first aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cashweave.operators.forecast import daily_series, running_balance

SEASONAL_METHOD = "weekly_seasonal"


def seasonal_projection(txns: DataFrame, starting_balances: DataFrame | float = 0.0,
                        horizon_days: int = 90) -> DataFrame:
    """(account_id, day_no, date, projected_balance, backend)."""
    # the running balance leaves an account's days together, so neither the
    # window nor the sums below move data again
    first = F.min("date").over(Window.partitionBy("account_id"))
    s = running_balance(daily_series(txns), starting_balances).withColumn("d0", first) \
        .withColumn("t", F.datediff("date", "d0").cast("double")).withColumn("dow", F.dayofweek("date"))
    sums = [f(F.when(F.col("dow") == d, v)).alias(f"{n}{d}") for d in range(1, 8)
            for n, v, f in (("n", F.lit(1), F.count), ("t", F.col("t"), F.sum), ("y", F.col("balance"), F.sum))]
    total = s.groupBy("account_id").agg(
        F.min("date").alias("d0"), F.max("date").alias("d1"), F.regr_slope("balance", "t").alias("slope"),
        F.regr_intercept("balance", "t").alias("intercept"), *sums)
    fit = total.withColumn("slope", F.coalesce("slope", F.lit(0.0))).withColumn("intercept", F.coalesce("intercept", F.lit(0.0)))
    effects = F.array(*[F.when(F.col(f"n{d}") > 0, (F.col(f"y{d}") - F.col("slope") * F.col(f"t{d}")) / F.col(f"n{d}")
                               - F.col("intercept")).otherwise(F.lit(0.0)) for d in range(1, 8)])
    fit = fit.select("account_id", "d0", "d1", "slope", "intercept", effects.alias("effects"))
    days = F.explode(F.sequence(F.lit(1), F.lit(int(horizon_days)))).alias("day_no") if horizon_days >= 1 \
        else F.explode(F.array().cast("array<int>")).alias("day_no")
    proj = fit.select("*", days).withColumn("date", F.date_add("d1", F.col("day_no"))) \
        .withColumn("t", F.datediff("date", "d0").cast("double"))
    return proj.select(
        "account_id", "day_no", "date",
        (F.col("intercept") + F.col("slope") * F.col("t") + F.element_at("effects", F.dayofweek("date")))
        .alias("projected_balance"),
        F.lit(SEASONAL_METHOD).alias("backend"),
    )
