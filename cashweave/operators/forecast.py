"""Daily cash-flow series and linear runway forecast per account
(G1-G3, G17, W1, W2, X17, X18, X22, O6-O9).

Scale notes
-----------
* The only shuffle over transactions is ``groupBy(account, date)`` with
  map-side partial sums; everything after works on the daily table, whose
  size per account is bounded by the calendar, not by the transaction count,
  so one account holding a third of all rows costs no more than any other
  after the first stage.
* The mean daily net over the zero-filled series is ``total / days``, and the
  mean burn only looks at negative days, so the summary needs no date spine.
  The spine is built only when the filled series itself is the output.
* The run-out day is solved per account in closed form and checked against
  its neighbours with the same floating-point formula as the projection, so
  the summary never explodes the horizon.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cashweave.functions.amounts import money_text
from cashweave.operators.accounts import ACCOUNT, with_account

LINEAR_METHOD = "linear"
DEFAULT_HORIZON = 90


def _acct(df: DataFrame, account_col: str | None) -> tuple[DataFrame, str]:
    """Give single-ledger tables a constant account id."""
    if account_col and account_col in df.columns:
        return df, account_col
    return with_account(df.drop(ACCOUNT)), ACCOUNT


def daily_net(txns: DataFrame, account_col: str | None = "account_id",
              date_col: str = "transaction_date", amount_col: str = "amount") -> DataFrame:
    """Sparse daily net per account (G1): (account_id, date, net)."""
    df, acct = _acct(txns, account_col)
    return df.groupBy(F.col(acct).alias("account_id"), F.col(date_col).alias("date")) \
        .agg(F.sum(amount_col).alias("net"))


def daily_series(txns: DataFrame, account_col: str | None = "account_id",
                 date_col: str = "transaction_date", amount_col: str = "amount") -> DataFrame:
    """Zero-filled daily net from each account's first to last date."""
    daily = daily_net(txns, account_col, date_col, amount_col)
    spine = daily.groupBy("account_id").agg(F.min("date").alias("d0"), F.max("date").alias("d1")) \
        .select("account_id", F.explode(F.sequence("d0", "d1")).alias("date"))
    zero = F.lit(0).cast(daily.schema["net"].dataType)
    return spine.join(daily, ["account_id", "date"], "left") \
        .select("account_id", "date", F.coalesce("net", zero).alias("net"))


def running_balance(series: DataFrame, starting_balances: DataFrame | float = 0.0) -> DataFrame:
    """Running balance over a daily series (W1): start + cumulative net.

    The window is per account and ordered by date; its groups hold one row
    per calendar day, so they stay small whatever the transaction volume.
    """
    w = Window.partitionBy("account_id").orderBy("date") \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = F.sum(F.col("net").cast("double")).over(w)
    if isinstance(starting_balances, DataFrame):
        s = series.join(starting_balances.select("account_id", "starting_balance"), "account_id", "left")
        start = F.coalesce(F.col("starting_balance").cast("double"), F.lit(0.0))
        return s.select("account_id", "date", "net", (start + cum).alias("balance"))
    return series.select("account_id", "date", "net",
                         (F.lit(float(starting_balances)) + cum).alias("balance"))


def account_stats(txns: DataFrame, account_col: str | None = "account_id",
                  date_col: str = "transaction_date", amount_col: str = "amount") -> DataFrame:
    """Per-account facts behind every forecast.

    (account_id, first_date, last_date, n_days, total_net, mean_daily_net,
    mean_daily_burn).
    """
    return stats_from_daily(daily_net(txns, account_col, date_col, amount_col))


def stats_from_daily(daily: DataFrame) -> DataFrame:
    """``account_stats`` from an (account_id, date, net) daily table."""
    stats = daily.groupBy("account_id").agg(
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.sum("net").alias("total_net"),
        F.sum(F.when(F.col("net") < 0, F.col("net"))).alias("_neg_sum"),
        F.count(F.when(F.col("net") < 0, F.lit(1))).alias("_neg_days"),
    )
    n_days = F.datediff("last_date", "first_date") + 1
    return stats.select(
        "account_id", "first_date", "last_date", n_days.alias("n_days"),
        "total_net",
        (F.col("total_net").cast("double") / n_days).alias("mean_daily_net"),
        # exact decimal sum / day count: one correctly rounded division
        F.coalesce(-(F.col("_neg_sum").cast("double") / F.col("_neg_days")), F.lit(0.0))
        .alias("mean_daily_burn"),
    )


def _first_nonpositive_day(last_balance: Column, slope: Column, horizon: Column) -> Column:
    """Smallest i in [1, horizon] with last_balance + slope * i <= 0, else null.

    ``ceil(-b/s)`` is exact up to one step of rounding; checking the step
    before and after with the projection's own formula makes the answer equal
    to scanning the projected rows.
    """
    def hit(i: Column) -> Column:
        return (i >= 1) & (i <= horizon) & ((last_balance + slope * i.cast("double")) <= 0)

    guess = F.ceil(-last_balance / slope).cast("long")
    solved = F.when(hit(guess - 1), guess - 1).when(hit(guess), guess).when(hit(guess + 1), guess + 1)
    return F.when(horizon < 1, F.lit(None).cast("long")) \
        .when(hit(F.lit(1).cast("long")), F.lit(1).cast("long")) \
        .when(slope >= 0, F.lit(None).cast("long")) \
        .otherwise(solved)


def forecast_summary(txns: DataFrame, starting_balances: DataFrame | float = 0.0,
                     horizon_days: int | Column = DEFAULT_HORIZON, as_of: str | Column | None = None,
                     account_col: str | None = "account_id", stats: DataFrame | None = None) -> DataFrame:
    """One forecast row per account.

    ``starting_balances`` is a number for every account or a DataFrame
    (account_id, starting_balance); accounts listed there without any
    transaction get the empty forecast (zeros, no run-out day). ``as_of``
    fixes "today" for the runway text (default: current date).
    """
    st = stats if stats is not None else account_stats(txns, account_col)
    if isinstance(starting_balances, DataFrame):
        sb = starting_balances.select("account_id", F.col("starting_balance").cast("double"))
        st = st.join(sb, "account_id", "full")
        start = F.coalesce(F.col("starting_balance"), F.lit(0.0))
    else:
        start = F.lit(float(starting_balances))
    horizon = horizon_days if isinstance(horizon_days, Column) else F.lit(int(horizon_days))
    today = F.current_date() if as_of is None else (F.to_date(F.lit(as_of)) if isinstance(as_of, str) else as_of)

    has_data = F.col("last_date").isNotNull()
    mean_net = F.when(has_data, F.col("mean_daily_net")).otherwise(F.lit(0.0))
    burn = F.when(has_data, F.col("mean_daily_burn")).otherwise(F.lit(0.0))
    last_balance = start + F.coalesce(F.col("total_net").cast("double"), F.lit(0.0))
    step = _first_nonpositive_day(last_balance, mean_net, horizon.cast("long"))
    death = F.when(has_data & step.isNotNull(), F.date_add("last_date", step.cast("int")))

    out = st.select(
        "account_id",
        start.alias("starting_balance"),
        mean_net.alias("mean_daily_net"),
        burn.alias("mean_daily_burn"),
        F.when(has_data, last_balance).alias("last_balance"),
        "last_date",
        death.alias("death_date"),
        horizon.alias("horizon_days"),
        F.lit(LINEAR_METHOD).alias("backend"),
    )
    return out.withColumn("summary", forecast_text(
        F.col("death_date"), F.col("mean_daily_net"), F.col("mean_daily_burn"),
        F.col("horizon_days"), today))


def forecast_text(death: Column, mean_net: Column, burn: Column, horizon: Column, today: Column) -> Column:
    """Narrative of a forecast (O9); the runway days count from ``today``."""
    positive = F.concat(
        F.lit("Cash-flow positive: avg daily net "), money_text(mean_net),
        F.lit(". No runway risk in the next "), horizon.cast("string"), F.lit(" days."))
    runway = F.concat(
        F.lit("Projected runway: "), F.datediff(death, today).cast("string"),
        F.lit(" days. Balance hits $0 on "), F.date_format(death, "yyyy-MM-dd"),
        F.lit(" at avg daily burn "), money_text(burn), F.lit("."))
    return F.when(death.isNull(), positive).otherwise(runway)


def forecast_projection(summary: DataFrame) -> DataFrame:
    """Daily projected balance for each account's horizon.

    One row per account and future day; the horizon bounds the rows each
    account emits.
    """
    base = summary.where(F.col("last_date").isNotNull())
    h = F.col("horizon_days").cast("int")
    days = F.when(h >= 1, F.sequence(F.lit(1), h)).otherwise(F.array().cast("array<int>"))
    day = F.explode(days).alias("day_no")
    return base.select("account_id", "last_date", "last_balance", "mean_daily_net", day) \
        .select(
            "account_id", "day_no",
            F.date_add("last_date", F.col("day_no")).alias("date"),
            (F.col("last_balance") + F.col("mean_daily_net") * F.col("day_no").cast("double"))
            .alias("projected_balance"),
        )
