"""Report tables behind the dashboard.

All are single aggregations with map-side partial sums, per account or over
the whole table.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cashweave.functions.amounts import money_text, percent_text


def kpis(txns: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Transactions, total income, total expenses (as a magnitude), net."""
    amt = F.col("amount")
    g = txns.groupBy(*by) if by else txns.groupBy()
    out = g.agg(
        F.count(F.lit(1)).alias("transactions"),
        F.coalesce(F.sum(F.when(amt > 0, amt)), F.lit(0)).alias("total_income"),
        F.coalesce(F.sum(F.when(amt < 0, amt)), F.lit(0)).alias("_exp"),
    )
    net = F.col("total_income") + F.col("_exp")
    return out.select(*by, "transactions", "total_income", F.abs("_exp").alias("total_expenses"),
                      net.alias("net_cashflow"),
                      F.when(net >= 0, F.lit("positive")).otherwise(F.lit("negative")).alias("net_direction"))


def spend_by_category(txns: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Expense magnitude per category, largest first."""
    e = txns.where(F.col("amount") < 0)
    out = e.groupBy(*by, "category").agg(F.sum(F.abs("amount")).alias("amount"))
    return out.orderBy(*by, F.col("amount").desc(), F.col("category"))


def daily_cashflow(txns: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Net per calendar day, only days with transactions."""
    return txns.groupBy(*by, F.col("transaction_date").alias("date")) \
        .agg(F.sum("amount").alias("net")).orderBy(*by, "date")


def transaction_detail(txns: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Display table: Date, Description, Amount ($1,234.56), Category,
    Confidence (95%; missing counts as 0%) (P5)."""
    return txns.select(
        *keep,
        F.col("transaction_date").alias("Date"),
        F.col("description").alias("Description"),
        money_text(F.col("amount").cast("double")).alias("Amount"),
        F.col("category").alias("Category"),
        percent_text("ai_confidence_score").alias("Confidence"),
    )
