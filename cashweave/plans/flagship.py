"""The flagship job: ledger -> canonical -> dedup -> categorize -> forecast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cashweave.operators.categorize import categorize
from cashweave.operators.dedup import deduplicate
from cashweave.operators.forecast import forecast_summary
from cashweave.operators.normalize import normalize
from cashweave.sources.ledgers import customer_balances, orders_ledger

FLAGSHIP_AS_OF = "2001-08-01"


def flagship(spark: SparkSession, sf_dir: str, horizon_days: int = 90) -> DataFrame:
    canonical = normalize(orders_ledger(spark, sf_dir), source="orders", keep=("account_id", "row_ord"))
    txns = categorize(deduplicate(canonical, order_by=["row_ord"]))
    fc = forecast_summary(txns, customer_balances(spark, sf_dir), horizon_days=horizon_days,
                          as_of=FLAGSHIP_AS_OF)
    return fc.select("account_id", "starting_balance", F.round("mean_daily_net", 6).alias("mean_daily_net"),
                     F.round("mean_daily_burn", 6).alias("mean_daily_burn"), "last_date", "death_date",
                     "horizon_days", "backend", "summary")
