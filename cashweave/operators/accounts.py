"""The ledger a row belongs to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ACCOUNT = "account_id"


def with_account(df: DataFrame) -> DataFrame:
    """Add account 0 to a table without ``account_id``: such a table is one ledger."""
    return df if ACCOUNT in df.columns else df.withColumn(ACCOUNT, F.lit(0).cast("long"))
