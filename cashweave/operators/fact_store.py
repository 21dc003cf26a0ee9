"""Daily facts kept up to date beside a growing ledger.

The facts of ``ledger_facts`` are written by month. After new batches were
added to the ledger, the months of their rows, and no others, are built anew
from the ledger and replace their partitions. A rebuilt month does not depend
on what was there, so an update that was broken off is simply repeated: the
number of the last batch that the facts hold is written after them.

Defined cases: no facts yet builds all months; no new batches changes nothing;
an empty ledger gives empty facts. Ledgers only grow: rows that are taken out
again need ``update(..., everything=True)``, which still leaves months that no
row is left in. One writer at a time.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cashweave.operators.advisor import ledger_facts

MONTH = "month"


def _month(date) -> Column:
    return F.year(date) * 100 + F.month(date)


class FactStore:
    """Facts in ``path``, of a ledger with ``batch`` numbers (``LedgerStore``)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _there(self, path: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def built(self) -> int:
        """The last batch that the facts hold; -1 without facts."""
        marker = f"{self.path}/built"
        return self.spark.read.parquet(marker).first()[0] if self._there(marker) else -1

    def update(self, ledger: DataFrame, prepare: Callable[[DataFrame], DataFrame] = lambda rows: rows,
               everything: bool = False) -> int:
        """Bring the facts up to the ledger's last batch, and return it.
        ``prepare`` is applied to the rows of the months that are rebuilt
        (``categorize``, say)."""
        built = -1 if everything else self.built()
        new = ledger.where(F.col("batch") > built)
        first, last, newest = new.agg(F.min("transaction_date"), F.max("transaction_date"), F.max("batch")).first()
        if newest is None and built >= 0:
            return built
        rows = ledger
        if built >= 0:
            months = new.select(_month("transaction_date").alias(MONTH)).distinct()
            # the bounds reach the scan, the join leaves the months between out
            near = ledger.where(F.col("transaction_date").between(F.trunc(F.lit(first), "month"), F.last_day(F.lit(last))))
            rows = near.withColumn(MONTH, _month("transaction_date")).join(months, MONTH, "left_semi").drop(MONTH)
        facts = ledger_facts(prepare(rows)).withColumn(MONTH, _month("date"))
        # whole months in a file where they are small, large ones in several
        facts.hint("rebalance", MONTH).write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
            .partitionBy(MONTH).parquet(f"{self.path}/facts")
        newest = -1 if newest is None else newest
        self.spark.range(1).select(F.lit(newest).cast("long").alias("batch")).write.mode("overwrite").parquet(f"{self.path}/built")
        return newest

    def read(self, schema=None) -> DataFrame:
        """The facts: account_id, date, category, net, spend, rows, expense_rows.
        ``schema`` is needed only for facts of an empty ledger."""
        reader = self.spark.read.schema(schema) if schema else self.spark.read
        return reader.parquet(f"{self.path}/facts").drop(MONTH)
