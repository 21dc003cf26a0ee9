"""Streaming ingest (survey extension E1; the batch operators are the spec).

New export files dropped into a folder are normalised, de-duplicated per
ledger by content hash, categorized, and rolled up to a daily net per ledger:

    readStream.csv (all-string, fixed layout)
      -> normalize -> withWatermark(arrived)
      -> dropDuplicatesWithinWatermark(account_id, raw_hash) -> categorize
      -> groupBy(account_id, transaction_date).sum(amount)

The watermark is on the time a file arrived, not on the dates in it: an older
month that is uploaded after a newer one is not late. Copies that arrive
further apart than the watermark are both kept; state is bounded by it. The
checkpoint lives under the session's shared ``spark.checkpoint.dir``.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cashweave.operators.categorize import categorize
from cashweave.operators.normalize import normalize
from cashweave.session import shared_checkpoint_dir


def stream_exports(spark: SparkSession, folder: str, header: Sequence[str], account: str | None = None,
                   watermark: str = "30 days", max_files_per_trigger: int | None = None) -> DataFrame:
    """Categorized canonical rows from CSV files arriving in ``folder``.

    ``header`` is the layout of the files (bank column names). ``account``
    names a column holding the ledger id; by default each file name (without
    extension) is its own ledger.
    """
    schema = T.StructType([T.StructField(h, T.StringType(), True) for h in header])
    reader = spark.readStream.schema(schema).option("header", True).option("multiLine", True).option("escape", '"')
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    raw = reader.csv(folder).select("*", F.col("_metadata.file_name").alias("_file"),
                                    F.col("_metadata.file_modification_time").alias("arrived"))
    src = F.regexp_replace(F.col("_file"), r"\.[^.]*$", "")
    acct = F.col(f"`{account}`").cast("string") if account else src
    rows = normalize(raw.withColumn("_src", src).withColumn("account_id", acct), source=F.col("_src"), keep=("account_id", "arrived"))
    return categorize(rows.withWatermark("arrived", watermark).dropDuplicatesWithinWatermark(["account_id", "raw_hash"]))


def daily_net_stream(rows: DataFrame) -> DataFrame:
    """Daily net per ledger, brought up to date as rows arrive (output mode
    ``update``); its state has one row per ledger and day."""
    return rows.groupBy("account_id", F.col("transaction_date").alias("date")) \
        .agg(F.sum("amount").alias("net"), F.count(F.lit(1)).alias("transactions"))


def start(rows: DataFrame, name: str, sink: str = "memory", output_mode: str = "append",
          path: str | None = None, trigger_available_now: bool = True):
    """Start a query with its checkpoint under the shared checkpoint folder."""
    spark = rows.sparkSession
    ckpt = f"{shared_checkpoint_dir(spark).rstrip('/')}/streams/{name}"
    w = rows.writeStream.queryName(name).outputMode(output_mode).option("checkpointLocation", ckpt)
    if trigger_available_now:
        w = w.trigger(availableNow=True)
    if sink == "memory":
        return w.format("memory").start()
    return w.format(sink).option("path", path).start()
