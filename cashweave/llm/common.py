"""Shared helpers: the cluster's shared folder, stored intermediate tables, file access."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cashweave.session import list_files, scratch_dir, shared_fs, stored  # noqa: F401

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@contextmanager
def arrow_records(spark: SparkSession, rows: int):
    """Tasks that start in here hand Python at most ``rows`` rows at a time;
    for wide rows, of which the default of 10,000 would be tens of megabytes,
    held several times over on both sides."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_side(df: DataFrame, max_rows: int) -> DataFrame:
    """Mark a stored table for broadcast if its counted rows are within
    ``max_rows``; beyond that the join shuffles and AQE splits hot keys."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def ascii_lower(text):
    """Lower-case A-Z only; every other character stays."""
    ascii_only = F.length(text) == F.octet_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def packed(docs: DataFrame) -> DataFrame:
    """``doc`` (the whole row), ``doc_id, text, doc_no, doc_key``: further
    columns, whatever their names, can't clash with those of an operator."""
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("doc"), docs["doc_id"], docs["text"]) \
        .withColumns({"doc_no": doc_no(), "doc_key": doc_key()})


def doc_key(doc_id="doc_id", text="text"):
    """With the id, tells rows apart that share an id or have none; equal rows
    share it, so results for them are equal."""
    return F.xxhash64(F.lit("doc"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.col(text))


def doc_no(doc_id="doc_id"):
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(0))
