"""Sinks (K1-K5). Parquet by default; CSV with a header when asked."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cashweave.operators.dedup import duplicate_count

PROVENANCE = ("file_ord", "row_ord")


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: Sequence[str] = ()) -> None:
    """Write a table (K1, K2). CSV cannot hold structs, so provenance
    columns are dropped for CSV output."""
    out = df
    if fmt == "csv":
        out = out.drop(*[c for c in PROVENANCE if c in out.columns and not isinstance(out.schema[c].dataType, T.LongType)])
    w = out.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).option("escape", '"').csv(path)
    elif fmt == "json":
        w.json(path)
    else:
        w.parquet(path)


def write_notes(store: DataFrame, base_path: str, version: int, fmt: str = "parquet") -> str:
    """Persist a note store once per batch to a fresh version folder (K3);
    readers pick the newest complete version."""
    path = f"{base_path.rstrip('/')}/v={version:08d}"
    write_table(store.select("id", "text", "metadata", "seq"), path, fmt=fmt)
    return path


def write_answers_json(records: DataFrame, path: str) -> None:
    """Answer records as JSON lines (K4)."""
    records.select("json").write.mode("overwrite").text(path)


def ingest_report(union_before_dedup: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows per source, dedup totals) of rows before de-duplication."""
    per_source = union_before_dedup.groupBy("source").agg(F.count(F.lit(1)).alias("rows"))
    return per_source, duplicate_count(union_before_dedup)


def observed(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """Count the rows of ``df`` while it is written, without a pass of its own."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen
