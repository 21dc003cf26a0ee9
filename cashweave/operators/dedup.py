"""Union of sources and keep-first de-duplication."""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cashweave.operators.accounts import ACCOUNT
from cashweave.schema import IngestionError


def union_sources(frames: Sequence[DataFrame]) -> DataFrame:
    """Append canonical frames by column name (U1); no frames is an error."""
    if not frames:
        raise IngestionError("There is nothing to ingest")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def dedup_key(df: DataFrame, key: str = "raw_hash", extra_key_cols: Sequence[str] = ()) -> list[str]:
    """The ledger (where the table has one), the content hash and what else
    tells transactions apart (a bank reference, say)."""
    return [*([ACCOUNT] if ACCOUNT in df.columns else []), key, *extra_key_cols]


def deduplicate(df: DataFrame, order_by: Sequence[str | Column], key: str = "raw_hash",
                extra_key_cols: Sequence[str] = ()) -> DataFrame:
    """Keep the first row per ledger and content hash (O2).

    "First" is the smallest ``order_by`` tuple (file position, then row
    position within the file), so the survivor and its ``source`` are
    deterministic, unlike ``dropDuplicates``. ``row_number() == 1`` lets
    Spark insert a partial per-partition group limit before the shuffle, so
    a hash repeated across many input rows leaves each map task at most once
    and a hot hash cannot pile up in one reducer. A frame without ``key`` is
    returned unchanged.
    """
    if key not in df.columns:
        return df
    orders = [F.col(c) if isinstance(c, str) else c for c in order_by]
    w = Window.partitionBy(*dedup_key(df, key, extra_key_cols)).orderBy(*orders)
    return df.withColumn("_dup_rank", F.row_number().over(w)) \
        .where(F.col("_dup_rank") == 1).drop("_dup_rank")


def duplicate_count(before: DataFrame, key: str = "raw_hash", extra_key_cols: Sequence[str] = ()) -> DataFrame:
    """One-row ingest metric (G16): rows before, duplicates removed, rows after,
    from one aggregate over the pre-dedup union."""
    keys = dedup_key(before, key, extra_key_cols)
    return before.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("rows_before"),
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicates_removed"),
        F.count(F.lit(1)).alias("rows_after"))
