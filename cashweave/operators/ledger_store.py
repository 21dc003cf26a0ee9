"""Transactions kept once over many ingests (O2, O3, W3, S5): keep-first
against what is already stored.

The stored table is bucketed on disk by a digest of the de-duplication key
(ledger, content hash, further key columns; nulls equal). A new batch is
de-duplicated by itself, dealt by the same key into as many partitions as
there are buckets, anti-joined with the one key column of the table, which is
not shuffled, and appended bucket by bucket. So an ingest costs its own rows
and one column of the table, and loading the same exports twice adds nothing.

The appended rows are the record of what is known: there is no second table
that could disagree. An append that was broken off is repeated; rows of it
that did arrive are known then and not added twice. One writer at a time.

Defined cases: a missing folder is an empty table; an empty batch adds
nothing (and makes the table, if there is none); columns that a later batch
lacks are null, columns that the table lacks are an ``IngestionError``; a column
named ``row_key`` or ``batch`` in the rows is replaced.
"""

from __future__ import annotations

import hashlib
from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cashweave.operators.dedup import dedup_key, deduplicate
from cashweave.schema import IngestionError

KEY, BATCH = "row_key", "batch"
BUCKETS = 64
ROWS_PER_BUCKET = 250_000


def key_digest(rows: DataFrame, key: str = "raw_hash", extra_key_cols: Sequence[str] = ()) -> Column:
    """One text for the key columns, nulls told apart from texts."""
    parts = F.struct(*[F.col(c).cast("string").alias(f"k{i}") for i, c in enumerate(dedup_key(rows, key, extra_key_cols))])
    return F.sha2(F.to_json(parts, {"ignoreNullFields": "false"}), 256)


class LedgerStore:
    """A table of transactions in ``path``. The number of buckets is fixed when
    the table is made: ``buckets``, or one for ``ROWS_PER_BUCKET`` rows of the
    first batch if that is more, so that the task of a bucket does not grow
    with the ledger. Later the folder's name tells."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, extra_key_cols: Sequence[str] = ()):
        self.spark, self.path, self.extra = spark, path.rstrip("/"), tuple(extra_key_cols)
        found = self._folder()
        self.buckets = int(found.rpartition("=")[2]) if found else buckets
        self.folder = found or f"{self.path}/buckets={buckets}"

    def _folder(self) -> str | None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(p):
            return None
        return next((s.getPath().toString() for s in fs.listStatus(p) if s.getPath().getName().startswith("buckets=")
                     and fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))), None)

    @property
    def _name(self) -> str:
        return "cashweave_ledger_" + hashlib.sha256(self.path.encode()).hexdigest()[:24]

    def read(self) -> DataFrame | None:
        """The stored transactions with ``batch`` (from 0), or None."""
        if self._folder() is None:
            return None
        if self.spark.catalog.tableExists(self._name):
            self.spark.catalog.refreshTable(self._name)
        else:
            columns = self.spark.read.parquet(self.folder).schema.toDDL()
            self.spark.sql(f"CREATE TABLE {self._name} ({columns}) USING parquet CLUSTERED BY ({KEY}) "
                           f"INTO {self.buckets} BUCKETS LOCATION '{self.folder}'")
        return self.spark.table(self._name)

    def fresh(self, rows: DataFrame, order_by: Sequence[str | Column]) -> DataFrame:
        """The rows that are not stored yet, the first of each key by
        ``order_by``, with ``row_key`` and dealt into the table's buckets."""
        first = deduplicate(rows, order_by, extra_key_cols=self.extra)
        keyed = first.withColumn(KEY, key_digest(first, extra_key_cols=self.extra)).repartition(self.buckets, KEY)
        stored = self.read()
        return keyed if stored is None else keyed.join(stored.select(KEY), KEY, "left_anti")

    def append(self, rows: DataFrame, order_by: Sequence[str | Column]) -> int:
        """Add what is new in ``rows`` as the next batch; returns its number."""
        stored = self.read()
        rows = rows.drop(KEY, BATCH)
        if stored is None:
            self.buckets = max(self.buckets, -(-rows.count() // ROWS_PER_BUCKET))
            self.folder = f"{self.path}/buckets={self.buckets}"
            out = self.fresh(rows, order_by).withColumn(BATCH, F.lit(0).cast("long"))
            # a broken first write left no _SUCCESS, so nothing of it counts
            self.spark.sql(f"DROP TABLE IF EXISTS {self._name}")
            out.write.format("parquet").mode("overwrite").bucketBy(self.buckets, KEY).option("path", self.folder).saveAsTable(self._name)
            return 0
        unknown = set(rows.columns) - set(stored.columns)
        if unknown:
            raise IngestionError(f"{self.path} has no columns {sorted(unknown)}")
        newest = stored.agg(F.max(BATCH)).first()[0]
        number = 0 if newest is None else newest + 1
        out = self.fresh(rows, order_by).withColumn(BATCH, F.lit(number).cast("long"))
        typed = [(F.col(f.name) if f.name in out.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in stored.schema.fields]
        out.select(*typed).write.insertInto(self._name)
        return number
