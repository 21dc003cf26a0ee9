"""Token counts by scanning flat, unindexed token files for separators.

The files are cut into blocks of a fixed number of ids, wherever these fall.
Each block is searched for the end-of-document id by one vectorised comparison
and reports where separators are and how many ids follow the last one. A
prefix scan over the blocks of a file, and one over the files, then gives every
block the number of documents before it and the ids its first document already
has, and so every document its count. Ids behind the last separator of a file
are a document of their own. Empty files have no document; two separators in a
row enclose an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cashweave.llm.common import shared_fs, stored

BLOCK_IDS = 1 << 20


def block_list(files: DataFrame, block_ids: int = BLOCK_IDS) -> DataFrame:
    """``part, file, block, first, n`` for files given as ``part, file, n_ids``."""
    return files.filter("n_ids > 0").select(
        "part", "file", "n_ids", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_ids") - 1, F.lit(block_ids).cast("long"))).alias("first")) \
        .select("part", "file", (F.col("first") / block_ids).cast("long").alias("block"), "first",
                F.least(F.lit(block_ids).cast("long"), F.col("n_ids") - F.col("first")).alias("n"))


def scan(blocks: DataFrame, end_id: int, dtype: np.dtype) -> DataFrame:
    """``part, block, first, n, ends, tail``: separators of each block, by place."""
    width = np.dtype(dtype).itemsize

    def run(batches):
        for b in batches:
            for part, file, block, first, n in zip(*(c.to_pylist() for c in b.columns)):
                with shared_fs(file)[0].open_input_file(file) as f:
                    ids = np.frombuffer(f.read_at(n * width, first * width), dtype)
                ends = np.flatnonzero(ids == end_id)
                tail = len(ids) - 1 - int(ends[-1]) if len(ends) else len(ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.int32()), pa.array([block], pa.int64()), pa.array([first], pa.int64()),
                     pa.array([n], pa.int64()), pa.array([ends], pa.list_(pa.int64())), pa.array([tail], pa.int64())],
                    ["part", "block", "first", "n", "ends", "tail"])

    spread = blocks.repartition(max(1, min(blocks.count(), 10_000)), "part", "block")
    return stored(spread.select("part", "file", "block", "first", "n")
                  .mapInArrow(run, "part int, block long, first long, n long, ends array<long>, tail long"), "scanned")


def counts(files: DataFrame, end_id: int, dtype: np.dtype, block_ids: int = BLOCK_IDS) -> DataFrame:
    """``part, number, ordinal, start, n_tokens`` of every document: its number
    in its file and over all files, the ids before it without separators, and
    its own."""
    found = scan(block_list(files, block_ids), end_id, dtype)
    order = Window.partitionBy("part").orderBy("block")
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    ends = F.size("ends")
    stitched = found.withColumn("docs_before", F.coalesce(F.sum(ends).over(past), F.lit(0))) \
        .withColumn("tails", F.coalesce(F.sum("tail").over(past), F.lit(0))) \
        .withColumn("last_tails", F.last(F.when(ends > 0, F.col("tails")), ignorenulls=True).over(past)) \
        .withColumn("carry", F.col("tails") - F.coalesce("last_tails", F.lit(0))) \
        .withColumn("is_last", F.row_number().over(Window.partitionBy("part").orderBy(F.desc("block"))) == 1)
    open_end = F.when(F.col("is_last") & (F.col("tail") > 0), F.array(F.col("n"))).otherwise(F.array().cast("array<long>"))
    closed = stitched.withColumn("stops", F.concat("ends", open_end))
    per_file = closed.groupBy("part").agg(F.sum(F.size("stops")).alias("docs"), F.sum(F.col("n") - ends).alias("ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)      # one row a file
    bases = per_file.select("part", F.coalesce(F.sum("docs").over(before), F.lit(0)).alias("file_docs"),
                            F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("file_ids"))
    docs = closed.join(bases, "part").select(
        "part", "file_docs", "file_ids", "docs_before", "carry", "first", "stops", F.posexplode("stops").alias("i", "stop"))
    previous = F.get("stops", F.col("i") - 1)
    ordinal = F.col("docs_before") + F.col("i")
    length = F.when(F.col("i") == 0, F.col("carry") + F.col("stop")).otherwise(F.col("stop") - previous - 1)
    end = F.col("file_ids") + F.col("first") + F.col("stop") - ordinal              # ids up to the stop, less separators
    return docs.select("part", ordinal.alias("number"), (F.col("file_docs") + ordinal).alias("ordinal"), (end - length).alias("start"), length.alias("n_tokens"))


def named(counted: DataFrame, files: DataFrame) -> DataFrame:
    """Add the ``doc_id`` that the files' writer has noted for each document."""
    ids = files.select("part", F.posexplode("doc_ids").alias("number", "doc_id"))
    return counted.join(ids, ["part", "number"])
