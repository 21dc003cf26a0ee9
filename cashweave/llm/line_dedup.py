"""Line deduplication over levelled sorted runs of line hashes.

A run is a Parquet table, sorted by hash within hash partitions, of the lines
one batch of documents holds: hash, number of documents, largest document.
Batches add their runs at level 0; as soon as a level has ``FANOUT`` runs they
are merged into one of the next level, so a line is rewritten once per level
and look-ups meet few runs. Lines are then dropped by a merge anti-join of
the documents' lines with the runs. Hashes are 128 bits wide.

Nulls and ties: a null text is one empty line; rows that share a ``doc_id``
hold a line once; rows without a ``doc_id`` count as one document below all
others; equal rows get equal results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cashweave.llm.common import ascii_lower, doc_key, doc_no, packed, scratch_dir, stored

BLANKS = " \t\n\x0b\x0c\r"
MIN_CHARS = 20
MIN_DOCS = 3
BATCHES = 4
FANOUT = 2

DOC = ["doc_no", "doc_key"]


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def keyed_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``doc_id, doc_no, doc_key, pos, h1, h2`` of the lines long enough to count."""
    lines = docs.select("doc_id", doc_no().alias("doc_no"), doc_key().alias("doc_key"),
                        F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    keys = lines.select("doc_id", *DOC, "pos", line_key(F.col("line")).alias("key")).filter(F.length("key") >= min_chars)
    return keys.select("doc_id", *DOC, "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


class LineRuns:
    """The levelled runs, below a folder that all executors share."""

    def __init__(self, spark, folder: str | None = None, fanout: int = FANOUT):
        self.spark = spark
        self.folder = folder or scratch_dir(spark, "line-runs")
        self.fanout = fanout
        self.levels: list[list[str]] = [[]]
        self.written = 0

    def _write(self, run: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.written += 1
        path = f"{self.folder}/level{level}-run{self.written}"
        run.sortWithinPartitions("h1", "h2").write.parquet(path)
        self.levels[level].append(path)

    def _merged(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema("h1 long, h2 long, n_docs long, keeper long").parquet(*paths) \
            .groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.max("keeper").alias("keeper"))

    def add(self, lines: DataFrame) -> None:
        """Add a batch of keyed lines. Batches must not share documents."""
        held = lines.select("h1", "h2", "doc_id").distinct()
        self._write(held.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("keeper")), 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            self._write(self._merged(self.levels[level]), level + 1)
            self.levels[level] = []
            level += 1

    def frequent(self, min_docs: int) -> DataFrame:
        """``h1, h2, n_docs, keeper`` of lines in at least ``min_docs`` documents."""
        paths = [p for level in self.levels for p in level]
        return stored(self._merged(paths).filter(F.col("n_docs") >= min_docs), "frequent-lines")


def batches_of(docs: DataFrame, batches: int) -> list[DataFrame]:
    """Disjoint ranges of ``doc_id`` that cover all rows, largest ids first;
    rows without an id are in the last."""
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    if low is None:
        return [docs]
    width = max(1, -(-(high - low + 1) // batches))
    out = [docs.filter((F.col("doc_id") >= start) & (F.col("doc_id") < start + width))
           for start in range(low, high + 1, width)][::-1]
    out[-1] = docs.filter((F.col("doc_id") < low + width) | F.col("doc_id").isNull())
    return out


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES,
                runs: LineRuns | None = None) -> DataFrame:
    """``doc`` (the whole row), ``text`` (the lines that stay), ``n_lines``
    (before) and ``n_dropped`` of every row."""
    runs = runs or LineRuns(docs.sparkSession)
    ids = docs.select("doc_id", "text")
    for batch in batches_of(ids, batches):
        runs.add(keyed_lines(batch, min_chars))
    drop = runs.frequent(min_docs).select(F.col("h1").alias("d1"), F.col("h2").alias("d2"), F.col("keeper"))
    lines = keyed_lines(ids, min_chars)
    stay = lines.join(drop, (F.col("h1") == F.col("d1")) & (F.col("h2") == F.col("d2"))
                      & ~F.col("doc_id").eqNullSafe(F.col("keeper")), "left_anti")
    kept = stay.groupBy(*DOC).agg(F.collect_set("pos").alias("stay"))
    numbered = packed(docs).join(kept, DOC, "left").withColumn("lines", lines_of(F.col("text"))) \
        .withColumn("every", F.sequence(F.lit(0), F.size("lines") - 1)) \
        .withColumn("long", F.filter("every", lambda i: F.length(line_key(F.get("lines", i))) >= min_chars))
    gone = F.array_except("long", F.coalesce("stay", F.array().cast("array<int>")))
    left = numbered.withColumn("left", F.array_except("every", gone))
    return left.select("doc", F.array_join(F.transform("left", lambda i: F.get("lines", i)), "\n").alias("text"),
                       F.size("lines").cast("long").alias("n_lines"),
                       (F.size("lines") - F.size("left")).cast("long").alias("n_dropped"))
