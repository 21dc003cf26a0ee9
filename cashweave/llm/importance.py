"""Target-distribution importance resampling on hashed n-grams.

Features of a text are all its runs of 1 to ``max_n`` consecutive words. The
text is lower-cased (A-Z), every run of separators collapses to one space, and
one overlapped ``regex`` scan with a look-behind at word starts emits the
spans of all n-grams; a span's CRC-32, modulo ``buckets``, is its bucket.

1. Tasks turn each document into its distinct buckets and their counts, which
   are written once; all later steps read that table.
2. Bucket counts of corpus and target are summed per task and then over tasks:
   ``buckets`` rows on each side, whatever the corpus. The gain of a bucket is
   the log ratio of its smoothed shares, in thousandths.
3. A document's weight is the floored mean gain of its features. Gumbel noise
   from a hash of its id turns the weighted draw into "the highest scores".
4. Scores are whole numbers within a fixed range, so their histogram is small:
   it gives the lowest drawn score. Documents from there up are dealt into
   ranges of (score, id), numbered per range, and ranks follow from the
   ranges' sizes; no task sees more than its range.

Null and empty text has no words, no features and weight 0. Ties in score go
to the smaller id, rows without an id last, rows of one id by a hash of their
text; repeated rows are ranked one by one. An empty corpus gives no rows; an
empty target is a target of zero counts. Other columns are not read.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cashweave.llm.common import shuffle_partitions, stored

BUCKETS = 10_000
MAX_N = 2
SHARE = 25           # per cent of the eligible documents that are drawn
MIN_WORDS = 20       # documents of fewer words are never drawn
SEED = 7

FEATURES = "doc_id long, tie long, n_words long, n_features long, bucket array<int>, times array<int>"
_ROW_BITS = 33       # monotonically_increasing_id: the partition stands above these bits

# UTF-8 bytes: A-Z to a-z; digits, letters and all bytes from 0x80 are word bytes, others separators.
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
              for c in range(256))


def scanner(max_n: int):
    """Matches at every word start; group k is the k-th word (from the second
    on with its space), so the first k groups span the k-gram."""
    return regex.compile(rb"(?<![^ ])([^ ]++)" + rb"( [^ ]++)?" * (max_n - 1) + rb"(?![^ ])")


def spans_crc(text: str | None, scan) -> tuple[int, list[int]]:
    """The number of words and the CRC-32 of every n-gram."""
    line = b" ".join((text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split())
    out, words, crc32 = [], 0, zlib.crc32
    for m in scan.finditer(line, overlapped=True):
        words += 1
        crc = 0
        for part in m.groups():
            if part is None:
                break
            crc = crc32(part, crc)
            out.append(crc)
    return words, out


def features(docs: DataFrame, max_n: int = MAX_N, buckets: int = BUCKETS) -> DataFrame:
    """Per document: its id, a hash of its text, its numbers of words and of
    features, and its distinct buckets with their counts."""

    def run(batches):
        scan = scanner(max_n)
        for b in batches:
            n_words, n_features, found, times = [], [], [], []
            for text in b.column(2):
                words, crcs = spans_crc(text.as_py(), scan)
                which, how_often = np.unique(np.array(crcs, np.uint32) % np.uint32(buckets), return_counts=True)
                n_words.append(words)
                n_features.append(len(crcs))
                found.append(which.astype(np.int32))
                times.append(how_often.astype(np.int32))
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *x]))) for x in (found, times)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(n_words, pa.int64()), pa.array(n_features, pa.int64()), *lists],
                ["doc_id", "tie", "n_words", "n_features", "bucket", "times"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"),
                       F.col("text").cast("string").alias("text")).mapInArrow(run, FEATURES)


def bucket_counts(found: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``bucket, n`` over all rows of ``features``: at most ``buckets`` rows a
    task, added up over tasks."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            total += np.bincount(b.column(0).flatten().to_numpy(), b.column(1).flatten().to_numpy(), minlength=buckets).astype(np.int64)
        which = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(which.astype(np.int32)), pa.array(total[which])], ["bucket", "n"])

    return found.select("bucket", "times").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 ln) of each bucket's share in the target over that in the
    source, both counts plus one. Two tables of at most ``buckets`` rows."""
    counts = []
    for found in (source, target):
        n = np.zeros(buckets)
        for row in bucket_counts(found, buckets).collect():
            n[row.bucket] = row.n
        counts.append(n)
    s, t = counts
    big_s, big_t = float(s.sum()) + buckets, float(t.sum()) + buckets
    return np.array([math.floor(1000 * math.log((b + 1) * big_s / ((a + 1) * big_t))) for a, b in zip(s.tolist(), t.tolist())], np.int64)


def weights(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """``features`` without its lists, with ``weight``."""

    def run(batches):
        for b in batches:
            size = b.column(2).to_numpy()
            each = gain[b.column(3).flatten().to_numpy()] * b.column(4).flatten().to_numpy()
            sums = np.concatenate(([0], np.cumsum(each)))
            ends = np.concatenate(([0], np.cumsum([len(x) for x in b.column(3)]))).astype(np.int64)
            total = sums[ends[1:]] - sums[ends[:-1]]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(5), b.column(2), pa.array(np.where(size > 0, total // np.maximum(size, 1), 0))],
                ["doc_id", "tie", "n_words", "n_features", "weight"])

    return found.select("doc_id", "tie", "n_features", "bucket", "times", "n_words") \
        .mapInArrow(run, "doc_id long, tie long, n_words long, n_features long, weight long")


def gumbel(seed: int, doc_id="doc_id"):
    """floor(-1000 ln(-ln(u))), u from the first 32 bits of a hash of seed and id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def ranked(scored: DataFrame, least: int, drawn: int) -> DataFrame:
    """Rows from score ``least`` up with ``rank`` from 1, null beyond ``drawn``."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("tie")]
    dealt = scored.filter(F.col("score") >= least) \
        .repartitionByRange(shuffle_partitions(scored.sparkSession), *order).sortWithinPartitions(*order)
    numbered = stored(dealt.withColumn("at", F.monotonically_increasing_id()), "ranges") \
        .withColumns({"part": F.shiftright("at", _ROW_BITS), "at": F.col("at").bitwiseAND((1 << _ROW_BITS) - 1)})
    sizes = numbered.groupBy("part").agg(F.count("*").alias("size"))      # one row per range
    before = sizes.select("part", F.coalesce(F.sum("size").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rank = F.col("before") + F.col("at") + 1
    return numbered.join(F.broadcast(before), "part").withColumn("rank", F.when(rank <= drawn, rank)) \
        .select(*scored.columns, "rank")


def resample(docs: DataFrame, target: DataFrame, share: int = SHARE, min_words: int = MIN_WORDS, seed: int = SEED,
             max_n: int = MAX_N, buckets: int = BUCKETS) -> DataFrame:
    """All documents with ``n_words, n_features, weight, score, rank``: of
    those with ``min_words``, ``share`` per cent are drawn, with ranks from 1."""
    found = stored(features(docs, max_n, buckets), "features")
    goal = target.select(F.lit(0).alias("doc_id"), "text")
    gain = gains(found, features(goal, max_n, buckets), buckets)
    scored = stored(weights(found, gain).withColumn("score", F.col("weight") + gumbel(seed)), "scored")
    eligible = scored.filter(F.col("n_words") >= min_words)
    by_score = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    steps = eligible.groupBy("score").agg(F.count("*").alias("n")) \
        .select("score", F.sum("n").over(by_score).alias("upto"), F.sum("n").over(Window.partitionBy()).alias("n"))
    drawn = F.floor(F.col("n") * share / 100)
    cut = steps.filter(F.col("upto") >= drawn).agg(F.max("score").alias("least"), F.max(drawn).alias("drawn")).first()
    if cut.least is None:
        return scored.withColumn("rank", F.lit(None).cast("long")).drop("tie")
    low = ~((F.col("n_words") >= min_words) & (F.col("score") >= cut.least))
    return scored.filter(low).withColumn("rank", F.lit(None).cast("long")) \
        .unionByName(ranked(eligible, cut.least, cut.drawn)).drop("tie")
