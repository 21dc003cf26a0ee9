from decimal import Decimal
import datetime as dt

from pyspark.sql import functions as F

from cashweave.functions.hashing import content_hash
from cashweave.operators.dedup import deduplicate, duplicate_count
from cashweave.sources.exports import read_exports


def test_hash_is_canonical(spark):
    df = spark.createDataFrame(
        [(dt.date(2026, 3, 1), Decimal("-5.75"), "Harbour Kiosk #31"),
         (dt.date(2026, 3, 1), Decimal("-5.7500"), "  harbour   KIOSK #31 "),
         (dt.date(2026, 3, 1), Decimal("-5.76"), "Harbour Kiosk #31")],
        "d date, a decimal(20,4), s string")
    h = [r.h for r in df.select(content_hash("d", "a", "s").alias("h")).collect()]
    assert h[0] == h[1] != h[2]
    import hashlib
    assert h[0] == hashlib.sha256(b"2026-03-01|-5.75|harbour kiosk #31").hexdigest()


def test_doubled_file_dedups_back(spark, samples):
    union = read_exports(spark, [samples["card"], samples["card"], samples["checking"]])
    clean = deduplicate(union, order_by=["file_ord", "row_ord"])
    rows = clean.collect()
    assert len(rows) == 12
    assert sum(r.amount for r in rows if r.source == "card_may") == Decimal("1570.21")
    # the first copy survives: entry 0
    assert all(r.file_ord.entry in (0, 2) for r in rows)
    counts = duplicate_count(union).first()
    assert (counts.rows_before, counts.duplicates_removed, counts.rows_after) == (19, 7, 12)


def test_dedup_idempotent(spark, samples):
    union = read_exports(spark, [samples["card"], samples["card"]])
    once = deduplicate(union, order_by=["file_ord", "row_ord"])
    twice = deduplicate(once, order_by=["file_ord", "row_ord"])
    assert sorted(r.raw_hash for r in once.collect()) == sorted(r.raw_hash for r in twice.collect())


def test_keep_first_across_file_splits(spark, tmp_path):
    """A file read by several tasks still keeps its earliest copy."""
    n = 4000
    lines = ["Date,Description,Amount,Ref"]
    for i in range(2 * n):
        j = i % n                      # rows j and j + n carry the same content
        lines.append(f"03/{1 + j % 28:02d}/2026,MERCHANT {j} LONG DESCRIPTION TEXT,-{j}.25,{i}")
    p = tmp_path / "big.csv"
    p.write_text("\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        union = read_exports(spark, [str(p)], keep=("Ref",), multiline_csv=False)
        assert union.rdd.getNumPartitions() > 4
        kept = deduplicate(union, order_by=["file_ord", "row_ord"]).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(kept) == n
    assert all(int(r.Ref) < n for r in kept)


def test_directory_entry_and_skip(spark, tmp_path, samples):
    import shutil
    d = tmp_path / "cards"
    d.mkdir()
    shutil.copy(samples["card"], d / "a.csv")
    shutil.copy(samples["card"], d / "b.csv")
    rows = read_exports(spark, [str(d), str(tmp_path / "missing.csv")], on_error="skip").collect()
    assert len(rows) == 14
    assert {r.source for r in rows} == {"a", "b"}


def test_equal_rows_of_two_ledgers_both_stay(spark):
    rows = [(1, 0, "h1", "a"), (2, 1, "h1", "a"), (2, 2, "h1", "b"), (1, 3, "h2", "a")]
    df = spark.createDataFrame(rows, "account_id long, row_ord int, raw_hash string, ref string")
    assert sorted(r.row_ord for r in deduplicate(df, ["row_ord"]).collect()) == [0, 1, 3]
    assert deduplicate(df, ["row_ord"], extra_key_cols=["ref"]).count() == 4
    assert tuple(duplicate_count(df).first()) == (4, 1, 3)
