"""Stores that grow batch by batch: notes as runs, transactions kept once."""

import random
import re

import pytest
from pyspark.sql import functions as F

from cashweave.operators.advisor import ledger_facts
from cashweave.operators.categorize import categorize
from cashweave.operators.fact_store import FactStore
from cashweave.operators.ledger_store import LedgerStore
from cashweave.operators.note_store import NoteStore, Run, complete_runs, live_runs
from cashweave.operators.notes import prepare_notes, search_notes, upsert_notes
from cashweave.plans.jobs import add_exports, add_notes, keep_facts
from cashweave.schema import IngestionError
from cashweave.sinks.writers import write_notes
from cashweave.sources.exports import read_notes


def _batch(spark, rows, dim=256, embed=None):
    df = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "id string, text string, o int")
    return prepare_notes(df, id_col="id", order_by="o", dim=dim, embed=embed)[0]


def _plain(df):
    return sorted((r.id, r.text, tuple(r.embedding.idx), tuple(r.embedding.cnt)) for r in df.collect())


def test_runs_equal_upserts_and_stay_few(spark, tmp_path):
    draw = random.Random(7)
    store, kept, expected = NoteStore(spark, str(tmp_path / "n"), fanout=2), None, {}
    for b in range(5):
        rows = [(f"n{draw.randrange(8)}", f"text {b} {draw.randrange(99)}") for _ in range(5)]
        expected.update(rows)
        store.add(_batch(spark, rows))
        kept = upsert_notes(kept, _batch(spark, rows))
        assert {r.id: r.text for r in store.rows().collect()} == expected
    assert _plain(store.read()) == _plain(kept)
    assert [(r.first, r.last) for r in store.runs()] == [(0, 3), (4, 4)]
    order = [r.id for r in store.rows().orderBy("seq").collect()]
    assert order == [r.id for r in kept.orderBy("seq").collect()]
    assert store.vacuum() == 6 and store.vacuum() == 0
    assert len(complete_runs(spark, str(tmp_path / "n"))) == 2 and _plain(store.read()) == _plain(kept)


def test_adding_writes_the_batch_only(spark, tmp_path):
    store = NoteStore(spark, str(tmp_path / "n"))
    store.add(_batch(spark, [(f"n{i}", f"word {i}") for i in range(50)]))
    run = store.add(_batch(spark, [("n3", "another"), ("n3", "the last"), ("x", "one more")]))
    assert sorted((r.id, r.text) for r in spark.read.parquet(run.path).collect()) == [("n3", "the last"), ("x", "one more")]
    assert store.rows().count() == 51


def test_half_written_runs_do_not_count(spark, tmp_path):
    path = tmp_path / "n"
    store = NoteStore(spark, str(path), fanout=2)
    store.add(_batch(spark, [("a", "one")]))
    (path / "run=0000000001-0000000001").mkdir()
    (path / "run=0000000001-0000000001" / "part-0.parquet").write_bytes(b"broken")
    (path / "run=0000000000-0000000001").mkdir()
    assert [r.id for r in store.rows().collect()] == ["a"]
    store.add(_batch(spark, [("b", "two")]))
    assert sorted(r.id for r in store.rows().collect()) == ["a", "b"] and len(store.runs()) == 1


def test_live_runs_are_the_longest_without_a_gap():
    r = [Run(0, 0, "a"), Run(0, 3, "b"), Run(1, 1, "c"), Run(4, 4, "d"), Run(6, 6, "e")]
    assert [x.path for x in live_runs(r)] == ["b", "d"] and live_runs([]) == [] and live_runs(r[2:]) == []


def test_empty_stores_and_batches(spark, tmp_path):
    store = NoteStore(spark, str(tmp_path / "n"))
    q = spark.createDataFrame([(1, "money")], "question_id long, question string")
    assert store.read().count() == 0 and search_notes(store.read(), q).count() == 0
    store.add(_batch(spark, [("a", "  ")]))
    store.add(_batch(spark, [("a", "money"), ("b", None)]))
    assert [r.id for r in search_notes(read_notes(spark, str(tmp_path / "n")), q).collect()] == ["a"]
    with pytest.raises(ValueError):
        NoteStore(spark, "x", fanout=1)


def test_vectors_are_stored_with_their_model(spark, tmp_path):
    path = str(tmp_path / "n")
    NoteStore(spark, path, dim=16).add(_batch(spark, [("a", "green lamps")], dim=16))
    NoteStore(spark, path, dim=256).add(_batch(spark, [("b", "red lamps")]))
    wide = NoteStore(spark, path, dim=256).read()
    assert _plain(wide) == _plain(upsert_notes(upsert_notes(None, _batch(spark, [("a", "green lamps")])), _batch(spark, [("b", "red lamps")])))
    dense = lambda df, text, out: df.withColumn(out, F.array(F.length(text).cast("double"), F.lit(1.0)))
    own = str(tmp_path / "own")
    store = NoteStore(spark, own, embed=dense, model="length")
    store.add(_batch(spark, [("a", "four")], embed=dense))
    # as stored, not made again
    never = NoteStore(spark, own, embed=lambda df, text, out: df.withColumn(out, F.array(F.lit(-1.0))), model="length")
    assert [r.embedding for r in never.read().collect()] == [[4.0, 1.0]]
    nameless = NoteStore(spark, own, embed=lambda df, text, out: df.withColumn(out, F.array(F.lit(-1.0))))
    assert [r.embedding for r in nameless.read().collect()] == [[-1.0]]


def test_a_store_of_versions_goes_on_as_runs(spark, tmp_path):
    path = str(tmp_path / "n")
    write_notes(upsert_notes(None, _batch(spark, [("a", "one"), ("b", "two")])), path, 1)
    more = spark.createDataFrame([("b", "new")], "id string, text string")
    assert add_notes(spark, path, more) == 2
    assert {r.id: r.text for r in read_notes(spark, path).collect()} == {"a": "one", "b": "new"}


def _csv(tmp_path, name, rows):
    p = tmp_path / name
    p.write_text("Date,Amount,Memo\n" + "".join(f"{r}\n" for r in rows))
    return str(p)


def test_the_same_export_twice_adds_nothing(spark, tmp_path):
    one = _csv(tmp_path, "one.csv", ["2031-05-01,-1,a", "2031-05-01,-1,a", "2031-05-02,-2,b"])
    two = _csv(tmp_path, "two.csv", ["2031-05-02,-2,b", "2031-05-03,-3,c", "never,-3,c"])
    store = str(tmp_path / "store")
    assert add_exports(spark, [one], store)["added"] == 2
    assert add_exports(spark, [one], store)["added"] == 0
    res = add_exports(spark, [two, one], store)
    assert res["added"] == 1 and res["rejects"].count() == 1
    assert sorted((r.description, r.source, r.batch) for r in res["transactions"].collect()) == [("a", "one", 0), ("b", "one", 0), ("c", "two", 1)]


def test_keys_with_nulls_and_another_ledger(spark, tmp_path):
    schema = "account_id string, raw_hash string, ref string, row_ord long, batch string"
    store = LedgerStore(spark, str(tmp_path / "s"), buckets=4, extra_key_cols=["ref"])
    rows = [("1", "h", None, 2, "x"), ("1", "h", None, 1, "x"), ("2", "h", None, 3, "x"), ("1", "h", "null", 4, "x"), (None, None, None, 5, "x"), (None, None, None, 6, "x")]
    store.append(spark.createDataFrame(rows, schema), ["row_ord"])
    assert sorted(r.row_ord for r in store.read().collect()) == [1, 3, 4, 5]
    store.append(spark.createDataFrame([*rows, ("1", "h", "", 7, "x")], schema), ["row_ord"])
    again = LedgerStore(spark, str(tmp_path / "s"), extra_key_cols=["ref"])
    assert again.buckets == 4 and sorted(r.row_ord for r in again.read().collect()) == [1, 3, 4, 5, 7]
    fewer = spark.createDataFrame([("9", "k", 8)], "account_id string, raw_hash string, row_ord long")
    with pytest.raises(Exception):
        again.append(fewer, ["row_ord"])            # the key column ref is missing
    with pytest.raises(IngestionError):
        again.append(spark.createDataFrame(rows, schema).withColumn("more", F.lit(1)), ["row_ord"])
    again.append(spark.createDataFrame([], schema), ["row_ord"])
    assert again.read().count() == 5


def test_the_stored_side_is_not_shuffled(spark, tmp_path):
    rows = spark.range(200).selectExpr("cast(id as string) raw_hash", "id row_ord")
    store = LedgerStore(spark, str(tmp_path / "s"), buckets=4)
    store.append(rows, ["row_ord"])
    spark.catalog.refreshTable(store._name)
    spark.sql(f"DROP TABLE {store._name}")              # as in another session
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        fresh = LedgerStore(spark, str(tmp_path / "s")).fresh(spark.range(300).selectExpr("cast(id as string) raw_hash", "id row_ord"), ["row_ord"])
        plan = fresh._jdf.queryExecution().executedPlan().toString()
        assert fresh.count() == 100
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    stored = plan[plan.index("LeftAnti"):]
    right = stored[stored.rindex("FileScan"):]
    assert "SelectedBucketsCount: 4 out of 4" in right and re.search(r"ReadSchema: struct<row_key:string>", right)
    # one exchange for keep-first, one by key; none above the table's scan
    assert plan.count("Exchange") == 2


def _facts(df):
    return sorted((r.account_id, str(r.date), r.category, r.net, r.rows) for r in df.collect())


def test_facts_follow_the_ledger_month_by_month(spark, tmp_path):
    one = _csv(tmp_path, "one.csv", ["2031-04-30,-1,uber", "2031-05-01,-2,uber", "2031-07-01,5,salary"])
    two = _csv(tmp_path, "two.csv", ["2031-05-01,-2,uber", "2031-05-31,-3,rent", "2031-05-01,-4,uber"])
    store, path = str(tmp_path / "store"), str(tmp_path / "facts")
    add_exports(spark, [one], store)
    keep_facts(spark, store, path)
    files = lambda: {p.parent.name: p.name for p in (tmp_path / "facts" / "facts").glob("month=*/*.parquet")}
    before = files()
    assert set(before) == {"month=203104", "month=203105", "month=203107"}
    add_exports(spark, [two], store)
    kept = keep_facts(spark, store, path)
    after = files()
    assert {m for m in after if after[m] != before[m]} == {"month=203105"}
    held = _facts(kept)
    assert held == _facts(ledger_facts(categorize(LedgerStore(spark, store).read())))
    assert _facts(keep_facts(spark, store, path)) == held and files() == after
    # the number of the batch is written last: without it the update is repeated
    FactStore(spark, path).update(LedgerStore(spark, store).read(), categorize, everything=True)
    assert _facts(FactStore(spark, path).read()) == held


def test_buckets_grow_with_the_first_batch(spark, tmp_path, monkeypatch):
    from cashweave.operators import ledger_store
    monkeypatch.setattr(ledger_store, "ROWS_PER_BUCKET", 30)
    store = LedgerStore(spark, str(tmp_path / "s"), buckets=4)
    store.append(spark.range(200).selectExpr("cast(id as string) raw_hash", "id row_ord"), ["row_ord"])
    store.append(spark.range(300).selectExpr("cast(id as string) raw_hash", "id row_ord"), ["row_ord"])
    again = LedgerStore(spark, str(tmp_path / "s"))
    assert again.buckets == 7 and again.read().count() == 300
