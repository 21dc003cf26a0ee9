from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from cashweave.functions.amounts import coerce_amount
from cashweave.operators.normalize import normalize
from cashweave.schema import CANONICAL_COLUMNS, IngestionError
from cashweave.sources.exports import read_exports


def test_amount_coercion(spark):
    rows = [("$1,234.56",), ("(42.18)",), ("",), ("nan",), ("-7.5",), ("$(5.00)",), ("($5.00)",), ("Infinity",),
            ("1_000",), (None,), ("  € 3 ",)]
    df = spark.createDataFrame(rows, "s string").select(coerce_amount("s").alias("a"))
    got = [r.a for r in df.collect()]
    assert got[0] == Decimal("1234.56")
    assert got[1] == Decimal("-42.18")
    assert got[2] is None and got[3] is None
    assert got[4] == Decimal("-7.5")
    assert got[5] is None              # parentheses checked before symbols are stripped
    assert got[6] == Decimal("-5.00")
    assert got[7] is None and got[8] is None and got[9] is None
    assert got[10] == Decimal("3")


def test_card_export(spark, samples):
    df = read_exports(spark, [samples["card"]])
    assert df.columns[:7] == list(CANONICAL_COLUMNS)
    rows = df.collect()
    assert len(rows) == 7
    assert sum(r.amount for r in rows) == Decimal("1570.21")
    assert len({r.raw_hash for r in rows}) == 7
    assert {r.source for r in rows} == {"card_may"}
    assert all(r.category is None and r.ai_confidence_score is None for r in rows)


def test_checking_export_debit_credit(spark, samples):
    rows = read_exports(spark, [samples["checking"]]).collect()
    assert len(rows) == 5
    credits = [r for r in rows if r.amount > 0]
    assert len(credits) == 1 and credits[0].amount == Decimal("3100.00")
    assert len([r for r in rows if r.amount < 0]) == 4


def test_json_export(spark, samples):
    rows = read_exports(spark, [samples["app"]]).collect()
    assert len(rows) == 3
    assert sum(r.amount for r in rows) == Decimal("3064.75")


def test_missing_columns_raise(spark):
    df = spark.createDataFrame([(1, 2)], "foo int, bar int")
    with pytest.raises(IngestionError):
        normalize(df)


def test_empty_frame_gives_empty_canonical(spark):
    df = spark.createDataFrame([], "foo string")
    out = normalize(df)
    assert out.count() == 0
    assert out.columns == list(CANONICAL_COLUMNS)


def test_unsupported_and_missing_files(spark, tmp_path):
    with pytest.raises(IngestionError):
        read_exports(spark, [str(tmp_path / "nope.csv")])
    bad = tmp_path / "x.txt"
    bad.write_text("a,b\n1,2\n")
    with pytest.raises(IngestionError):
        read_exports(spark, [str(bad)])
    with pytest.raises(IngestionError):
        read_exports(spark, [])


def test_header_aliases_first_wins(spark):
    df = spark.createDataFrame([("2026-03-01", "-1.00", "A", "B")],
                               ["  DATE ", "Amt", "Memo", "Description"])
    out = normalize(df).collect()
    assert out[0].description == "A"


DATES = ["2026-03-01T10:00:00Z", "2026-03-01T10:00:00.000Z", "2026-03-01T10:00:00+00:00", "2026-03-01 10:00:00.123", "20260301",
         "01-Mar-2026", "Mar 1 2026", "03/01/2026 10:15 AM", "03/01/2026 10:15:00 PM", "Sun, 1 March 2026", "3/1/26", "2026/3/1",
         "1st March 2026", "March 1, 2026"]


def test_dates_of_bank_exports(spark):
    import datetime as dt

    from cashweave.functions.dates import coerce_date
    bad = ["soon", "2026-13-45", "2026-02-30", "", "99999999", None, "12", "1/2"]
    df = spark.createDataFrame([(d,) for d in [*DATES, "13/01/2026", *bad]], "s string")
    got = [r.d for r in df.select(coerce_date("s").alias("d")).collect()]
    assert got[:len(DATES)] == [dt.date(2026, 3, 1)] * len(DATES)
    assert got[len(DATES)] == dt.date(2026, 1, 13) and got[len(DATES) + 1:] == [None] * len(bad)
    day_first = df.limit(0).union(spark.createDataFrame([("02/01/2026",)], "s string"))
    assert day_first.select(coerce_date("s", ["dd/MM/yyyy"]).alias("d")).first().d == dt.date(2026, 1, 2)
    frame = spark.createDataFrame([(d, "-1", "x") for d in DATES], "Date string, Amount string, Memo string")
    assert {r.transaction_date for r in normalize(frame).collect()} == {dt.date(2026, 3, 1)}


def test_a_memo_of_two_lines_stays_one_row(spark, tmp_path):
    p = tmp_path / "memo.csv"
    p.write_text('Date,Memo,Amount\n2026-03-01,"two\nlines, ""quoted""",-5\n2026-03-02,plain,-6\n')
    rows = read_exports(spark, [str(p)]).orderBy("row_ord").collect()
    assert [(r.description, r.amount) for r in rows] == [('two\nlines, "quoted"', Decimal(-5)), ("plain", Decimal(-6))]


def test_of_equal_headers_the_first_counts(spark, tmp_path):
    p = tmp_path / "twice.csv"
    p.write_text("Date,Amount,Memo,amount,Amount\n2026-03-01,-5,a,-6,-7\n")
    assert [r.amount for r in read_exports(spark, [str(p)]).collect()] == [Decimal(-5)]


def test_json_in_all_its_forms(spark, tmp_path):
    row = '{"date": "2026-03-0%d", "amount": %s, "memo": "m"}'
    (tmp_path / "a.json").write_text('{"transactions": [' + row % (1, "-1.5") + "]}")
    (tmp_path / "b.json").write_text("[" + row % (2, "-2") + ", " + row % (3, '"$3.00"') + "]")
    (tmp_path / "c.json").write_text('{"transactions": []}')
    got = read_exports(spark, [str(tmp_path)]).collect()
    assert sorted(r.amount for r in got) == [Decimal("-2"), Decimal("-1.5"), Decimal("3")]
    assert len({str(r.row_ord) for r in got}) == 3
    assert read_exports(spark, [str(tmp_path / "c.json")]).count() == 0
    lines = tmp_path / "d.jsonl"
    lines.write_text(row % (4, "1") + "\n" + row % (5, "2") + "\n")
    assert read_exports(spark, [str(lines)]).count() == 2


def test_rejected_rows_are_listed_with_reasons(spark, tmp_path):
    from cashweave.operators.normalize import rejects
    from cashweave.sources.exports import read_all
    p = tmp_path / "bad.csv"
    p.write_text("Date,Memo,Amount\nsoon,a,1\n2026-03-01,b,\n2026-03-01,,1\n2026-03-01,c,1e29\n2026-03-01,d,0.1234567890123456789\n"
                 "2026-03-01,e,0.123456789012345678\n2026-03-01,f,n/a\n2026-03-01,g,1e-30\n")
    every = read_all(spark, [str(p), str(tmp_path / "missing.csv")], on_error="skip")
    got = {r.description: r.reject_reason for r in rejects(every).where("source = 'bad'").collect()}
    assert got == {"a": "no date", "b": "no amount", None: "no description", "c": "amount not exact", "d": "amount not exact",
                   "f": "no amount", "g": "amount not exact"}
    assert rejects(every).where("reject_reason like 'entry not read%'").count() == 1
    assert [r.amount for r in read_exports(spark, [str(p)]).collect()] == [Decimal("0.123456789012345678")]


def test_hash_and_record_text_do_not_depend_on_the_session(spark):
    from cashweave.functions.amounts import canon_amount_text, record_amount_text
    df = spark.createDataFrame([("0",), ("0.00",), ("-0.0000001",), ("4200.005",), ("4200.00",), ("10",)], "s string")
    seen = []
    for ansi in ("true", "false"):
        spark.conf.set("spark.sql.ansi.enabled", ansi)
        a = coerce_amount("s")
        seen.append([tuple(r) for r in df.select(canon_amount_text(a), record_amount_text(a)).collect()])
    spark.conf.unset("spark.sql.ansi.enabled")
    assert seen[0] == seen[1] == [("0", "0.00"), ("0", "0.00"), ("-0.0000001", "-0.0000001"), ("4200.005", "4200.005"),
                                  ("4200", "4200.00"), ("10", "10.00")]


def test_percent_ties_go_to_even(spark):
    from cashweave.functions.amounts import percent_text
    xs = [0.745, 0.625, 0.125, 0.585, 0.705, 0.825, 0.005, 0.015, 1.0, 0.0, None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(percent_text("x")).collect()]
    assert got == [f"{x or 0:.0%}" for x in xs]


def _write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_each_file_is_read_by_its_own_header(spark, tmp_path):
    _write(tmp_path / "a/1.csv", "Date,Debit,Credit,Note,Note\n2026-03-01,1.00,,x,y\n")
    _write(tmp_path / "a/2.csv", "Date,Credit,Debit,Note,Note\n2026-03-02,,2.00,x,y\n")
    _write(tmp_path / "b/3.csv", "Date,Amount,Memo\n2026-03-03,3.00,third\n")
    _write(tmp_path / "b/deep/4.csv", "Amount,Memo,Date\n4.00,fourth,2026-03-04\n")
    _write(tmp_path / "b/deep/5.json", '[{"memo": "fifth", "amount": -5, "date": "2026-03-05"}]')
    _write(tmp_path / "b/_hidden.csv", "foo,bar\n1,2\n")
    rows = read_exports(spark, [str(tmp_path / "b")]).collect()
    assert sorted((r.transaction_date.day, r.amount, r.source) for r in rows) == [
        (3, Decimal(3), "3"), (4, Decimal(4), "4"), (5, Decimal(-5), "5")]
    with pytest.raises(IngestionError):            # "Note" is no description
        read_exports(spark, [str(tmp_path / "a")])
    for name, text in (("1", "Date,Debit,Credit,Memo,Memo\n2026-03-01,1.00,,x,y\n"), ("2", "Date,Credit,Debit,Memo,Memo\n2026-03-02,,2.00,x,y\n"),
                       ("6", '\ufeff"Date","Me\nmo",Memo,Debit,Credit\n2026-03-06,z,x,,6.00\n'), ("7", "")):
        _write(tmp_path / f"a/{name}.csv", text)
    got = {r.source: (r.amount, r.description) for r in read_exports(spark, [str(tmp_path / "a")]).collect()}
    assert got == {"1": (Decimal(-1), "x"), "2": (Decimal(-2), "x"), "6": (Decimal(6), "x")}


def test_a_folder_with_broken_files_and_skip(spark, tmp_path):
    import gzip

    from cashweave.operators.normalize import rejects
    from cashweave.sources.exports import read_all
    _write(tmp_path / "good [1].csv", "Date,Amount,Memo\n2026-03-03,3.00,third\n")
    _write(tmp_path / "no date.csv", "Amount,Memo\n3.00,third\n")
    _write(tmp_path / "sheet.xlsx", "not read")
    _write(tmp_path / "no.json", "{ this is no JSON")
    (tmp_path / "cut.csv.gz").write_bytes(gzip.compress(b"Date,Amount,Memo\n" * 5000)[:60])
    every = read_all(spark, [str(tmp_path)], on_error="skip")
    listed = {r.source.rpartition("/")[2]: r.reject_reason for r in rejects(every).collect()}
    assert set(listed) == {"no date.csv", "sheet.xlsx", "cut.csv.gz"} and "transaction_date" in listed["no date.csv"]
    assert [r.description for r in read_exports(spark, [str(tmp_path)], on_error="skip").collect()] == ["third"]
    with pytest.raises(IngestionError):
        read_exports(spark, [str(tmp_path)])
    with pytest.raises(Exception, match="no JSON"):
        read_exports(spark, [str(tmp_path / "no.json")]).collect()


def test_json_documents_keep_their_own_columns(spark, tmp_path):
    _write(tmp_path / "a.json", '{"transactions": [{"Posting Date": "2026-03-01", "Withdrawal": "1.50", "payee": "a", "Ref": 7},'
                                ' {"Posting Date": "2026-03-02", "Deposit": 2, "payee": "b", "amount": 99}]}')
    _write(tmp_path / "b.json", '[{" DATE ": "2026-03-03", "Amt": -3.10, "memo": "c"}, {"date": "2026-03-04", "amount": 1e2, "desc": "d", "Ref": "x"}, 5]')
    _write(tmp_path / "c.jsonl", '{"date": "2026-03-05", "amount": "$5.00", "memo": "e"}\n\n{"date": "2026-03-06", "memo": "no amount"}\n')
    rows = read_exports(spark, [str(tmp_path)], keep=("Ref",)).collect()
    assert {(r.description, r.amount, r.Ref) for r in rows} == {
        ("a", Decimal("-1.50"), "7"), ("b", Decimal(2), None), ("c", Decimal("-3.10"), None), ("d", Decimal(100), "x"), ("e", Decimal(5), None)}
    assert len({str(r.row_ord) for r in rows}) == 5
    _write(tmp_path / "d.json", '[{"date": "2026-03-01", "memo": "no amounts at all"}]')
    with pytest.raises(Exception, match="no column for: amount"):
        read_exports(spark, [str(tmp_path / "d.json")]).collect()


def test_one_scan_for_each_layout_and_none_for_inference(spark, tmp_path):
    for k in range(6):
        _write(tmp_path / f"{k}.csv", ("Date,Amount,Memo\n2026-03-0%d,1,x%d\n" if k % 2 else "Amount,Date,Memo\n1,2026-03-0%d,x%d\n") % (k + 1, k))
        _write(tmp_path / f"{k}.json", '[{"date": "2026-03-01", "amount": %d, "memo": "j"}]' % k)
    df = read_exports(spark, [str(tmp_path)])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan csv") == 2 and plan.count("FileScan text") == 1 and "FileScan json" not in plan
    assert df.count() == 12
