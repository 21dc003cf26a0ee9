import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from cashweave.operators.categorize import categorize
from cashweave.operators.model_batches import merge_responses, request_bodies, request_rows
from cashweave.operators.reports import daily_cashflow, kpis, spend_by_category, transaction_detail
from cashweave.operators.seasonal import seasonal_projection
from cashweave.sources.exports import read_exports


def _card(spark, samples):
    t = read_exports(spark, [samples["card"], samples["checking"]]).withColumn("account_id", F.lit(1).cast("long"))
    return categorize(t)


def test_kpis_and_spend(spark, samples):
    t = _card(spark, samples)
    k = kpis(t).first()
    assert k.transactions == 12 and k.total_income == Decimal("6200.00")
    assert k.net_cashflow == k.total_income - k.total_expenses
    s = spend_by_category(t).collect()
    amounts = [r.amount for r in s]
    assert amounts == sorted(amounts, reverse=True)
    assert sum(amounts) == k.total_expenses          # sum by category = total
    assert daily_cashflow(t).count() == 8
    d = transaction_detail(t).where("Description like 'STARBUCKS HARBOUR%'").first()
    assert d.Amount == "$-4.20" and d.Confidence == "95%"


def test_model_batches(spark, samples):
    t = _card(spark, samples)
    rows = request_rows(t, batch_size=5, key="row_ord")
    bodies = request_bodies(rows).collect()
    assert sum(b.n_rows for b in bodies) == 12
    assert all("[PHONE]" in b.body or "700800900100" not in b.body for b in bodies)
    first = rows.select("account_id", "batch_id").distinct().collect()
    resp = [(r.account_id, r.batch_id, '```json\n[{"index": 0, "category": "Snacks"}, {"index": 99}]\n```')
            for r in first[:1]] + [(r.account_id, r.batch_id, "no json here") for r in first[1:]]
    responses = spark.createDataFrame(resp, "account_id long, batch_id long, response string")
    merged = merge_responses(rows, responses, t, key="row_ord")
    out = merged.collect()
    assert len(out) == 12
    model_rows = [r for r in out if r.method == "model"]
    assert any(r.category == "Uncategorized" and r.ai_confidence_score == 0.5 for r in model_rows)
    assert all(r.category == "Uncategorized" for r in model_rows)


def test_seasonal_projection_shape(spark):
    rows = [(1, dt.date(2026, 1, 1) + dt.timedelta(days=i), Decimal("-10") if i % 7 else Decimal("50"))
            for i in range(28)]
    df = spark.createDataFrame(rows, "account_id long, transaction_date date, amount decimal(18,2)")
    p = seasonal_projection(df, 100.0, horizon_days=14).orderBy("day_no").collect()
    assert len(p) == 14 and p[0].date == dt.date(2026, 1, 29)


def test_responses_are_read_strictly(spark):
    from cashweave.operators.model_batches import parse_response
    texts = {'[{"index": 1, "category": "Travel", "confidence": 0.5}]': 1, '{"index": 1}': None, '[{"index": "1"}]': 1,
             '[{"index": 0, "confidence": "high"}]': None, '[{"index": "one"}]': None, "[]": 0, "no": None, "[1, 2]": None,
             '```json\n[{"category": "Meals"}]\n```': 1, None: None}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: r.n for r in df.select("t", F.when(parse_response(F.col("t")).isNotNull(), F.size(parse_response(F.col("t")))).alias("n")).collect()}
    assert got == texts


def test_only_one_whole_json_list_is_a_reply(spark):
    from pyspark.sql import functions as F

    from cashweave.operators.model_batches import parse_response
    good = ['[{"index": 1, "category": "Meals", "confidence": 0.5}]', '```json\n[{"index": "1"}]\n```', "[]", '[{"index": 1.7}]',
            '[{"index": true, "confidence": " 0.5 "}]', '[{"category": ["x"]}]']
    bad = ['[{"index": 1}] trailing', '[{"index": 1}], []', '[{"index": 1}] []', '{"index": 1}', '[{"index": "1.7"}]', '[{"index": null}]', "[1]",
           '[{"index": 1, "confidence": "high"}]', '[{"index": [1]}]', "", None, "prose", '[{"index": 1}']
    df = spark.createDataFrame([(t,) for t in [*good, *bad]], "t string").select(parse_response(F.col("t")).isNotNull().alias("ok"))
    assert [bool(r.ok) for r in df.collect()] == [True] * len(good) + [False] * len(bad)


def test_equal_rows_of_several_ledgers_stay_apart(spark):
    from cashweave.operators.categorize import categorize
    from cashweave.operators.model_batches import request_rows, with_responses
    rows = [(1, "h1", None, "uber", -1.0), (2, "h1", None, "uber", -1.0), (2, "h1", "r2", "uber", -1.0), (2, "h3", "r3", "salary", 5.0)]
    t = categorize(spark.createDataFrame(rows, "account_id long, raw_hash string, ref string, description string, amount double"))
    asked = {(r.account_id, r.batch_id) for r in request_rows(t, key=("raw_hash", "ref")).collect()}
    replies = spark.createDataFrame([(a, b, '[{"index": 0, "category": "Rent", "confidence": 1}]') for a, b in asked if a == 2] * 2,
                                    "account_id long, batch_id long, response string")
    got = with_responses(t, replies, ("raw_hash", "ref")).collect()
    assert len(got) == 4 and got[0].__fields__ == t.columns
    assert sorted((r.account_id, r.raw_hash, r.ref or "", r.category) for r in got) == [
        (1, "h1", "", "Travel"), (2, "h1", "", "Rent"), (2, "h1", "r2", "Uncategorized"), (2, "h3", "r3", "Uncategorized")]


def test_rewrite_contexts_are_written_once_per_list_of_notes(spark):
    """Every hit carried its text and was masked anew."""
    from pyspark.sql import functions as F
    from cashweave.operators.model_batches import rewrite_context
    from cashweave.operators.notes import prepare_notes, search_notes, upsert_notes
    batch = spark.createDataFrame([("Call 555-123-4567 about marketing goals",), ("Marketing goals for autumn: mail a@b.example",),
                                   ("Repairs of the van",)], "text string")
    notes = upsert_notes(None, prepare_notes(batch, dim=64)[0])
    asked = [(i, ["marketing goals?", "van repairs", "QQ", None][i % 4]) for i in range(40)] + [(1, "marketing goals?"), (None, "van repairs")]
    questions = spark.createDataFrame(asked, "question_id long, question string")
    answers = questions.select("question_id", "question", F.lit("It is so.").alias("answer"))
    hits = search_notes(notes, questions, k=2, dim=64)
    got = rewrite_context(answers, hits, notes)
    prompts = sorted(map(tuple, got.collect()), key=str)
    assert prompts == sorted(map(tuple, rewrite_context(answers, hits).collect()), key=str) and len(prompts) == 42
    text = dict(p for p in prompts if p[0] is not None)
    assert "[PHONE]" in text[4] and "[EMAIL]" in text[4] and text[4].count("\n- [") == 2 and "\n(none)\n" in text[2]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    masking = [line for line in plan.splitlines() if "PHONE" in line]
    assert masking and not any("question_id" in line or "rank" in line for line in masking)


def test_questions_of_one_text_are_embedded_once(spark):
    from pyspark.sql import functions as F
    from cashweave.operators.notes import prepare_notes, search_notes, upsert_notes
    seen = spark.sparkContext.accumulator(0)

    def vector(text):
        seen.add(1)
        return [float(len(text or "")), 1.0]

    def embed(df, text, out):
        return df.withColumn(out, F.udf(vector, "array<double>")(text))

    notes = upsert_notes(None, prepare_notes(spark.createDataFrame([("a note",)], "text string"), embed=embed)[0]).localCheckpoint()
    seen.value = 0
    questions = spark.createDataFrame([(i, "one text") for i in range(50)], "question_id long, question string")
    hits = search_notes(notes, questions, k=2, embed=embed)
    assert hits.count() == 50 and hits.where("rank = 1").count() == 50
    assert 1 <= seen.value <= 5         # not for each question, nor for each use of the hits
