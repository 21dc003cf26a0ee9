import os

from cashweave.plans.jobs import ingest, run_ledger_job
from cashweave.schema import TAX_CATEGORIES


def test_run_ledger_job(spark, samples):
    res = run_ledger_job(spark, [samples["card"], samples["checking"]], starting_balance=10000.0, horizon_days=60)
    tx = res["transactions"].collect()
    assert len(tx) == 12
    assert all(r.category in TAX_CATEGORIES for r in tx)
    assert res["projection"].count() == 60
    f = res["forecast"].first()
    assert round(f.mean_daily_net, 6) == 378.546667
    assert round(f.mean_daily_burn, 6) == 236.777143


def test_run_ledger_job_writes(spark, samples, tmp_path):
    out = str(tmp_path / "out")
    res = run_ledger_job(spark, [samples["card"]], horizon_days=30, out=out)
    assert res["projection"].count() == 30
    assert os.path.isdir(os.path.join(out, "transactions_categorized"))
    assert os.path.isdir(os.path.join(out, "forecast"))
    f = res["forecast"].first()
    assert round(f.mean_daily_net, 6) == 130.850833 and round(f.mean_daily_burn, 6) == 254.965


def test_ingest_masks(spark, samples, tmp_path):
    res = ingest(spark, [samples["card"], samples["card"], samples["checking"]], out=str(tmp_path / "clean"),
                 mask=True, fmt="csv")
    rows = res["transactions"].collect()
    assert len(rows) == 12
    atm = [r for r in rows if "ATM" in r.description][0]
    assert "700800900100" in atm.description
    assert "700800900100" not in atm.description_masked
    d = res["dedup"].first()
    assert (d.rows_before, d.duplicates_removed, d.rows_after) == (19, 7, 12)
    per = {r.source: r.rows for r in res["rows_per_source"].collect()}
    assert per == {"card_may": 14, "checking_may": 5}


def test_one_table_through_the_whole_chain(spark, samples, tmp_path):
    """Files -> ingest -> answers -> citations -> model merge, as they come."""
    from cashweave.operators.advisor import answer_citations, answer_questions, answers_json, citation_integrity, citation_sets
    from cashweave.operators.categorize import categorize
    from cashweave.operators.model_batches import merge_responses, request_bodies, request_rows
    t = categorize(ingest(spark, [samples["card"], samples["checking"], samples["app"]], out=str(tmp_path / "clean"))["transactions"])
    n = t.count()
    q = spark.createDataFrame([(1, "How long is my runway?", 10.0), (2, "How high was spending lately?", 0.0)],
                              "question_id long, question string, starting_balance double")
    answers, _ = answer_questions(q, t, as_of="2031-05-13")
    sets = citation_sets(t)
    assert answers.count() == 2 and citation_integrity(sets, t).first().missing_citations == 0
    assert answer_citations(answers, sets).where("question_id = 1").count() == n
    assert answers_json(answers, None, sets).count() == 2
    rows = request_rows(t, batch_size=4)
    assert request_bodies(rows).count() >= 3
    replies = rows.select("account_id", "batch_id").distinct().selectExpr("account_id", "batch_id", "'[]' as response")
    merged = merge_responses(rows, replies, t).collect()
    assert len(merged) == n and {r.method for r in merged} == {"model"}


def test_methods_can_be_chosen(spark, samples):
    import pytest
    res = run_ledger_job(spark, [samples["card"]], horizon_days=7, forecaster="weekly_seasonal")
    assert res["forecaster_backend"] == "weekly_seasonal" and res["projection"].count() == 7
    responses = spark.createDataFrame([(0, 0, '[{"index": 0, "category": "Travel", "confidence": 1}]')], "account_id long, batch_id long, response string")
    res = run_ledger_job(spark, [samples["card"]], categorizer="model", responses=responses)
    got = res["transactions"].collect()
    assert res["categorizer_backend"] == "model" and len(got) == 7 and sum(r.category == "Travel" for r in got) == 1
    assert run_ledger_job(spark, [samples["card"]], categorizer="model")["categorizer_backend"] == "rules"
    res = run_ledger_job(spark, [samples["card"]], horizon_days=7, forecaster="changing_trend")
    assert res["forecaster_backend"] == "changing_trend" and res["projection"].count() == 7
    with pytest.raises(ValueError):
        run_ledger_job(spark, [samples["card"]], forecaster="guess")


def test_many_ledgers_with_their_column(spark, tmp_path):
    p = tmp_path / "all.csv"
    p.write_text("Ledger,Date,Memo,Amount\nA,2031-05-01,x,-1\nB,2031-05-01,x,-1\nA,2031-05-01,x,-1\n")
    res = run_ledger_job(spark, [str(p)], account_col="Ledger", horizon_days=3)
    assert sorted(r.account_id for r in res["transactions"].collect()) == ["A", "B"]
    assert res["forecast"].count() == 2


def test_the_job_runs_as_a_process_from_another_folder(samples, tmp_path):
    import json
    import subprocess
    import sys
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {**os.environ, "PYTHONPATH": root, "SPARK_CONF_DIR": str(tmp_path)}

    def job(*args):
        return subprocess.run([sys.executable, "-m", "cashweave.plans.jobs", *args], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)

    out = str(tmp_path / "clean")
    done = job("ingest", samples["card"], samples["card"], samples["checking"], "--out", out, "--mask-pii")
    assert done.returncode == 0 and "|19" in done.stdout.replace(" ", "") and "|12|" in done.stdout.replace(" ", ""), done.stderr[-2000:]
    assert job("note", "--text", "Marketing gets more money in autumn", "--store", str(tmp_path / "notes")).returncode == 0
    asked = job("ask", "Which goals does marketing have for autumn?", "--transactions", out, "--store", str(tmp_path / "notes"))
    record = json.loads(asked.stdout.strip().splitlines()[-1])
    assert record["intent"] == "general" and record["retrieved_notes"][0]["text"] == "Marketing gets more money in autumn"
    assert job("ingest", "nothing.csv", "--out", out).returncode == 2
    asked = job("ask", "How long is my runway?", "--transactions", out)
    cited = json.loads(asked.stdout.strip().splitlines()[-1])["citations"]
    assert "ids" not in cited and cited["scope"] == "window" and cited["count"] == 12
    listed = job("ask", "How long is my runway?", "--transactions", out, "--list-ids")
    assert len(json.loads(listed.stdout.strip().splitlines()[-1])["citations"]["ids"]) == 12
    replies = tmp_path / "replies.json"
    replies.write_text(json.dumps({"batch_id": 0, "response": '[{"index": 0, "category": "Travel", "confidence": 1}]'}) + "\n")
    done = job("run", samples["card"], "--out", str(tmp_path / "run"), "--categorizer", "model", "--responses", str(replies), "--format", "csv",
               "--forecaster", "changing_trend")
    assert done.returncode == 0, done.stderr[-2000:]
    import pandas as pd
    rows = pd.concat(pd.read_csv(p) for p in (tmp_path / "run" / "transactions_categorized").glob("*.csv"))
    assert sorted(rows.category) == ["Travel"] + ["Uncategorized"] * 6


def test_the_model_method_keeps_rows_of_several_ledgers(spark, tmp_path):
    from cashweave.plans.jobs import run_ledger_job
    p = tmp_path / "two.csv"
    p.write_text("Date,Amount,Memo,Ledger\n2026-03-01,-5,uber,1\n2026-03-01,-5,uber,2\n2026-03-02,-6,rent,2\n")
    replies = spark.createDataFrame([("1", 0, '[{"index": 0, "category": "Meals", "confidence": 1}]')],
                                    "account_id string, batch_id long, response string")
    rows = run_ledger_job(spark, [str(p)], categorizer="model", responses=replies, account_col="Ledger")["transactions"].collect()
    assert sorted((r.account_id, r.amount, r.category) for r in rows) == [("1", -5, "Meals"), ("2", -6, "Rent"), ("2", -5, "Travel")]
