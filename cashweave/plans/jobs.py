"""End-to-end jobs (O3 ingest, O17 ledger job, note and ask) for ``spark-submit``.

    spark-submit --py-files cashweave.zip -m cashweave.plans.jobs ...   # on a cluster
    cashweave ingest march.csv april.json --out /data/clean             # installed

With an output folder, each stage's result is written and the next stage
reads the written table: the lineage is cut at every stage boundary, a lost
executor only re-runs the current stage, and the categorized table is
scanned (not recomputed) by the forecast.
"""

from __future__ import annotations

import argparse
import sys
from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cashweave.functions.pii import mask_pii
from cashweave.operators.advisor import answer_questions, answer_records, answers_json, citation_chunks, citation_sets
from cashweave.operators.categorize import RULES_METHOD, categorize
from cashweave.operators.change_points import CHANGING_METHOD, changing_trend_projection
from cashweave.operators.dedup import deduplicate
from cashweave.operators.fact_store import FactStore
from cashweave.operators.forecast import LINEAR_METHOD, forecast_projection, forecast_summary
from cashweave.operators.ledger_store import LedgerStore
from cashweave.operators.model_batches import MODEL_METHOD, with_responses
from cashweave.operators.normalize import canonical, rejects
from cashweave.operators.note_store import NoteStore
from cashweave.operators.notes import prepare_notes
from cashweave.operators.seasonal import SEASONAL_METHOD, seasonal_projection
from cashweave.schema import IngestionError
from cashweave.sinks.writers import ingest_report, observed, write_table
from cashweave.sources.exports import newest_version, read_all, read_notes, read_transactions

ORDER = ("file_ord", "row_ord")
FORECASTERS = (LINEAR_METHOD, SEASONAL_METHOD, CHANGING_METHOD)


def ingest(spark: SparkSession, sources: Sequence[str], out: str | None = None, mask: bool = False,
           fmt: str = "parquet", on_error: str = "fail", source: str | None = None, account_col: str | None = None,
           date_formats: Sequence[str] | None = None, multiline_csv: bool = True,
           extra_key_cols: Sequence[str] = (), rejects_out: str | None = None) -> dict[str, DataFrame | dict]:
    """Read, normalise, union, keep-first de-duplicate, optionally mask (O3).

    ``rejects`` are the rows that are no transactions, with the reason;
    ``rejects_out`` writes them. ``dedup`` holds the totals; when a table is
    written they are counted on the way, not by passes of their own.
    """
    every = read_all(spark, sources, source, date_formats, on_error, tuple(extra_key_cols), multiline_csv, account_col)
    carried = (*ORDER, *extra_key_cols, *(["account_id"] if account_col else []))
    union = canonical(every, carried)
    per_source, totals = ingest_report(union)
    left_out = rejects(every, ("file_ord", "row_ord"))
    counted, before = observed(union, "rows before de-duplication") if out else (union, None)
    clean = deduplicate(counted, order_by=list(ORDER), extra_key_cols=extra_key_cols)
    if mask:
        clean = clean.withColumn("description_masked", mask_pii("description"))
    if rejects_out:
        write_table(left_out.drop(*ORDER), rejects_out, fmt=fmt)
    if out:
        clean, after = observed(clean, "rows after de-duplication")
        write_table(clean, out, fmt=fmt)
        b, a = before.get["rows"], after.get["rows"]
        totals = spark.createDataFrame([(b, b - a, a)], "rows_before long, duplicates_removed long, rows_after long")
        clean = read_transactions(spark, out, fmt=fmt)
    return {"transactions": clean, "rows_per_source": per_source, "dedup": totals, "rejects": left_out}


def run_ledger_job(spark: SparkSession, sources: Sequence[str], starting_balance: float | DataFrame = 0.0,
                   horizon_days: int = 90, out: str | None = None, as_of: str | None = None, fmt: str = "parquet",
                   categorizer: str = RULES_METHOD, forecaster: str = LINEAR_METHOD, responses: DataFrame | None = None,
                   lexicon=None, **options) -> dict[str, DataFrame | str]:
    """Load -> union -> dedup -> categorize -> forecast.

    ``categorizer="model"`` merges ``responses`` to the request batches over
    the rules (H5); ``forecaster`` is linear, weekly_seasonal or
    changing_trend. ``options`` are those of ``ingest``.
    """
    if categorizer not in (RULES_METHOD, MODEL_METHOD) or forecaster not in FORECASTERS:
        raise ValueError(f"no such method: {categorizer} / {forecaster}")
    if categorizer == MODEL_METHOD and responses is None:
        categorizer = RULES_METHOD              # as without a model: the rules answer
    clean = ingest(spark, sources, **options)["transactions"]
    txns = categorize(clean, lexicon=lexicon)
    if categorizer == MODEL_METHOD:
        txns = with_responses(txns, responses, ("raw_hash", *options.get("extra_key_cols", ())))
    if out:
        write_table(txns, f"{out}/transactions_categorized", fmt=fmt)
        txns = read_transactions(spark, f"{out}/transactions_categorized", fmt=fmt)
    summary = forecast_summary(txns, starting_balance, horizon_days=horizon_days, as_of=as_of)
    if forecaster == LINEAR_METHOD:
        projection = forecast_projection(summary)
    else:
        fitted = seasonal_projection if forecaster == SEASONAL_METHOD else changing_trend_projection
        projection = fitted(txns, starting_balance, horizon_days)
    if out:
        write_table(summary, f"{out}/forecast_summary", fmt=fmt)
        write_table(projection, f"{out}/forecast", fmt=fmt)
    return {"transactions": txns, "forecast": summary, "projection": projection,
            "categorizer_backend": categorizer, "forecaster_backend": forecaster}


def add_notes(spark: SparkSession, store: str, notes: DataFrame, metadata: str | None = None, order_by: str | None = None) -> int:
    """Add notes (``text``, perhaps ``id``) to a stored note store as its next
    run; returns the number of notes it has. A store of whole versions
    (``write_notes``) becomes the first run."""
    runs = NoteStore(spark, store)
    if not runs.runs() and newest_version(spark, store):
        runs.add(read_notes(spark, store).withColumnRenamed("seq", "pos"))
    accepted, _ = prepare_notes(notes, id_col="id" if "id" in notes.columns else None, metadata=metadata, order_by=order_by)
    runs.add(accepted)
    return runs.rows().count()


def add_exports(spark: SparkSession, sources: Sequence[str], store: str, extra_key_cols: Sequence[str] = (), mask: bool = False,
                rejects_out: str | None = None, **options) -> dict[str, DataFrame | int]:
    """Ingest exports into a stored table that keeps each transaction once over
    all ingests; ``added`` counts the rows that were new. ``options`` are those
    of ``read_all``."""
    every = read_all(spark, sources, keep=tuple(extra_key_cols), **options)
    rows = canonical(every, (*ORDER, *extra_key_cols, *(["account_id"] if options.get("account_col") else [])))
    if mask:
        rows = rows.withColumn("description_masked", mask_pii("description"))
    left_out = rejects(every, ORDER)
    if rejects_out:
        write_table(left_out.drop(*ORDER), rejects_out)
    table = LedgerStore(spark, store, extra_key_cols=extra_key_cols)
    number = table.append(rows, list(ORDER))
    stored = table.read()
    return {"transactions": stored, "batch": number, "added": stored.where(F.col("batch") == number).count(), "rejects": left_out}


def keep_facts(spark: SparkSession, store: str, facts: str, lexicon=None) -> DataFrame:
    """Bring the daily facts in ``facts`` up to what ``add_exports`` added to
    ``store``; only months with new transactions are categorized and summed."""
    kept = FactStore(spark, facts)
    ledger = LedgerStore(spark, store).read()
    if ledger is None:
        raise IngestionError(f"There is no table in {store}")
    kept.update(ledger, lambda rows: categorize(rows, lexicon=lexicon))
    return kept.read()


def ask(spark: SparkSession, transactions: str, questions: DataFrame, store: str | None = None, fmt: str = "parquet",
        as_of: str | None = None, citations: str | None = None, list_ids: bool = False) -> DataFrame:
    """Answer questions about stored transactions, with the stored notes: the
    JSON record of each, of bounded size, which names its citation set and the
    number of ids in it. With a folder ``citations`` each set is written there
    once, in chunks. ``list_ids`` lists all ids in the record instead, which for
    a busy account is one large row."""
    txns = read_transactions(spark, transactions, fmt=fmt)
    if "category" not in txns.columns or txns.where(F.col("category").isNull()).limit(1).count():
        txns = categorize(txns)
    notes = read_notes(spark, store) if store else None
    answers, hits = answer_questions(questions, txns, notes=notes, as_of=as_of)
    pos = "row_ord" if "row_ord" in txns.columns else "transaction_date"
    sets = citation_sets(txns, pos_col=pos)
    if citations is not None:
        write_table(citation_chunks(sets), citations, fmt="parquet")
    return answers_json(answers, hits, sets) if list_ids else answer_records(answers, hits)


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """Replies to the request batches: JSON lines of ``batch_id``, ``response``
    and, where there are several ledgers, ``account_id``."""
    replies = spark.read.schema("account_id string, batch_id long, response string").json(path)
    return replies.withColumn("account_id", F.coalesce("account_id", F.lit("0")))


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cashweave")
    sub = p.add_subparsers(dest="cmd", required=True)
    for name in ("ingest", "run"):
        c = sub.add_parser(name)
        c.add_argument("inputs", nargs="+")
        c.add_argument("--out", required=True)
        c.add_argument("--format", default="parquet")
        c.add_argument("--mask-pii", action="store_true")
        c.add_argument("--source")
        c.add_argument("--account-column")
        c.add_argument("--date-format", action="append")
        c.add_argument("--single-line-csv", action="store_true")
        c.add_argument("--on-error", choices=["fail", "skip"], default="fail")
        c.add_argument("--rejects-out")
        if name == "ingest":
            c.add_argument("--append", action="store_true", help="keep what --out holds and add what is new")
        if name == "run":
            c.add_argument("--starting-balance", type=float, default=0.0)
            c.add_argument("--horizon", type=int, default=90)
            c.add_argument("--forecaster", choices=FORECASTERS, default=LINEAR_METHOD)
            c.add_argument("--categorizer", choices=[RULES_METHOD, MODEL_METHOD], default=RULES_METHOD)
            c.add_argument("--responses", help="folder of the model's replies, JSON lines")
    note = sub.add_parser("note")
    note.add_argument("--text", required=True)
    note.add_argument("--type", default="note")
    note.add_argument("--priority", default="normal")
    note.add_argument("--store", required=True)
    q = sub.add_parser("ask")
    q.add_argument("question")
    q.add_argument("--transactions", required=True)
    q.add_argument("--format", default="parquet")
    q.add_argument("--starting-balance", type=float, default=0.0)
    q.add_argument("--store")
    q.add_argument("--citations")
    q.add_argument("--list-ids", action="store_true")
    return p


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    try:
        if args.cmd in ("ingest", "run"):
            options = dict(mask=args.mask_pii, source=args.source, account_col=args.account_column,
                           date_formats=args.date_format, multiline_csv=not args.single_line_csv,
                           on_error=args.on_error, rejects_out=args.rejects_out)
        if args.cmd == "ingest" and args.append:
            if args.format != "parquet":
                raise ValueError("--append needs parquet")
            print(f"{add_exports(spark, args.inputs, args.out, **options)['added']} rows added")
        elif args.cmd == "ingest":
            res = ingest(spark, args.inputs, out=args.out, fmt=args.format, **options)
            res["dedup"].show(truncate=False)
        elif args.cmd == "run":
            res = run_ledger_job(spark, args.inputs, args.starting_balance, args.horizon, out=args.out, fmt=args.format,
                                 forecaster=args.forecaster, categorizer=args.categorizer,
                                 responses=read_responses(spark, args.responses) if args.responses else None, **options)
            res["forecast"].select("account_id", "summary").show(truncate=False)
        elif args.cmd == "note":
            row = spark.createDataFrame([(args.text, {"type": args.type, "priority": args.priority})],
                                        "text string, metadata map<string,string>")
            print(f"{add_notes(spark, args.store, row, metadata='metadata')} notes")
        else:
            asked = spark.createDataFrame([(1, args.question, args.starting_balance)],
                                          "question_id long, question string, starting_balance double")
            print(ask(spark, args.transactions, asked, args.store, args.format, citations=args.citations,
                      list_ids=args.list_ids).first()["json"])
    except (IngestionError, ValueError) as e:
        print(f"[error] {e}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
