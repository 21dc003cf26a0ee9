"""Batch question answering over many ledgers.

``answer_questions`` answers a table of questions
``(question_id, account_id, question, starting_balance)`` against categorized
transactions, the way the single-question advisor does: route the question
(runway / affordability / category spend / general), compute the figures over
the account's trailing window (the last ``window_days`` days up to the
account's own latest date, inclusive) or whole ledger, and write the same
answer texts.

Plan shape: transactions are reduced once to per-(account, day, category)
facts (partial aggregation, one shuffle); the daily series, trailing-window
totals and per-category totals all derive from those facts, and questions
join the small per-account aggregates, so no question touches raw rows.

Citations stay normalised: every answer names a citation set (account,
scope, category) and its size, and ``citation_sets`` lists each set's
transaction ids once. Expanding to one row per (question, transaction) is
left to the consumer (``answer_citations``), so many questions on one busy
account do not multiply its window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cashweave.functions.amounts import money_text
from cashweave.functions.numeric import py_round
from cashweave.functions.questions import question_amount, question_category, route_intent
from cashweave.operators import forecast as fc
from cashweave.operators.accounts import with_account
from cashweave.operators.notes import DEFAULT_K, search_notes
from cashweave.schema import GENERAL_INTENT
from cashweave.session import stored

DEFAULT_WINDOW_DAYS = 30
RUNWAY_HORIZON = 180
AFFORD_HORIZON = 90
RULES_BACKEND = "rules"

SCOPE_WINDOW = "window"
SCOPE_WINDOW_EXPENSES = "window_expenses"
SCOPE_WINDOW_CATEGORY = "window_category"
SCOPE_NOTE = "note"


def trailing_window(txns: DataFrame, days: int = DEFAULT_WINDOW_DAYS) -> DataFrame:
    """Rows dated on or after (account's latest date - days).

    The per-account latest date is a partial aggregate joined back; Spark
    broadcasts it at run time when its measured size is small (AQE) and
    otherwise shuffle-joins with skew splitting, so a hot account is split
    across tasks instead of landing in one window partition.
    """
    txns = with_account(txns)
    latest = txns.groupBy("account_id").agg(F.max("transaction_date").alias("_max_date"))
    return txns.join(latest, "account_id") \
        .where(F.col("transaction_date") >= F.date_sub("_max_date", days)).drop("_max_date")


def ledger_facts(txns: DataFrame) -> DataFrame:
    """(account_id, date, category, net, spend, rows, expense_rows).

    One partial-aggregated pass over the transactions; every figure the
    answers need (daily nets, trailing-window totals, per-category totals)
    derives from this table, whose size is bounded by accounts x days x
    categories rather than by transaction volume.
    """
    neg = F.col("amount") < 0
    return with_account(txns).groupBy("account_id", F.col("transaction_date").alias("date"), "category").agg(
        F.sum("amount").alias("net"),
        F.sum(F.when(neg, F.col("amount"))).alias("spend"),
        F.count(F.lit(1)).alias("rows"),
        F.count(F.when(neg, F.lit(1))).alias("expense_rows"),
    )


def window_from_facts(facts: DataFrame, days: int = DEFAULT_WINDOW_DAYS) -> tuple[DataFrame, DataFrame]:
    """Trailing-window totals per account and per (account, category)."""
    # over facts, not rows: an account's partition is bounded by the calendar
    latest = F.max("date").over(Window.partitionBy("account_id"))
    win = facts.withColumn("_max_date", latest).where(F.col("date") >= F.date_sub("_max_date", days))
    by_cat = win.groupBy("account_id", "category").agg(
        F.sum("net").alias("cat_net"),
        F.sum("spend").alias("cat_spend"),
        F.sum("rows").alias("cat_rows"),
        F.sum("expense_rows").alias("cat_expense_rows"),
    )
    acct = by_cat.groupBy("account_id").agg(
        F.sum("cat_net").alias("net_window"),
        F.sum("cat_spend").alias("spend_window"),
        F.sum("cat_rows").alias("rows_window"),
        F.sum("cat_expense_rows").alias("expense_rows_window"),
    )
    return acct, by_cat.select("account_id", "category", "cat_spend", "cat_rows")


def window_aggregates(txns: DataFrame, days: int = DEFAULT_WINDOW_DAYS) -> tuple[DataFrame, DataFrame]:
    """(per-account window totals, per-(account, category) window totals).

    Account level: net (G4), expense sum (G5), row and expense-row counts.
    Category level: expense sum and row count (G6; income rows count too).
    """
    return window_from_facts(ledger_facts(txns), days)


def citation_sets(txns: DataFrame, days: int = DEFAULT_WINDOW_DAYS, pos_col: str = "row_ord") -> DataFrame:
    """Transaction ids behind each citable set (O14), in input order.

    (account_id, scope, category, raw_hash, pos): every window row under
    "window", window expenses under "window_expenses", and window rows per
    category under "window_category".
    """
    none = F.lit(None).cast("string")
    scopes = F.array_compact(F.array(
        F.struct(F.lit(SCOPE_WINDOW).alias("scope"), none.alias("category")),
        F.when(F.col("amount") < 0, F.struct(F.lit(SCOPE_WINDOW_EXPENSES).alias("scope"), none.alias("category"))),
        F.struct(F.lit(SCOPE_WINDOW_CATEGORY).alias("scope"), F.col("category").alias("category"))))
    rows = trailing_window(txns, days).select("account_id", "raw_hash", F.col(pos_col).alias("pos"), F.explode(scopes).alias("s"))
    return rows.select("account_id", "s.scope", "s.category", "raw_hash", "pos")


def parse_questions(questions: DataFrame, text: str = "question") -> DataFrame:
    """Add intent, amount and category."""
    return questions.withColumn("intent", route_intent(text)) \
        .withColumn("asked_amount", question_amount(text)) \
        .withColumn("asked_category", question_category(text))


def answer_questions(questions: DataFrame, txns: DataFrame | None, notes: DataFrame | None = None,
                     window_days: int = DEFAULT_WINDOW_DAYS, as_of: str | Column | None = None,
                     k: int = DEFAULT_K, dim: int = 256, embed=None, retrieve: bool = True,
                     facts: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Answer every question against its account's transactions.

    Returns ``(answers, hits)``. ``answers``: question_id, account_id,
    question, intent, answer, cite_scope, cite_category, n_citations,
    note_id, backend. ``hits``: the top-k retrieved notes per question (or
    None without a note store). The notes are searched once for both; with
    ``retrieve=False`` only for the general questions' answers, without hits.
    ``facts`` are the ``ledger_facts`` of the transactions, if they are kept
    (``FactStore``); then no transactions are read.
    """
    today = F.current_date() if as_of is None else (F.to_date(F.lit(as_of)) if isinstance(as_of, str) else as_of)
    if "account_id" not in (txns if facts is None else facts).columns:        # one ledger, whatever the questions say
        questions = questions.drop("account_id")
    questions = with_account(questions)
    q = parse_questions(questions)

    # Stored, as the figures use different columns of them and each would read and categorize the ledger.
    facts = stored(ledger_facts(txns), "ledger-facts") if facts is None else with_account(facts)
    daily = facts.groupBy("account_id", "date").agg(F.sum("net").alias("net"))
    stats = fc.stats_from_daily(daily)
    acct_win, cat_win = window_from_facts(facts, window_days)

    hits = None
    top = None
    if notes is not None:
        asked = questions if retrieve else q.where(F.col("intent") == GENERAL_INTENT)
        found = search_notes(notes, asked.select("question_id", "question"), k=k if retrieve else 1, dim=dim, embed=embed, keep=True)
        hits = found if retrieve else None
        # min_by, as a filter on the rank would make another search of it
        best = F.min_by(F.struct("seq", "id"), "rank")
        top = found.groupBy("question_id").agg(best.alias("n")).select("question_id", "n.seq", F.col("n.id").alias("note_id"))

    j = q.join(stats, "account_id", "left").join(acct_win, "account_id", "left") \
        .join(cat_win.withColumnRenamed("category", "asked_category"), ["account_id", "asked_category"], "left")
    if top is not None:
        j = _with_note_texts(j.join(top, "question_id", "left"), notes)
    else:
        j = j.withColumn("note_id", F.lit(None).cast("string")).withColumn("note_text", F.lit(None).cast("string")) \
            .withColumn("note_type", F.lit(None).cast("string"))

    has_txns = F.col("last_date").isNotNull()
    start = F.coalesce(F.col("starting_balance").cast("double"), F.lit(0.0))
    net30 = F.col("net_window").cast("double")
    intent = F.col("intent")

    # runway (O10): forecast over 180 days from the question's balance
    last_balance = start + F.col("total_net").cast("double")
    step = fc._first_nonpositive_day(last_balance, F.col("mean_daily_net"), F.lit(RUNWAY_HORIZON).cast("long"))
    death = F.when(step.isNotNull(), F.date_add("last_date", step.cast("int")))
    runway_text = F.when(~has_txns, F.lit("No transactions available to compute runway.")) \
        .otherwise(fc.forecast_text(death, F.col("mean_daily_net"), F.col("mean_daily_burn"),
                                    F.lit(RUNWAY_HORIZON), today))

    # affordability
    amount = F.col("asked_amount")
    cushion = start - F.col("mean_daily_burn") * F.lit(30.0)
    afford_text = (
        F.when(~has_txns, F.lit("I don't have enough recent transactions to judge affordability."))
        .when(amount.isNull(), F.concat(
            F.lit("Your last-30-day net cashflow is "), money_text(net30),
            F.lit(". Anything meaningfully below that fits within recent headroom.")))
        .when(net30 <= 0, F.concat(
            F.lit("Not advisable: last-30-day net cashflow is "), money_text(net30),
            F.lit(" (negative). Covering "), money_text(amount), F.lit(" would deepen the burn.")))
        .when((amount > F.lit(0.5) * net30) & (amount > cushion), F.concat(
            F.lit("Risky: "), money_text(amount), F.lit(" is more than half of last-30-day net cashflow ("),
            money_text(net30), F.lit(") and larger than your one-month cushion ("), money_text(cushion),
            F.lit(" after expected burn).")))
        .otherwise(F.concat(
            F.lit("Yes, affordable: "), money_text(amount), F.lit(" fits within last-30-day net cashflow of "),
            money_text(net30), F.lit(" and leaves a one-month cushion of "), money_text(cushion), F.lit(".")))
    )

    # category spend
    cat = F.col("asked_category")
    spend_all = F.abs(F.coalesce(F.col("spend_window").cast("double"), F.lit(0.0)))
    spend_cat = F.abs(F.coalesce(F.col("cat_spend").cast("double"), F.lit(0.0)))
    has_cat_rows = F.coalesce(F.col("cat_rows"), F.lit(0)) > 0
    spend_text = (
        F.when(~has_txns, F.lit("I need categorized transactions to answer spend questions."))
        .when(cat.isNull(), F.concat(F.lit("Total spend in the last 30 days: "), money_text(spend_all), F.lit(".")))
        .when(~has_cat_rows, F.concat(F.lit("No transactions in category `"), cat,
                                      F.lit("` in the last 30 days.")))
        .otherwise(F.concat(F.lit("Spent "), money_text(spend_cat), F.lit(" on `"), cat, F.lit("` across "),
                            F.col("cat_rows").cast("string"), F.lit(" transactions in the last 30 days.")))
    )

    # general (O13)
    has_note = F.col("note_id").isNotNull()
    general_text = (
        F.when(has_note, F.concat(F.lit("Based on your business context ("), F.col("note_type"), F.lit("): "),
                                  F.col("note_text")))
        .when(~has_txns, F.lit("I don't have any transactions or notes to draw on yet."))
        .otherwise(F.concat(F.lit("Net cashflow across the loaded period is "),
                            money_text(F.col("total_net").cast("double")),
                            F.lit(". Ask me about spend by category, runway, or affordability.")))
    )

    answer = F.when(intent == "runway", runway_text).when(intent == "affordability", afford_text) \
        .when(intent == "category_spend", spend_text).otherwise(general_text)

    window_scope = F.when(has_txns, F.lit(SCOPE_WINDOW))
    scope = (
        F.when(intent.isin("runway", "affordability"), window_scope)
        .when(intent == "category_spend",
              F.when(~has_txns, F.lit(None))
              .when(cat.isNull(), F.lit(SCOPE_WINDOW_EXPENSES))
              .when(has_cat_rows, F.lit(SCOPE_WINDOW_CATEGORY)))
        .otherwise(F.when(has_note, F.lit(SCOPE_NOTE)).otherwise(window_scope))
    )
    n_cites = (
        F.when(scope == SCOPE_WINDOW, F.col("rows_window"))
        .when(scope == SCOPE_WINDOW_EXPENSES, F.col("expense_rows_window"))
        .when(scope == SCOPE_WINDOW_CATEGORY, F.col("cat_rows"))
        .when(scope == SCOPE_NOTE, F.lit(1))
        .otherwise(F.lit(0))
    ).cast("long")

    answers = j.select(
        "question_id", "account_id", "question", "intent", answer.alias("answer"),
        scope.alias("cite_scope"),
        F.when(scope == SCOPE_WINDOW_CATEGORY, cat).alias("cite_category"),
        n_cites.alias("n_citations"),
        F.when(scope == SCOPE_NOTE, F.col("note_id")).alias("note_id"),
        F.lit(RULES_BACKEND).alias("backend"),
    )
    return answers, hits


def _with_note_texts(rows: DataFrame, notes: DataFrame) -> DataFrame:
    """Text and type of the best note (``seq, note_id``) where a general
    question asks for it; other rows don't carry texts about, and are dealt by
    themselves, as they have no note to meet."""
    general = F.col("intent") == GENERAL_INTENT
    n = notes.select(F.col("seq").alias("_seq"), F.col("id").alias("_id"), F.col("text").alias("note_text"),
                     F.coalesce(F.element_at("metadata", F.lit("type")), F.lit("note")).alias("note_type"))
    met = rows.withColumn("_asks", F.when(general & F.col("note_id").isNotNull(), F.col("note_id"))
                          .otherwise(F.concat(F.lit("none "), F.coalesce(F.col("question_id").cast("string"), F.lit("")))))
    same = (F.col("_asks") == F.col("_id")) & (F.col("seq") == F.col("_seq")) & general
    return met.join(n, same, "left").drop("_asks", "seq", "_seq", "_id")


def answer_citations(answers: DataFrame, sets: DataFrame, first_n: int | None = None) -> DataFrame:
    """One row per (question, cited id), in input order.

    Transaction citations come from ``sets``; a note citation is the note id.
    ``first_n`` keeps the first n per question (the display limit of the
    answer printout); without it every citation is listed.
    """
    tx = answers.where(F.col("cite_scope").isin(SCOPE_WINDOW, SCOPE_WINDOW_EXPENSES, SCOPE_WINDOW_CATEGORY))
    s = sets
    if first_n is not None:
        w = Window.partitionBy("account_id", "scope", "category").orderBy("pos")
        s = s.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= first_n).drop("_n")
    a, c = tx.alias("a"), s.alias("c")
    cond = [F.col("a.account_id") == F.col("c.account_id"), F.col("a.cite_scope") == F.col("c.scope"),
            F.col("a.cite_category").eqNullSafe(F.col("c.category"))]
    joined = a.join(c, cond).select(F.col("a.question_id"), F.col("c.raw_hash").alias("cite_id"), F.col("c.pos"))
    notes = answers.where(F.col("cite_scope") == SCOPE_NOTE).select(
        "question_id", F.col("note_id").alias("cite_id"), F.lit(None).cast(joined.schema["pos"].dataType).alias("pos"))
    return joined.unionByName(notes)


def citation_integrity(sets: DataFrame, txns: DataFrame) -> DataFrame:
    """Citations of transactions that their ledger does not hold."""
    held = with_account(txns).select("account_id", "raw_hash")
    missing = with_account(sets).select("account_id", "raw_hash").join(held, ["account_id", "raw_hash"], "left_anti")
    return missing.agg(F.count(F.lit(1)).alias("missing_citations"))


CHUNK_IDS = 10_000


def citation_chunks(sets: DataFrame, size: int = CHUNK_IDS) -> DataFrame:
    """Each citation set once, in numbered chunks of about ``size`` ids:
    account_id, scope, category, chunk, ids (``pos``, ``id``, in input order).
    Rows are dealt to a set's chunks by hash, so a busy account is no one row."""
    key = ["account_id", "scope", "category"]
    n = sets.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / size).alias("_chunks")).select(*[F.col(c).alias(f"_{c}") for c in key], "_chunks")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key]
    dealt = sets.join(n, same).withColumn("chunk", F.pmod(F.xxhash64("raw_hash", "pos"), F.col("_chunks")))
    return dealt.groupBy(*key, "chunk").agg(F.sort_array(F.collect_list(F.struct("pos", F.col("raw_hash").alias("id")))).alias("ids"))


def answer_records(answers: DataFrame, hits: DataFrame | None) -> DataFrame:
    """JSON record per answer, of bounded size: as ``answers_json``, but the
    citations are named by their set (account, scope, category, to be found in
    ``citation_sets`` or ``citation_chunks``) or note, and counted."""
    citations = F.struct("account_id", F.col("cite_scope").alias("scope"), F.col("cite_category").alias("category"),
                         "note_id", F.col("n_citations").alias("count"))
    return _records(answers, hits, citations)


def answers_json(answers: DataFrame, hits: DataFrame | None, sets: DataFrame, first_n: int | None = None) -> DataFrame:
    """JSON record per answer (K4): question, answer, the citation set and the
    ids in it (all, or the first ``first_n`` for display), retrieved notes
    (scores rounded to 3 as Python rounds), intent, backend."""
    firsts = answer_citations(answers, sets, first_n=first_n) \
        .groupBy("question_id").agg(F.sort_array(F.collect_list(F.struct("pos", "cite_id"))).alias("_c"))
    citations = F.struct(F.col("cite_scope").alias("scope"), F.col("cite_category").alias("category"), F.col("n_citations").alias("count"),
                         F.transform(F.coalesce("_c", F.array()), lambda x: x["cite_id"]).alias("ids"))
    return _records(answers.join(firsts, "question_id", "left"), hits, citations)


def _records(a: DataFrame, hits: DataFrame | None, citations: Column) -> DataFrame:
    if hits is not None:
        h = hits.groupBy("question_id").agg(F.sort_array(F.collect_list(
            F.struct("rank", "id", py_round(F.col("score"), 3).alias("score"), "text"))).alias("_h"))
        a = a.join(h, "question_id", "left")
    else:
        a = a.withColumn("_h", F.lit(None).cast("array<struct<rank:int,id:string,score:double,text:string>>"))
    rec = F.struct(
        "question", "answer",
        citations.alias("citations"),
        F.transform(F.coalesce("_h", F.array()), lambda x: F.struct(x["id"].alias("id"), x["score"].alias("score"),
                                                                     x["text"].alias("text")))
        .alias("retrieved_notes"),
        "intent", "backend")
    return a.select("question_id", F.to_json(rec).alias("json"))
