"""Request/response batches for an external text model.

Re-aimed from the optional hosted-model path. The network call stays outside
Spark: these operators build the request bodies (with personal data masked)
and merge the model's answers back, so a job can write requests, let a
separate service answer them, and read the responses.

* Requests are per account, in batches of about ``batch_size`` rows: the
  number of batches per account follows its row count, and rows are spread
  over them by key, so a very busy account becomes many ordinary batches.
* A response is cleaned of Markdown code fences and parsed as a list of
  ``{index, category, confidence}``. A category outside the taxonomy becomes
  "Uncategorized", a missing confidence 0.5, a missing index -1; indexes
  outside the batch are ignored; a repeated index keeps the later item; rows
  the model skipped get ("Uncategorized", 0.0). A batch whose response is not
  one JSON list, with nothing behind it, falls back to the rules categorizer
  for all its rows.
"""

from __future__ import annotations

from functools import reduce
from operator import and_
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cashweave.functions.pii import mask_pii
from cashweave.functions.text import py_strip
from cashweave.operators.accounts import with_account
from cashweave.schema import TAX_CATEGORIES

MODEL_METHOD = "model"
RULES_METHOD = "rules"
DEFAULT_BATCH_SIZE = 100

REQUEST_PROMPT = (
    "You sort bookkeeping entries for a tax return. Allowed labels: {categories}. "
    "For every entry below give its number as \"index\", one allowed label as \"category\", and how sure you are, "
    "from 0 to 1, as \"confidence\". Answer with nothing but a JSON array of such objects."
)
# The numbers are read as they are written, so that a text, or what can't be a number, is noticed.
RESPONSE_TYPE = "array<array<struct<index:variant,category:string,confidence:variant>>>"
_INTEGER = r"^\s*[+-]?\d+\s*$"
_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def _keys(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def request_rows(txns: DataFrame, batch_size: int = DEFAULT_BATCH_SIZE, key: str | Sequence[str] = "row_ord") -> DataFrame:
    """(account_id, batch_id, index, <key>, description_masked, amount).

    ``key`` (one column or more) tells the rows of an account apart; with
    nulls, too. ``batch_id`` = hash(key) mod ceil(rows / batch_size) within the
    account (first 4 MD5 bytes of the key text, so batches are even whatever
    the key pattern); ``index`` = position in the batch by key (X21).
    """
    txns, keys = with_account(txns), _keys(key)
    counts = txns.groupBy("account_id").agg(F.count(F.lit(1)).alias("_n"))
    nb = F.greatest(F.lit(1), F.ceil(F.col("_n") / F.lit(batch_size))).cast("long")
    h = F.conv(F.substring(F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys])), 1, 8), 16, 10).cast("long")
    t = txns.join(counts, "account_id").withColumn("batch_id", F.pmod(h, nb))
    w = Window.partitionBy("account_id", "batch_id").orderBy(*keys)
    return t.select("account_id", "batch_id", (F.row_number().over(w) - 1).cast("long").alias("index"), *keys,
                    mask_pii("description").alias("description_masked"),
                    F.col("amount").cast("double").alias("amount"))


def request_bodies(rows: DataFrame) -> DataFrame:
    """(account_id, batch_id, n_rows, body): prompt + JSON list of rows."""
    prompt = REQUEST_PROMPT.format(categories=", ".join(TAX_CATEGORIES))
    g = rows.groupBy("account_id", "batch_id").agg(
        F.sort_array(F.collect_list(F.struct("index", F.col("description_masked").alias("description"),
                                             "amount"))).alias("items"))
    return g.select("account_id", "batch_id", F.size("items").alias("n_rows"),
                    F.concat(F.lit(prompt + "\n\nTransactions:\n"), F.to_json("items")).alias("body"))


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def _no_number(v: Column, pattern: str) -> Column:
    """Given, but neither a number, true or false, nor a text that spells one."""
    return v.isNotNull() & ~_kind(v).rlike("^(BIGINT|DECIMAL|DOUBLE|BOOLEAN)") & ~((_kind(v) == "STRING") & F.coalesce(_text(v).rlike(pattern), F.lit(False)))


def _number(v: Column) -> Column:
    return F.when(_kind(v) == "BOOLEAN", (_text(v) == "true").cast("double")).otherwise(F.trim(_text(v)).try_cast("double"))


def parse_response(text_col) -> Column:
    """Strip code fences (start or end of any line) and parse the list (X20):
    null unless the whole text is one JSON array of objects whose indexes and
    confidences, where given, are numbers, or texts that spell one (for an
    index, a whole one)."""
    cleaned = py_strip(F.regexp_replace(text_col, r"(?m)^```(?:json)?|```$", ""))
    # In brackets the text is exactly one value; with anything before or behind it, it is more or no JSON.
    held = F.from_json(F.concat(F.lit("["), cleaned, F.lit("]")), RESPONSE_TYPE)
    items = F.when(F.size(held) == 1, F.element_at(held, 1))
    bad = F.exists(items, lambda i: i.isNull() | _no_number(i["index"], _INTEGER) | _no_number(i["confidence"], _NUMBER))
    return F.when(~bad, items)


def merge_responses(rows: DataFrame, responses: DataFrame, rules: DataFrame, key: str | Sequence[str] = "row_ord") -> DataFrame:
    """(account_id, <key>, category, ai_confidence_score, method): one row per
    request row (O20, J5).

    ``responses``: (account_id, batch_id, response); ``rules``: the rules
    categorizer output (account_id, key, category, ai_confidence_score) for
    the batches without a usable response. ``key`` tells rows of a ledger
    apart; nulls in it are equal to each other.
    """
    keys = _keys(key)
    parsed = responses.select("account_id", "batch_id", parse_response(F.col("response")).alias("items"))
    ok = parsed.where(F.col("items").isNotNull())
    items = ok.select("account_id", "batch_id", F.posexplode("items").alias("pos", "it")).select(
        "account_id", "batch_id", "pos",
        F.coalesce(_number(F.col("it.index")).cast("long"), F.lit(-1)).alias("index"),
        F.when(F.col("it.category").isin(*TAX_CATEGORIES), F.col("it.category"))
        .otherwise(F.lit("Uncategorized")).alias("category"),
        F.coalesce(_number(F.col("it.confidence")), F.lit(0.5)).alias("confidence"))
    last = items.groupBy("account_id", "batch_id", "index").agg(
        F.max_by(F.struct("category", "confidence"), "pos").alias("v"))
    answered = ok.select("account_id", "batch_id").distinct().withColumn("_answered", F.lit(True))
    ruled = with_account(rules).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(["account_id", *keys])],
                                       F.col("category").alias("_rc"), F.col("ai_confidence_score").alias("_rs"))
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(["account_id", *keys])])
    r = rows.select("account_id", "batch_id", "index", *keys) \
        .join(answered, ["account_id", "batch_id"], "left") \
        .join(last, ["account_id", "batch_id", "index"], "left").join(ruled, same)
    model = F.col("_answered").isNotNull()
    return r.select(
        "account_id", *keys,
        F.when(~model, F.col("_rc")).otherwise(F.coalesce(F.col("v.category"), F.lit("Uncategorized")))
        .alias("category"),
        F.when(~model, F.col("_rs")).otherwise(F.coalesce(F.col("v.confidence"), F.lit(0.0)))
        .alias("ai_confidence_score"),
        F.when(~model, F.lit(RULES_METHOD)).otherwise(F.lit(MODEL_METHOD)).alias("method"),
    )


def with_responses(txns: DataFrame, responses: DataFrame, key: str | Sequence[str] = "raw_hash",
                   batch_size: int = DEFAULT_BATCH_SIZE) -> DataFrame:
    """The categorized table with the responses' categories and scores in
    place of its own; every row of ``txns`` comes out once (H5)."""
    keyed, keys = with_account(txns), _keys(key)
    names = ["account_id", *keys]
    merged = merge_responses(request_rows(keyed, batch_size, keys), responses, keyed, keys) \
        .select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(names)], F.col("category").alias("_c"), F.col("ai_confidence_score").alias("_s"))
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(names)])
    new = {"category": F.col("_c").alias("category"), "ai_confidence_score": F.col("_s").alias("ai_confidence_score")}
    return keyed.join(merged, same).select(*[new.get(c, F.col(c)) for c in keyed.columns])


REWRITE_PROMPT = (
    "Below are a customer's question, a computed answer and the customer's notes. Put the answer into plain, "
    "friendly language. Every figure must stay as it is; claim nothing that the answer or the notes don't say.\n\n"
)


def rewrite_context(answers: DataFrame, hits: DataFrame | None, notes: DataFrame | None = None) -> DataFrame:
    """(question_id, prompt): question, draft answer and the masked retrieved
    notes, one "- [id] text" line each, "(none)" without notes (O21).

    With the ``notes`` that were searched, each note found is masked once and
    each list of notes written once, however many questions have them; hits
    then bring their (``rank, seq, id``) only, and no texts."""
    if hits is not None and notes is not None:
        a, ctx = _with_contexts(answers, hits, notes), F.coalesce("_ctx", F.lit("(none)"))
    elif hits is not None:
        lines = hits.groupBy("question_id").agg(F.sort_array(F.collect_list(F.struct("rank", _line().alias("line")))).alias("_l"))
        a = answers.join(lines, "question_id", "left")
        ctx = F.when(F.size(F.coalesce("_l", F.array())) > 0,
                     F.array_join(F.transform("_l", lambda x: x["line"]), "\n")).otherwise(F.lit("(none)"))
    else:
        a, ctx = answers, F.lit("(none)")
    prompt = F.concat(F.lit(REWRITE_PROMPT), F.lit("Question: "), F.col("question"), F.lit("\nDraft: "),
                      F.col("answer"), F.lit("\nContext notes:\n"), ctx, F.lit("\n\nRewritten answer:"))
    return a.select("question_id", prompt.alias("prompt"))


def _line() -> Column:
    return F.concat(F.lit("- ["), F.col("id"), F.lit("] "), mask_pii("text"))


def _with_contexts(answers: DataFrame, hits: DataFrame, notes: DataFrame) -> DataFrame:
    """``answers`` with ``_ctx``, the lines of their notes; null without notes."""
    lists = hits.groupBy("question_id").agg(F.sort_array(F.collect_list(F.struct("rank", "seq", "id"))).alias("_l"))
    listed = lists.select("_l").distinct().select("_l", F.posexplode("_l").alias("pos", "hit")) \
        .select("_l", "pos", F.col("hit.seq").alias("seq"), F.col("hit.id").alias("id"))
    found = listed.select(F.col("seq").alias("_seq"), F.col("id").alias("_id")).distinct()
    masked = notes.join(found, (F.col("seq") == F.col("_seq")) & (F.col("id") == F.col("_id"))) \
        .select("_seq", "_id", _line().alias("line")).dropDuplicates(["_seq", "_id"])
    written = listed.join(masked, (F.col("seq") == F.col("_seq")) & (F.col("id") == F.col("_id"))).groupBy("_l").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("_ctx"))
    return answers.join(lists, "question_id", "left").join(written, "_l", "left")
