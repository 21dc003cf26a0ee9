"""Registered queries: one Spark plan and one DuckDB oracle per operator.

Each query reads the driver tables under ``sf_dir`` (or views Spark derives
from them) in full. Money leaves as DECIMAL(18,2); doubles are rounded so the
two engines' summation orders cannot show through.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cashweave.operators import categorize as cat_ops
from cashweave.operators import dedup as dedup_ops
from cashweave.operators import forecast as fc_ops
from cashweave.operators.normalize import normalize
from cashweave.plans import sqlparts as sq
from cashweave.schema import TAX_CATEGORIES
from cashweave.sources.ledgers import (
    CUSTOMER_BALANCES_SQL, EVENTS_LEDGER_SQL, ORDERS_LEDGER_SQL, customer_balances,
    events_ledger, orders_ledger, table,
)

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}

AS_OF = "2001-08-01"  # fixed "today" for runway texts over the orders ledger
EVENTS_AS_OF = "2024-02-01"
MONEY = "decimal(18,2)"


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def canonical_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders ledger through the canonical normaliser (typed input)."""
    return normalize(orders_ledger(spark, sf_dir), source="orders", keep=("account_id", "row_ord"))


def categorized_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cat_ops.categorize(canonical_orders(spark, sf_dir))


# ---------------------------------------------------------------------------
# Ingest: coercion, mapping, hashing, dedup
# ---------------------------------------------------------------------------

def _amount_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order prices rendered the ways bank exports write money."""
    o = table(spark, sf_dir, "orders")
    p = F.col("o_totalprice").cast(MONEY)
    k = F.pmod(F.col("o_orderkey"), F.lit(8))
    raw = (F.when(k == 0, p.cast("string"))
           .when(k == 1, F.concat(F.lit("$"), F.format_number(p, 2)))
           .when(k == 2, F.concat(F.lit("("), F.format_number(p, 2), F.lit(")")))
           .when(k == 3, F.concat(F.lit("€"), p.cast("string")))
           .when(k == 4, F.lit("  "))
           .when(k == 5, F.lit("n/a"))
           .when(k == 6, F.concat(F.lit("-"), p.cast("string")))
           .otherwise(F.concat(F.lit("  £ "), F.format_number(p, 2), F.lit(" "))))
    return o.select(F.col("o_orderkey"), raw.alias("raw_amount"))


AMOUNT_TEXT_SQL = """
SELECT o_orderkey,
  CASE o_orderkey % 8
    WHEN 0 THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR)
    WHEN 1 THEN '$' || format('{:,.2f}', CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE))
    WHEN 2 THEN '(' || format('{:,.2f}', CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE)) || ')'
    WHEN 3 THEN '€' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR)
    WHEN 4 THEN '  '
    WHEN 5 THEN 'n/a'
    WHEN 6 THEN '-' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR)
    ELSE '  £ ' || format('{:,.2f}', CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE)) || ' '
  END AS raw_amount
FROM orders
"""


@register("amount_coercion", f"""
SELECT o_orderkey, raw_amount, CAST({sq.coerce_amount('raw_amount')} AS DECIMAL(18,2)) AS amount
FROM ({AMOUNT_TEXT_SQL}) t
""")
def q_amount_coercion(spark, sf_dir):
    from cashweave.functions.amounts import coerce_amount
    t = _amount_text(spark, sf_dir)
    return t.select("o_orderkey", "raw_amount", coerce_amount("raw_amount").cast(MONEY).alias("amount"))


# The shapes bank exports write dates in: (Spark pattern, strftime pattern).
DATE_SHAPES: tuple[tuple[str, str], ...] = (
    ("yyyy-MM-dd", "%Y-%m-%d"), ("MM/dd/yyyy", "%m/%d/%Y"), ("M/d/yyyy", "%-m/%-d/%Y"),
    ("yyyy-MM-dd HH:mm:ss", "%Y-%m-%d %H:%M:%S"), ("yyyy-MM-dd'T'HH:mm:ss'Z'", "%Y-%m-%dT%H:%M:%SZ"),
    ("yyyy-MM-dd'T'HH:mm:ss'.000Z'", "%Y-%m-%dT%H:%M:%S.000Z"), ("yyyy-MM-dd'T'HH:mm:ss'+00:00'", "%Y-%m-%dT%H:%M:%S+00:00"),
    ("yyyy-MM-dd HH:mm:ss'.123'", "%Y-%m-%d %H:%M:%S.123"), ("yyyyMMdd", "%Y%m%d"), ("dd-MMM-yyyy", "%d-%b-%Y"),
    ("MMM d yyyy", "%b %-d %Y"), ("MMMM d, yyyy", "%B %-d, %Y"), ("d MMMM yyyy", "%-d %B %Y"),
    ("MM/dd/yyyy '10:15 AM'", "%m/%d/%Y 10:15 AM"), ("MM/dd/yyyy '10:15:00 PM'", "%m/%d/%Y 10:15:00 PM"),
    ("MM/dd/yy", "%m/%d/%y"), ("yyyy/M/d", "%Y/%-m/%-d"), ("'not a date' yyyy", "not a date %Y"), ("'13/45/'yyyy", "13/45/%Y"),
)
BAD_SHAPES = (len(DATE_SHAPES) - 2, len(DATE_SHAPES) - 1)


def _date_text(day, key):
    k = F.pmod(key, F.lit(len(DATE_SHAPES)))
    out = F.lit(None).cast("string")
    for i, (pattern, _) in enumerate(DATE_SHAPES):
        out = F.when(k == i, F.date_format(day, pattern)).otherwise(out)
    return out


def _date_text_sql(day: str, key: str) -> str:
    return f"CASE {key} % {len(DATE_SHAPES)} " + " ".join(
        f"WHEN {i} THEN strftime({day}, '{p}')" for i, (_, p) in enumerate(DATE_SHAPES)) + " END"


def _read_date_sql(day: str, key: str) -> str:
    return f"CASE WHEN {key} % {len(DATE_SHAPES)} IN {BAD_SHAPES} THEN NULL ELSE CAST({day} AS DATE) END"


@register("date_coercion", f"""
SELECT o_orderkey, {_date_text_sql('o_orderdate', 'o_orderkey')} AS raw_date,
       {_read_date_sql('o_orderdate', 'o_orderkey')} AS transaction_date
FROM orders
""")
def q_date_coercion(spark, sf_dir):
    from cashweave.functions.dates import coerce_date
    o = table(spark, sf_dir, "orders")
    t = o.select("o_orderkey", _date_text(F.col("o_orderdate"), F.col("o_orderkey")).alias("raw_date"))
    return t.select("o_orderkey", "raw_date", coerce_date("raw_date").alias("transaction_date"))


def _bank_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders ledger rendered as a checking-account export with bank
    headers, dates in all shapes, split debit/credit text and padded
    descriptions; some rows have no date, no amount or no description (one
    scan of ``orders``)."""
    from cashweave.sources.ledgers import merchant_for
    o = table(spark, sf_dir, "orders")
    mag = F.col("o_totalprice").cast(MONEY).cast("string")
    status = F.col("o_orderstatus")
    desc = F.concat(merchant_for(F.col("o_orderkey")), F.lit(" #"), F.col("o_orderkey").cast("string"))
    return o.select(
        F.col("o_custkey").alias("Account"),
        F.col("o_orderkey").alias("Ref"),
        _date_text(F.col("o_orderdate"), F.col("o_orderkey")).alias("Posting Date"),
        F.when(F.col("o_orderkey") % 11 == 3, F.lit("   ")).otherwise(F.concat(F.lit("  "), desc, F.lit(" "))).alias("Payee"),
        F.when((status != "F") & (F.col("o_orderkey") % 13 != 5), mag).alias(" Withdrawal "),
        F.when((status != "O") & (F.col("o_orderkey") % 13 != 5), mag).alias("Deposit"),
    )


BANK_EXPORT_SQL = f"""
SELECT l.account_id AS "Account", l.row_ord AS "Ref", {_read_date_sql('l.transaction_date', 'l.row_ord')} AS read_date,
       CASE WHEN l.row_ord % 11 = 3 THEN '   ' ELSE '  ' || l.description || ' ' END AS "Payee",
       CASE WHEN o.o_orderstatus <> 'F' AND l.row_ord % 13 <> 5 THEN CAST(abs(l.amount) AS VARCHAR) END AS withdrawal,
       CASE WHEN o.o_orderstatus <> 'O' AND l.row_ord % 13 <> 5 THEN CAST(abs(l.amount) AS VARCHAR) END AS deposit
FROM ({ORDERS_LEDGER_SQL}) l JOIN orders o ON o.o_orderkey = l.row_ord
"""


@register("debit_credit_merge", f"""
SELECT "Account" AS account_id, "Ref" AS row_ord,
  CAST(CASE WHEN {sq.coerce_amount('withdrawal')} IS NOT NULL AND {sq.coerce_amount('withdrawal')} <> 0
              THEN -abs({sq.coerce_amount('withdrawal')})
            WHEN {sq.coerce_amount('deposit')} IS NOT NULL AND {sq.coerce_amount('deposit')} <> 0
              THEN abs({sq.coerce_amount('deposit')}) END AS DECIMAL(18,2)) AS amount
FROM ({BANK_EXPORT_SQL}) b
""")
def q_debit_credit_merge(spark, sf_dir):
    from cashweave.operators.normalize import merge_debit_credit, rename_columns
    m = merge_debit_credit(rename_columns(_bank_export(spark, sf_dir)))
    return m.select(F.col("Account").alias("account_id"), F.col("Ref").alias("row_ord"),
                    F.col("amount").cast(MONEY).alias("amount"))


NORMALIZED_SQL = f"""
WITH b AS ({BANK_EXPORT_SQL}),
n AS (
  SELECT "Account" AS account_id, "Ref" AS row_ord,
    read_date AS transaction_date,
    CASE WHEN {sq.coerce_amount('withdrawal')} IS NOT NULL AND {sq.coerce_amount('withdrawal')} <> 0
           THEN -abs({sq.coerce_amount('withdrawal')})
         WHEN {sq.coerce_amount('deposit')} IS NOT NULL AND {sq.coerce_amount('deposit')} <> 0
           THEN abs({sq.coerce_amount('deposit')}) END AS amount,
    {sq.strip('"Payee"')} AS description
  FROM b)
"""


@register("canonical_normalize", f"""
{NORMALIZED_SQL}
SELECT account_id, row_ord, transaction_date, CAST(amount AS DECIMAL(18,2)) AS amount, description,
       'checking' AS source, {sq.content_hash('transaction_date', 'amount', 'description')} AS raw_hash,
       CAST(NULL AS VARCHAR) AS category, CAST(NULL AS DOUBLE) AS ai_confidence_score
FROM n
WHERE transaction_date IS NOT NULL AND amount IS NOT NULL AND description IS NOT NULL AND description <> ''
""")
def q_canonical_normalize(spark, sf_dir):
    raw = _bank_export(spark, sf_dir).withColumnRenamed("Account", "account_id") \
        .withColumnRenamed("Ref", "row_ord")
    n = normalize(raw, source="checking", keep=("account_id", "row_ord"))
    return n.select("account_id", "row_ord", "transaction_date", F.col("amount").cast(MONEY).alias("amount"),
                    "description", "source", "raw_hash", "category", "ai_confidence_score")


EXPORT_KINDS = 5


def write_export_folder(spark: SparkSession, sf_dir: str) -> str:
    """The orders ledger as files of one folder, as banks would export it: CSV
    with debit and credit in either order and a repeated header, CSV with date
    and amount in either order, and JSON documents."""
    import uuid

    from cashweave.session import ensure_checkpoint_dir
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/exports-{uuid.uuid4().hex}"
    rows = orders_ledger(spark, sf_dir).withColumn("kind", F.pmod("row_ord", F.lit(EXPORT_KINDS)))
    money, account = F.abs("amount").cast(MONEY).cast("string"), F.col("account_id").alias("Account")
    day, note = F.date_format("transaction_date", "MM/dd/yyyy").alias("Date"), F.col("description").alias("Memo")
    debit, credit = F.when(F.col("amount") < 0, money).alias("Debit"), F.when(F.col("amount") >= 0, money).alias("Credit")
    signed, again = F.col("amount").cast(MONEY).cast("string").alias("Amount"), F.lit("repeated").alias(" Memo ")
    layouts = [[day, debit, credit, note, again, account], [day, credit, debit, note, again, account],
               [day, signed, note, account], [signed, account, day, note]]
    for kind, layout in enumerate(layouts):
        rows.where(F.col("kind") == kind).select(*layout).write.option("header", True).csv(f"{folder}/{kind}")
    item = F.struct(day.alias("Posting Date"), F.col("amount").cast(MONEY).alias("amt"), note.alias("payee"), account)
    rows.where(F.col("kind") == len(layouts)).groupBy(F.floor(F.col("row_ord") / 20_000).alias("part")) \
        .agg(F.collect_list(item).alias("transactions")).write.partitionBy("part").json(f"{folder}/json")
    return folder


@register("export_folder", f"""
SELECT CAST(account_id AS VARCHAR) AS account_id, CAST(transaction_date AS DATE) AS transaction_date, CAST(amount AS DECIMAL(18,2)) AS amount, description,
       {sq.content_hash('transaction_date', 'amount', 'description')} AS raw_hash
FROM ({ORDERS_LEDGER_SQL}) l
""")
def q_export_folder(spark, sf_dir):
    """Files of five layouts, written and read back, each by its own header."""
    from cashweave.sources.exports import read_exports
    rows = read_exports(spark, [write_export_folder(spark, sf_dir)], source="bank", account_col="Account")
    return rows.select("account_id", "transaction_date", F.col("amount").cast(MONEY).alias("amount"), "description", "raw_hash")


@register("ingest_rejects", f"""
{NORMALIZED_SQL}
SELECT account_id, row_ord, description,
       CASE WHEN transaction_date IS NULL THEN 'no date' WHEN amount IS NULL THEN 'no amount' ELSE 'no description' END AS reject_reason
FROM n WHERE transaction_date IS NULL OR amount IS NULL OR description IS NULL OR description = ''
""")
def q_ingest_rejects(spark, sf_dir):
    from cashweave.operators.normalize import normalize_all, rejects
    raw = _bank_export(spark, sf_dir).withColumnRenamed("Account", "account_id").withColumnRenamed("Ref", "row_ord")
    keep = ("account_id", "row_ord")
    return rejects(normalize_all(raw, "checking", keep=keep), keep).select("account_id", "row_ord", "description", "reject_reason")


@register("record_amounts", """
SELECT o_orderkey AS row_ord,
  CASE o_orderkey % 4 WHEN 0 THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR)
    WHEN 1 THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) || '05' WHEN 2 THEN '0.00' ELSE '-0.0000001' END AS record_text,
  CASE o_orderkey % 4 WHEN 0 THEN regexp_replace(CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR), '\\.?0+$', '')
    WHEN 1 THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) || '05' WHEN 2 THEN '0' ELSE '-0.0000001' END AS hash_text
FROM orders
""")
def q_record_amounts(spark, sf_dir):
    from cashweave.functions.amounts import canon_amount_text, coerce_amount, record_amount_text
    k, price = F.col("o_orderkey") % 4, F.col("o_totalprice").cast(MONEY).cast("string")
    raw = F.when(k == 0, price).when(k == 1, F.concat(price, F.lit("05"))).when(k == 2, F.lit("$0.000")).otherwise(F.lit("(0.0000001)"))
    t = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_ord"), raw.alias("raw")) \
        .withColumn("amount", coerce_amount("raw"))
    return t.select("row_ord", record_amount_text("amount").alias("record_text"), canon_amount_text("amount").alias("hash_text"))


@register("percent_text", """
SELECT o_orderkey, format('{:.0f}%', CAST(o_orderkey % 1001 AS DOUBLE) / 1000 * 100) AS percent FROM orders
""")
def q_percent_text(spark, sf_dir):
    from cashweave.functions.amounts import percent_text
    share = (F.col("o_orderkey") % 1001).cast("double") / 1000
    return table(spark, sf_dir, "orders").select("o_orderkey", percent_text(share).alias("percent"))


@register("content_hash", f"""
SELECT row_ord, {sq.content_hash('transaction_date', 'amount', 'description')} AS raw_hash,
       {sq.content_hash('transaction_date', 'amount', "'  ' || upper(replace(description, ' ', '   ')) || chr(9)")} AS variant_hash
FROM ({ORDERS_LEDGER_SQL}) l
""")
def q_content_hash(spark, sf_dir):
    from cashweave.functions.hashing import content_hash
    lg = orders_ledger(spark, sf_dir)
    variant = F.concat(F.lit("  "), F.upper(F.regexp_replace("description", " ", "   ")), F.lit("\t"))
    return lg.select("row_ord", content_hash("transaction_date", "amount", "description").alias("raw_hash"),
                     content_hash("transaction_date", F.col("amount").cast("decimal(20,4)"), variant)
                     .alias("variant_hash"))


def _dedup_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders ledger twice: the original, then a re-cased, re-spaced copy
    whose low-priority orders moved one day (so those are not duplicates)."""
    from cashweave.sources.ledgers import merchant_for
    o = table(spark, sf_dir, "orders")
    price = F.col("o_totalprice").cast(MONEY)
    base = o.select(
        F.col("o_custkey").alias("account_id"),
        F.to_date("o_orderdate").alias("transaction_date"),
        F.when(F.col("o_orderstatus") == "F", price).otherwise(-price).alias("amount"),
        F.concat(merchant_for(F.col("o_orderkey")), F.lit(" #"), F.col("o_orderkey").cast("string"))
        .alias("description"),
        F.col("o_orderkey").alias("row_ord"),
        "o_orderpriority")
    copy = base.select(
        "account_id",
        F.when(F.col("o_orderpriority") == "5-LOW", F.date_add("transaction_date", 1))
        .otherwise(F.col("transaction_date")).alias("transaction_date"),
        "amount",
        F.concat(F.lit(" "), F.lower(F.regexp_replace("description", " ", "  ")), F.lit("  "))
        .alias("description"),
        "row_ord")
    first = normalize(base.drop("o_orderpriority"), source="orders", keep=("account_id", "row_ord")) \
        .withColumn("file_ord", F.lit(0))
    second = normalize(copy, source="orders_copy", keep=("account_id", "row_ord")).withColumn("file_ord", F.lit(1))
    # the same transactions in another ledger are no duplicates
    other = first.where(F.col("row_ord") % 4 == 0).withColumn("account_id", F.col("account_id") + 10 ** 9) \
        .withColumn("file_ord", F.lit(2))
    return dedup_ops.union_sources([first, second, other])


DEDUP_INPUT_SQL = f"""
WITH l AS ({ORDERS_LEDGER_SQL}),
c AS (
  SELECT l.account_id,
         CASE WHEN o.o_orderpriority = '5-LOW' THEN l.transaction_date + 1 ELSE l.transaction_date END
           AS transaction_date,
         l.amount, ' ' || lower(replace(l.description, ' ', '  ')) || '  ' AS description, l.row_ord
  FROM l JOIN orders o ON o.o_orderkey = l.row_ord),
u AS (
  SELECT account_id, transaction_date, amount, description, row_ord, 'orders' AS source, 0 AS file_ord FROM l
  UNION ALL
  SELECT account_id, transaction_date, amount, {sq.strip('description')}, row_ord, 'orders_copy', 1 FROM c
  UNION ALL
  SELECT account_id + 1000000000, transaction_date, amount, description, row_ord, 'orders', 2 FROM l WHERE row_ord % 4 = 0)
SELECT *, {sq.content_hash('transaction_date', 'amount', 'description')} AS raw_hash FROM u
"""


@register("dedup_keep_first", f"""
SELECT account_id, row_ord, source, raw_hash, transaction_date, CAST(amount AS DECIMAL(18,2)) AS amount,
       description
FROM (SELECT *, row_number() OVER (PARTITION BY account_id, raw_hash ORDER BY file_ord, row_ord) AS rn
      FROM ({DEDUP_INPUT_SQL}) u) r
WHERE rn = 1
""")
def q_dedup_keep_first(spark, sf_dir):
    d = dedup_ops.deduplicate(_dedup_input(spark, sf_dir), order_by=["file_ord", "row_ord"])
    return d.select("account_id", "row_ord", "source", "raw_hash", "transaction_date",
                    F.col("amount").cast(MONEY).alias("amount"), "description")


@register("dedup_counts", f"""
SELECT CAST(sum(n) AS BIGINT) AS rows_before, CAST(sum(n - 1) AS BIGINT) AS duplicates_removed, count(*) AS rows_after
FROM (SELECT account_id, raw_hash, count(*) AS n FROM ({DEDUP_INPUT_SQL}) u GROUP BY 1, 2) g
""")
def q_dedup_counts(spark, sf_dir):
    return dedup_ops.duplicate_count(_dedup_input(spark, sf_dir))


STORED_BATCHES = 3


@register("dedup_against_stored", f"""
WITH l AS (SELECT account_id, row_ord, {sq.content_hash('transaction_date', 'amount', "'part ' || CAST(row_ord // 4 AS VARCHAR)")} AS raw_hash,
                  unnest(CASE WHEN row_ord % 4 = 0 THEN [0, 1, 2] WHEN row_ord % 4 = 1 THEN [1, 2] ELSE [row_ord % 4 - 2, 2] END) AS batch
           FROM ({ORDERS_LEDGER_SQL}) o),
f AS (SELECT *, row_number() OVER (PARTITION BY account_id, raw_hash ORDER BY batch, row_ord) AS rn FROM l)
SELECT CAST(account_id AS VARCHAR) AS account_id, raw_hash, row_ord, CAST(batch AS BIGINT) AS batch FROM f WHERE rn = 1
""")
def q_dedup_against_stored(spark, sf_dir):
    """Overlapping batches of the orders ledger appended one after another to a
    stored table; each row is kept in the first batch that has it."""
    import uuid

    from cashweave.operators.ledger_store import LedgerStore
    from cashweave.session import ensure_checkpoint_dir
    store = LedgerStore(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/ledger-{uuid.uuid4().hex}", buckets=8)
    raw = orders_ledger(spark, sf_dir).withColumn("description", F.concat(F.lit("part "), F.floor(F.col("row_ord") / 4).cast("string")))
    rows = normalize(raw, source="orders", keep=("account_id", "row_ord"))
    kind, third = F.pmod("row_ord", F.lit(4)), F.lit(STORED_BATCHES - 1)
    batches = F.when(kind == 0, F.array(F.lit(0), F.lit(1), third)).when(kind == 1, F.array(F.lit(1), third)) \
        .otherwise(F.array((kind - 2).cast("int"), third))
    for b in range(STORED_BATCHES):
        store.append(rows.where(F.array_contains(batches, b)), ["row_ord"])
    return store.read().select(F.col("account_id").cast("string").alias("account_id"), "raw_hash", "row_ord", "batch")


# ---------------------------------------------------------------------------
# Categorizer
# ---------------------------------------------------------------------------

@register("categorize", f"""
WITH l AS ({ORDERS_LEDGER_SQL}), {sq.categorize_cte('l')}
SELECT l.account_id, l.row_ord, c.category, c.confidence AS ai_confidence_score, c.rationale
FROM l JOIN cat c ON c.k = l.row_ord
""")
def q_categorize(spark, sf_dir):
    c = cat_ops.categorize(canonical_orders(spark, sf_dir), with_rationale=True)
    return c.select("account_id", "row_ord", "category", "ai_confidence_score", "rationale")


def _exact_rounding(sql: str) -> str:
    """Rounds confidences by their exact binary value, as the operator does."""
    return sql.replace("round(least(", "CAST(format('{:.3f}', least(").replace("CAST(0.4 AS DOUBLE)), 3)", "CAST(0.4 AS DOUBLE))) AS DOUBLE)")


_CATEGORY_LIST = ", ".join(f"'{c}'" for c in TAX_CATEGORIES)


@register("categorize_lexicon_table", f"""
WITH l AS ({ORDERS_LEDGER_SQL}),
lexicon AS (SELECT * FROM {sq.lexicon_values()}
  UNION ALL SELECT 1000 + c_custkey, '#' || c_custkey, list_extract([{_CATEGORY_LIST}], c_nationkey % {len(TAX_CATEGORIES)} + 1) FROM customer),
{_exact_rounding(sq.categorize_cte('l').replace(sq.lexicon_values(), 'lexicon x'))}
SELECT l.account_id, l.row_ord, c.category, c.confidence AS ai_confidence_score, c.rationale
FROM l JOIN cat c ON c.k = l.row_ord
""")
def q_categorize_lexicon_table(spark, sf_dir):
    """The default keywords and one for each customer, as a table; most
    keywords of the table hold others ("#12" holds "#1")."""
    from cashweave.schema import KEYWORD_LEXICON
    names = F.array(*[F.lit(c) for c in TAX_CATEGORIES])
    own = table(spark, sf_dir, "customer").select(
        (F.lit(1000) + F.col("c_custkey")).alias("ord"), F.concat(F.lit("#"), F.col("c_custkey").cast("string")).alias("keyword"),
        F.element_at(names, F.pmod(F.col("c_nationkey"), F.lit(len(TAX_CATEGORIES))).cast("int") + 1).alias("category"))
    default = spark.createDataFrame([(i, k, c) for i, (k, c) in enumerate(KEYWORD_LEXICON)], "ord long, keyword string, category string")
    c = cat_ops.categorize(canonical_orders(spark, sf_dir), lexicon=default.unionByName(own), with_rationale=True)
    return c.select("account_id", "row_ord", "category", "ai_confidence_score", "rationale")


@register("category_counts", f"""
WITH l AS ({ORDERS_LEDGER_SQL}), {sq.categorize_cte('l')}
SELECT category, count(*) AS n_transactions, CAST(sum(l.amount) AS DECIMAL(18,2)) AS total_amount
FROM l JOIN cat c ON c.k = l.row_ord GROUP BY category
""")
def q_category_counts(spark, sf_dir):
    c = categorized_orders(spark, sf_dir)
    return c.groupBy("category").agg(F.count(F.lit(1)).alias("n_transactions"),
                                     F.sum("amount").cast(MONEY).alias("total_amount"))


# ---------------------------------------------------------------------------
# Daily series and forecasts
# ---------------------------------------------------------------------------

@register("daily_net", f"""
SELECT account_id, transaction_date AS date, CAST(sum(amount) AS DECIMAL(18,2)) AS net
FROM ({EVENTS_LEDGER_SQL}) l GROUP BY 1, 2
""")
def q_daily_net(spark, sf_dir):
    d = fc_ops.daily_net(events_ledger(spark, sf_dir))
    return d.select("account_id", "date", F.col("net").cast(MONEY).alias("net"))


DAILY_FILLED_SQL = f"""
WITH l AS ({EVENTS_LEDGER_SQL}),
d AS (SELECT account_id, transaction_date AS date, sum(amount) AS net FROM l GROUP BY 1, 2),
b AS (SELECT account_id, min(date) AS d0, max(date) AS d1 FROM d GROUP BY 1),
s AS (SELECT account_id, CAST(unnest(generate_series(d0, d1, INTERVAL 1 DAY)) AS DATE) AS date FROM b)
SELECT s.account_id, s.date, CAST(coalesce(d.net, 0) AS DECIMAL(18,2)) AS net
FROM s LEFT JOIN d ON d.account_id = s.account_id AND d.date = s.date
"""


@register("daily_series_filled", DAILY_FILLED_SQL)
def q_daily_series_filled(spark, sf_dir):
    d = fc_ops.daily_series(events_ledger(spark, sf_dir))
    return d.select("account_id", "date", F.col("net").cast(MONEY).alias("net"))


@register("running_balance", f"""
WITH f AS ({DAILY_FILLED_SQL}), sb AS ({CUSTOMER_BALANCES_SQL})
SELECT f.account_id, f.date, f.net,
       round(coalesce(sb.starting_balance, 0) + sum(CAST(f.net AS DOUBLE)) OVER
             (PARTITION BY f.account_id ORDER BY f.date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6)
         AS balance
FROM f LEFT JOIN sb ON sb.account_id = f.account_id
""")
def q_running_balance(spark, sf_dir):
    d = fc_ops.daily_series(events_ledger(spark, sf_dir))
    rb = fc_ops.running_balance(d, customer_balances(spark, sf_dir))
    return rb.select("account_id", "date", F.col("net").cast(MONEY).alias("net"),
                     F.round("balance", 6).alias("balance"))


def _forecast_sql(horizon: int, as_of: str, ledger_sql: str = ORDERS_LEDGER_SQL) -> str:
    return f"""
WITH l AS ({ledger_sql}),
d AS (SELECT account_id, transaction_date AS date, sum(amount) AS net FROM l GROUP BY 1, 2),
st AS (SELECT account_id, min(date) AS first_date, max(date) AS last_date, sum(net) AS total_net,
              CAST(sum(CASE WHEN net < 0 THEN net END) AS DOUBLE) / count(CASE WHEN net < 0 THEN 1 END)
                AS neg_mean
       FROM d GROUP BY 1),
sb AS ({CUSTOMER_BALANCES_SQL}),
j AS (
  SELECT coalesce(st.account_id, sb.account_id) AS account_id,
         coalesce(sb.starting_balance, 0) AS starting_balance,
         st.last_date,
         CASE WHEN st.last_date IS NULL THEN 0
              ELSE CAST(st.total_net AS DOUBLE) / (date_diff('day', st.first_date, st.last_date) + 1) END
           AS mean_daily_net,
         CASE WHEN st.last_date IS NULL THEN 0 ELSE coalesce(-st.neg_mean, 0) END AS mean_daily_burn,
         coalesce(sb.starting_balance, 0) + coalesce(CAST(st.total_net AS DOUBLE), 0) AS last_balance
  FROM st FULL OUTER JOIN sb ON sb.account_id = st.account_id),
p AS (
  SELECT j.account_id, min(i.i) AS step
  FROM j JOIN (SELECT unnest(generate_series(1, {horizon})) AS i) i
    ON j.last_balance + j.mean_daily_net * i.i <= 0
  WHERE j.last_date IS NOT NULL
  GROUP BY 1),
r AS (
  SELECT j.*, CASE WHEN p.step IS NOT NULL THEN CAST(j.last_date + CAST(p.step AS INTEGER) AS DATE) END
           AS death_date
  FROM j LEFT JOIN p ON p.account_id = j.account_id)
SELECT account_id, starting_balance, mean_daily_net, mean_daily_burn, last_balance, last_date, death_date,
       {horizon} AS horizon_days, 'linear' AS backend,
       CASE WHEN death_date IS NULL THEN
              'Cash-flow positive: avg daily net ' || {sq.money('mean_daily_net')} ||
              '. No runway risk in the next {horizon} days.'
            ELSE 'Projected runway: ' || CAST(date_diff('day', DATE '{as_of}', death_date) AS VARCHAR) ||
              ' days. Balance hits $0 on ' || strftime(death_date, '%Y-%m-%d') ||
              ' at avg daily burn ' || {sq.money('mean_daily_burn')} || '.' END AS summary
FROM r
"""


def _forecast_select(alias: str = "") -> str:
    # the doubles come from the same IEEE operations on exact decimal sums in
    # both engines, so they are compared unrounded
    return ("account_id, starting_balance, mean_daily_net, mean_daily_burn, last_balance, last_date, "
            "death_date, horizon_days, backend, summary")


@register("forecast_summary", f"SELECT {_forecast_select()} FROM ({_forecast_sql(90, AS_OF)}) f")
def q_forecast_summary(spark, sf_dir):
    s = fc_ops.forecast_summary(canonical_orders(spark, sf_dir), customer_balances(spark, sf_dir),
                                horizon_days=90, as_of=AS_OF)
    return s.select("account_id", "starting_balance", "mean_daily_net", "mean_daily_burn", "last_balance",
                    "last_date", "death_date", "horizon_days", "backend", "summary")


@register("runout_date", f"""
SELECT account_id, death_date FROM ({_forecast_sql(180, AS_OF)}) f WHERE death_date IS NOT NULL
""")
def q_runout_date(spark, sf_dir):
    s = fc_ops.forecast_summary(canonical_orders(spark, sf_dir), customer_balances(spark, sf_dir),
                                horizon_days=180, as_of=AS_OF)
    return s.where(F.col("death_date").isNotNull()).select("account_id", "death_date")


@register("forecast_projection", f"""
WITH f AS ({_forecast_sql(90, AS_OF)})
SELECT account_id, i AS day_no, CAST(last_date + CAST(i AS INTEGER) AS DATE) AS date,
       last_balance + mean_daily_net * i AS projected_balance
FROM f, (SELECT unnest(generate_series(1, 90)) AS i) g
WHERE last_date IS NOT NULL
""")
def q_forecast_projection(spark, sf_dir):
    s = fc_ops.forecast_summary(canonical_orders(spark, sf_dir), customer_balances(spark, sf_dir),
                                horizon_days=90, as_of=AS_OF)
    p = fc_ops.forecast_projection(s)
    return p.select("account_id", F.col("day_no").cast("long").alias("day_no"), "date",
                    "projected_balance")


# ---------------------------------------------------------------------------
# Personal data
# ---------------------------------------------------------------------------

@register("pii_mask_documents", f"SELECT doc_id, {sq.pii_mask('text')} AS text_masked FROM documents")
def q_pii_mask_documents(spark, sf_dir):
    from cashweave.functions.pii import mask_pii
    return table(spark, sf_dir, "documents").select("doc_id", mask_pii("text").alias("text_masked"))


@register("pii_mask_conversations",
          f"SELECT conv_id, turn, {sq.pii_mask('text')} AS text_masked FROM conversations")
def q_pii_mask_conversations(spark, sf_dir):
    from cashweave.functions.pii import mask_pii
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", mask_pii("text").alias("text_masked"))


@register("masked_descriptions", f"""
SELECT row_ord, description, {sq.pii_mask('description')} AS description_masked FROM ({ORDERS_LEDGER_SQL}) l
""")
def q_masked_descriptions(spark, sf_dir):
    from cashweave.functions.pii import mask_pii
    c = canonical_orders(spark, sf_dir)
    return c.select("row_ord", "description", mask_pii("description").alias("description_masked"))


# ---------------------------------------------------------------------------
# Notes: embedding, upsert, search
# ---------------------------------------------------------------------------

@register("hash_embedding", f"""
WITH c AS ({sq.token_counts('documents', 'doc_id', 'text')}),
n AS (SELECT k, sum(cnt * cnt) AS sumsq FROM c GROUP BY 1)
SELECT c.k AS doc_id, CAST(c.bucket AS INTEGER) AS bucket, c.cnt AS count,
       CAST(c.cnt AS DOUBLE) / sqrt(CAST(n.sumsq AS DOUBLE)) AS weight
FROM c JOIN n ON n.k = c.k
""")
def q_hash_embedding(spark, sf_dir):
    from cashweave.functions.embeddings import with_embedding
    e = with_embedding(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "emb", 256)
    z = e.select("doc_id", F.col("emb.sumsq").alias("sumsq"),
                 F.posexplode(F.arrays_zip(F.col("emb.idx").alias("b"), F.col("emb.cnt").alias("c"))))
    return z.select("doc_id", F.col("col.b").alias("bucket"), F.col("col.c").alias("count"),
                    (F.col("col.c").cast("double") / F.sqrt(F.col("sumsq").cast("double"))).alias("weight"))


def document_notes(spark: SparkSession, sf_dir: str, dim: int = 256) -> DataFrame:
    """Documents upserted into an empty note store in doc_id order; the id is
    the stable text hash, so exact copies collapse to the later document."""
    from cashweave.operators.notes import prepare_notes, upsert_notes
    d = table(spark, sf_dir, "documents")
    meta = F.create_map(F.lit("type"), F.col("source"), F.lit("lang"), F.col("lang"),
                        F.lit("doc_id"), F.col("doc_id").cast("string"))
    accepted, _ = prepare_notes(d, text="text", metadata=meta, order_by="doc_id", dim=dim)
    return upsert_notes(None, accepted)


NOTES_SQL = """
SELECT id, doc_id AS seq, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text, source, lang, doc_id,
       text AS raw_text
FROM (SELECT substr(sha1(text), 1, 16) AS id, *,
             row_number() OVER (PARTITION BY substr(sha1(text), 1, 16) ORDER BY doc_id DESC) AS rn
      FROM documents WHERE text IS NOT NULL AND regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> '') d
WHERE rn = 1
"""


@register("note_upsert", f"""
SELECT id, seq, CAST(doc_id AS VARCHAR) AS doc_id, source AS type, length(text) AS text_len FROM ({NOTES_SQL}) n
""")
def q_note_upsert(spark, sf_dir):
    n = document_notes(spark, sf_dir)
    return n.select("id", "seq", F.col("metadata")["doc_id"].alias("doc_id"),
                    F.col("metadata")["type"].alias("type"), F.length("text").cast("long").alias("text_len"))


NOTE_BATCHES = 5


@register("note_store_replace", f"""
WITH d AS (SELECT 'note-' || CAST(doc_id // 7 AS VARCHAR) AS id, doc_id % {NOTE_BATCHES} AS batch, doc_id, source, text,
                  row_number() OVER (PARTITION BY doc_id // 7 ORDER BY doc_id % {NOTE_BATCHES} DESC, doc_id DESC) AS rn
           FROM documents WHERE text IS NOT NULL AND regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> ''),
w AS (SELECT * FROM d WHERE rn = 1),
c AS ({sq.token_counts('w', 'doc_id', 'text')}),
n AS (SELECT k, CAST(sum(cnt * cnt) AS BIGINT) AS sumsq, CAST(count(*) AS INTEGER) AS buckets FROM c GROUP BY 1)
SELECT w.id, CAST(w.doc_id AS VARCHAR) AS doc_id, w.source AS type, length(regexp_replace(w.text, '^\\s+|\\s+$', '', 'g')) AS text_len,
       coalesce(n.sumsq, 0) AS sumsq, coalesce(n.buckets, 0) AS buckets
FROM w LEFT JOIN n ON n.k = w.doc_id
""")
def q_note_store_replace(spark, sf_dir):
    """All documents in batches that replace notes of one another, written as
    runs, merged in pairs and read back with their stored vectors."""
    import uuid

    from cashweave.operators.note_store import NoteStore
    from cashweave.operators.notes import prepare_notes
    from cashweave.session import ensure_checkpoint_dir
    store = NoteStore(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/notes-{uuid.uuid4().hex}", fanout=2)
    d = table(spark, sf_dir, "documents")
    ident = F.concat(F.lit("note-"), F.floor(F.col("doc_id") / 7).cast("string"))
    meta = F.create_map(F.lit("type"), F.col("source"), F.lit("doc_id"), F.col("doc_id").cast("string"))
    for b in range(NOTE_BATCHES):
        batch = d.where(F.pmod("doc_id", F.lit(NOTE_BATCHES)) == b).withColumn("id", ident)
        store.add(prepare_notes(batch, id_col="id", metadata=meta, order_by="doc_id")[0])
    m = F.col("metadata")
    return store.read().select("id", m["doc_id"].alias("doc_id"), m["type"].alias("type"), F.length("text").cast("long").alias("text_len"),
                               F.col("embedding.sumsq").alias("sumsq"), F.size("embedding.idx").alias("buckets"))


@register("note_count", f"SELECT count(*) AS notes FROM ({NOTES_SQL}) n")
def q_note_count(spark, sf_dir):
    from cashweave.operators.notes import note_count
    return note_count(document_notes(spark, sf_dir))


SEARCH_SQL = f"""
WITH notes AS ({NOTES_SQL}),
nc AS ({sq.token_counts('notes', 'seq', 'raw_text')}),
nn AS (SELECT k, sum(cnt * cnt) AS sumsq FROM nc GROUP BY 1),
qc AS ({sq.token_counts('benchmark', 'item_id', 'text')}),
qn AS (SELECT k, sum(cnt * cnt) AS sumsq FROM qc GROUP BY 1),
dots AS (SELECT qc.k AS question_id, nc.k AS seq, sum(qc.cnt * nc.cnt) AS dot
         FROM qc JOIN nc ON nc.bucket = qc.bucket GROUP BY 1, 2),
s AS (SELECT d.question_id, d.seq,
             CAST(d.dot AS DOUBLE) / (sqrt(CAST(nn.sumsq AS DOUBLE)) * sqrt(CAST(qn.sumsq AS DOUBLE))) AS score
      FROM dots d JOIN nn ON nn.k = d.seq JOIN qn ON qn.k = d.question_id),
r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, seq) AS rank FROM s)
SELECT r.question_id, CAST(r.rank AS INTEGER) AS rank, notes.id, r.score, r.seq
FROM r JOIN notes ON notes.seq = r.seq
WHERE r.rank <= 4 AND r.score > 0
"""


@register("note_search_topk", SEARCH_SQL)
def q_note_search_topk(spark, sf_dir):
    from cashweave.operators.notes import search_notes
    notes = document_notes(spark, sf_dir)
    qs = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"),
                                                  F.col("text").alias("question"))
    hits = search_notes(notes, qs, k=4, dim=256)
    return hits.select("question_id", "rank", "id", "score", "seq")


@register("embedding_topk", """
WITH e AS (
  SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
c AS (SELECT label, i, sum(CAST(x AS DOUBLE)) AS s FROM e GROUP BY 1, 2),
cv AS (SELECT label, list(s ORDER BY i) AS s FROM c GROUP BY 1),
cn AS (
  SELECT label, list_transform(s, lambda x: x / sqrt(list_sum(list_transform(s, lambda y: y * y)))) AS q
  FROM cv),
u AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
un AS (
  SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS w
  FROM u),
sc AS (SELECT cn.label, un.vec_id, list_dot_product(un.w, cn.q) AS score FROM cn, un),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM sc)
SELECT CAST(label AS BIGINT) AS label, CAST(rank AS INTEGER) AS rank, vec_id, round(score, 6) AS score
FROM r WHERE rank <= 4 AND score > 0
""")
def q_embedding_topk(spark, sf_dir):
    """Top-4 vectors nearest to each label's summed direction (X14, T1 on
    dense vectors). The label sums are an aggregate of the whole table."""
    from cashweave.operators.notes import search_vectors
    e = table(spark, sf_dir, "embeddings")
    items = e.select(F.col("vec_id").alias("seq"), F.col("embedding").alias("vec"))
    dim = 64
    sums = e.select("label", F.posexplode("embedding").alias("i", "x")) \
        .groupBy("label", "i").agg(F.sum(F.col("x").cast("double")).alias("s"))
    queries = sums.groupBy("label").agg(
        F.sort_array(F.collect_list(F.struct("i", "s"))).alias("parts")) \
        .select(F.col("label").cast("long").alias("question_id"),
                F.transform("parts", lambda p: p["s"]).alias("qvec"))
    hits = search_vectors(items, queries, k=4)
    return hits.where(F.col("score") > 0).select(
        F.col("question_id").alias("label"), "rank", F.col("seq").alias("vec_id"),
        F.round("score", 6).alias("score"))


# ---------------------------------------------------------------------------
# Questions and answers
# ---------------------------------------------------------------------------

from cashweave.sources.ledgers import QUESTIONS_SQL, customer_questions  # noqa: E402

QUESTIONS_PARSED_SQL = f"""
SELECT question_id, account_id, question, starting_balance, {sq.intent('question')} AS intent,
       {sq.question_amount('question')} AS asked_amount, {sq.question_category('question')} AS asked_category
FROM ({QUESTIONS_SQL}) q
"""


@register("question_parse", f"""
SELECT question_id, intent, asked_amount, asked_category FROM ({QUESTIONS_PARSED_SQL}) q
""")
def q_question_parse(spark, sf_dir):
    from cashweave.operators.advisor import parse_questions
    q = parse_questions(customer_questions(spark, sf_dir))
    return q.select("question_id", "intent", "asked_amount", "asked_category")


CATEGORIZED_ORDERS_SQL = f"""
WITH l AS ({ORDERS_LEDGER_SQL}), {sq.categorize_cte('l')}
SELECT l.*, c.category FROM l JOIN cat c ON c.k = l.row_ord
"""

WINDOW_SQL = f"""
WITH t AS ({CATEGORIZED_ORDERS_SQL}),
mx AS (SELECT account_id, max(transaction_date) AS max_date FROM t GROUP BY 1)
SELECT t.* FROM t JOIN mx ON mx.account_id = t.account_id WHERE t.transaction_date >= mx.max_date - 30
"""


@register("window_30d_net", f"""
SELECT account_id, CAST(sum(amount) AS DECIMAL(18,2)) AS net_window,
       CAST(sum(CASE WHEN amount < 0 THEN amount END) AS DECIMAL(18,2)) AS spend_window,
       count(*) AS rows_window, count(CASE WHEN amount < 0 THEN 1 END) AS expense_rows_window
FROM ({WINDOW_SQL}) w GROUP BY 1
""")
def q_window_30d_net(spark, sf_dir):
    from cashweave.operators.advisor import window_aggregates
    acct, _ = window_aggregates(categorized_orders(spark, sf_dir))
    return acct.select("account_id", F.col("net_window").cast(MONEY).alias("net_window"),
                       F.col("spend_window").cast(MONEY).alias("spend_window"),
                       "rows_window", "expense_rows_window")


@register("category_spend_30d", f"""
SELECT account_id, category, CAST(sum(CASE WHEN amount < 0 THEN amount END) AS DECIMAL(18,2)) AS cat_spend,
       count(*) AS cat_rows
FROM ({WINDOW_SQL}) w GROUP BY 1, 2
""")
def q_category_spend_30d(spark, sf_dir):
    from cashweave.operators.advisor import window_aggregates
    _, by_cat = window_aggregates(categorized_orders(spark, sf_dir))
    return by_cat.select("account_id", "category", F.col("cat_spend").cast(MONEY).alias("cat_spend"), "cat_rows")


CITATION_SETS_SQL = f"""
WITH w AS (SELECT *, {sq.content_hash('transaction_date', 'amount', 'description')} AS raw_hash
           FROM ({WINDOW_SQL}) w0)
SELECT account_id, 'window' AS scope, CAST(NULL AS VARCHAR) AS category, raw_hash, row_ord AS pos FROM w
UNION ALL
SELECT account_id, 'window_expenses', CAST(NULL AS VARCHAR), raw_hash, row_ord FROM w WHERE amount < 0
UNION ALL
SELECT account_id, 'window_category', category, raw_hash, row_ord FROM w
"""


def _qa_txns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return categorized_orders(spark, sf_dir)


@register("citation_sets", CITATION_SETS_SQL)
def q_citation_sets(spark, sf_dir):
    from cashweave.operators.advisor import citation_sets
    return citation_sets(_qa_txns(spark, sf_dir)).select("account_id", "scope", "category", "raw_hash", "pos")


@register("citation_integrity", f"""
SELECT count(*) AS missing_citations
FROM (SELECT account_id, CASE WHEN pos % 7 = 0 THEN reverse(raw_hash) ELSE raw_hash END AS raw_hash FROM ({CITATION_SETS_SQL}) c0) c
WHERE NOT EXISTS (SELECT 1 FROM ({ORDERS_LEDGER_SQL}) l WHERE l.account_id = c.account_id
                  AND {sq.content_hash('l.transaction_date', 'l.amount', 'l.description')} = c.raw_hash)
""")
def q_citation_integrity(spark, sf_dir):
    from cashweave.operators.advisor import citation_integrity, citation_sets
    t = _qa_txns(spark, sf_dir)
    bad = F.when(F.col("pos") % 7 == 0, F.reverse("raw_hash")).otherwise(F.col("raw_hash"))
    return citation_integrity(citation_sets(t).withColumn("raw_hash", bad), t)


def _notes_top1_sql(questions_sql: str) -> str:
    return f"""
    notes AS ({NOTES_SQL}),
    nc AS ({sq.token_counts('notes', 'seq', 'raw_text')}),
    nn AS (SELECT k, sum(cnt * cnt) AS sumsq FROM nc GROUP BY 1),
    qq AS ({questions_sql}),
    qc AS ({sq.token_counts('qq', 'question_id', 'question')}),
    qn AS (SELECT k, sum(cnt * cnt) AS sumsq FROM qc GROUP BY 1),
    dots AS (SELECT qc.k AS question_id, nc.k AS seq, sum(qc.cnt * nc.cnt) AS dot
             FROM qc JOIN nc ON nc.bucket = qc.bucket GROUP BY 1, 2),
    sc AS (SELECT d.question_id, d.seq,
                  CAST(d.dot AS DOUBLE) / (sqrt(CAST(nn.sumsq AS DOUBLE)) * sqrt(CAST(qn.sumsq AS DOUBLE))) AS score
           FROM dots d JOIN nn ON nn.k = d.seq JOIN qn ON qn.k = d.question_id),
    rk AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, seq) AS rank FROM sc),
    topn AS (SELECT rk.question_id, rk.rank, rk.score, notes.id AS note_id, notes.text AS note_text,
                    coalesce(notes.source, 'note') AS note_type
             FROM rk JOIN notes ON notes.seq = rk.seq WHERE rk.score > 0 AND rk.rank <= 4)"""


ANSWERS_SQL = f"""
WITH t AS ({CATEGORIZED_ORDERS_SQL}),
d AS (SELECT account_id, transaction_date AS date, sum(amount) AS net FROM t GROUP BY 1, 2),
st AS (SELECT account_id, max(date) AS last_date, sum(net) AS total_net,
              CAST(sum(net) AS DOUBLE) / (date_diff('day', min(date), max(date)) + 1) AS mean_daily_net,
              coalesce(-(CAST(sum(CASE WHEN net < 0 THEN net END) AS DOUBLE)
                         / count(CASE WHEN net < 0 THEN 1 END)), 0) AS mean_daily_burn
       FROM d GROUP BY 1),
w AS ({WINDOW_SQL}),
aw AS (SELECT account_id, sum(amount) AS net_window, sum(CASE WHEN amount < 0 THEN amount END) AS spend_window,
              count(*) AS rows_window, count(CASE WHEN amount < 0 THEN 1 END) AS expense_rows_window
       FROM w GROUP BY 1),
cw AS (SELECT account_id, category, sum(CASE WHEN amount < 0 THEN amount END) AS cat_spend, count(*) AS cat_rows
       FROM w GROUP BY 1, 2),
q AS ({QUESTIONS_PARSED_SQL}),
{_notes_top1_sql(QUESTIONS_SQL)},
j AS (
  SELECT q.question_id, q.account_id, q.question, q.intent, q.asked_amount AS amount, q.asked_category AS cat,
         coalesce(q.starting_balance, 0) AS start,
         st.last_date, st.total_net, st.mean_daily_net, st.mean_daily_burn,
         CAST(aw.net_window AS DOUBLE) AS net30, aw.spend_window, aw.rows_window, aw.expense_rows_window,
         cw.cat_spend, cw.cat_rows, tn.note_id, tn.note_text, tn.note_type,
         st.last_date IS NOT NULL AS has_txns
  FROM q LEFT JOIN st ON st.account_id = q.account_id
         LEFT JOIN aw ON aw.account_id = q.account_id
         LEFT JOIN cw ON cw.account_id = q.account_id AND cw.category = q.asked_category
         LEFT JOIN (SELECT * FROM topn WHERE rank = 1) tn ON tn.question_id = q.question_id),
dd AS (
  SELECT j.question_id, min(i.i) AS step
  FROM j JOIN (SELECT unnest(generate_series(1, 180)) AS i) i
    ON j.start + CAST(j.total_net AS DOUBLE) + j.mean_daily_net * i.i <= 0
  WHERE j.has_txns GROUP BY 1),
a AS (
  SELECT j.*, CASE WHEN dd.step IS NOT NULL THEN CAST(j.last_date + CAST(dd.step AS INTEGER) AS DATE) END AS death,
         j.start - j.mean_daily_burn * CAST(30 AS DOUBLE) AS cushion,
         coalesce(j.cat_rows, 0) > 0 AS has_cat_rows
  FROM j LEFT JOIN dd ON dd.question_id = j.question_id),
b AS (
  SELECT a.*,
    CASE
      WHEN intent = 'runway' THEN
        CASE WHEN NOT has_txns THEN 'No transactions available to compute runway.'
             WHEN death IS NULL THEN 'Cash-flow positive: avg daily net ' || {sq.money('mean_daily_net')} ||
                  '. No runway risk in the next 180 days.'
             ELSE 'Projected runway: ' || CAST(date_diff('day', DATE '{AS_OF}', death) AS VARCHAR) ||
                  ' days. Balance hits $0 on ' || strftime(death, '%Y-%m-%d') || ' at avg daily burn ' ||
                  {sq.money('mean_daily_burn')} || '.' END
      WHEN intent = 'affordability' THEN
        CASE WHEN NOT has_txns THEN 'I don''t have enough recent transactions to judge affordability.'
             WHEN amount IS NULL THEN 'Your last-30-day net cashflow is ' || {sq.money('net30')} ||
                  '. Anything meaningfully below that fits within recent headroom.'
             WHEN net30 <= 0 THEN 'Not advisable: last-30-day net cashflow is ' || {sq.money('net30')} ||
                  ' (negative). Covering ' || {sq.money('amount')} || ' would deepen the burn.'
             WHEN amount > CAST(0.5 AS DOUBLE) * net30 AND amount > cushion THEN
                  'Risky: ' || {sq.money('amount')} || ' is more than half of last-30-day net cashflow (' ||
                  {sq.money('net30')} || ') and larger than your one-month cushion (' || {sq.money('cushion')} ||
                  ' after expected burn).'
             ELSE 'Yes, affordable: ' || {sq.money('amount')} || ' fits within last-30-day net cashflow of ' ||
                  {sq.money('net30')} || ' and leaves a one-month cushion of ' || {sq.money('cushion')} || '.' END
      WHEN intent = 'category_spend' THEN
        CASE WHEN NOT has_txns THEN 'I need categorized transactions to answer spend questions.'
             WHEN cat IS NULL THEN 'Total spend in the last 30 days: ' ||
                  {sq.money('abs(coalesce(CAST(spend_window AS DOUBLE), 0))')} || '.'
             WHEN NOT has_cat_rows THEN 'No transactions in category `' || cat || '` in the last 30 days.'
             ELSE 'Spent ' || {sq.money('abs(coalesce(CAST(cat_spend AS DOUBLE), 0))')} || ' on `' || cat ||
                  '` across ' || CAST(cat_rows AS VARCHAR) || ' transactions in the last 30 days.' END
      ELSE
        CASE WHEN note_id IS NOT NULL THEN 'Based on your business context (' || note_type || '): ' || note_text
             WHEN NOT has_txns THEN 'I don''t have any transactions or notes to draw on yet.'
             ELSE 'Net cashflow across the loaded period is ' || {sq.money('total_net')} ||
                  '. Ask me about spend by category, runway, or affordability.' END
    END AS answer,
    CASE
      WHEN intent IN ('runway', 'affordability') THEN CASE WHEN has_txns THEN 'window' END
      WHEN intent = 'category_spend' THEN
        CASE WHEN NOT has_txns THEN NULL WHEN cat IS NULL THEN 'window_expenses'
             WHEN has_cat_rows THEN 'window_category' END
      ELSE CASE WHEN note_id IS NOT NULL THEN 'note' WHEN has_txns THEN 'window' END
    END AS cite_scope
  FROM a)
SELECT question_id, account_id, question, intent, answer, cite_scope,
       CASE WHEN cite_scope = 'window_category' THEN cat END AS cite_category,
       CAST(CASE cite_scope WHEN 'window' THEN rows_window WHEN 'window_expenses' THEN expense_rows_window
                 WHEN 'window_category' THEN cat_rows WHEN 'note' THEN 1 ELSE 0 END AS BIGINT) AS n_citations,
       CASE WHEN cite_scope = 'note' THEN note_id END AS note_id, 'rules' AS backend
FROM b
"""


def _answers(spark: SparkSession, sf_dir: str, retrieve: bool = True):
    from cashweave.operators.advisor import answer_questions
    return answer_questions(customer_questions(spark, sf_dir), _qa_txns(spark, sf_dir),
                            notes=document_notes(spark, sf_dir), as_of=AS_OF, retrieve=retrieve)


@register("answers", ANSWERS_SQL)
def q_answers(spark, sf_dir):
    answers, _ = _answers(spark, sf_dir, retrieve=False)
    return answers


@register("retrieved_notes", f"""
WITH {_notes_top1_sql(QUESTIONS_SQL)}
SELECT question_id, CAST(rank AS INTEGER) AS rank, note_id AS id, round(score, 3) AS score FROM topn
""")
def q_retrieved_notes(spark, sf_dir):
    _, hits = _answers(spark, sf_dir)
    return hits.select("question_id", "rank", "id", F.round("score", 3).alias("score"))


@register("answer_citations_first3", f"""
WITH a AS ({ANSWERS_SQL}),
h AS (SELECT *, row_number() OVER (PARTITION BY account_id, scope, category ORDER BY pos) AS n
      FROM ({CITATION_SETS_SQL}) c)
SELECT a.question_id, h.raw_hash AS cite_id, h.pos
FROM a JOIN h ON h.account_id = a.account_id AND h.scope = a.cite_scope
             AND h.category IS NOT DISTINCT FROM a.cite_category
WHERE h.n <= 3
UNION ALL
SELECT question_id, note_id, CAST(NULL AS BIGINT) FROM a WHERE cite_scope = 'note'
""")
def q_answer_citations_first3(spark, sf_dir):
    from cashweave.operators.advisor import answer_citations, citation_sets
    answers, _ = _answers(spark, sf_dir, retrieve=False)
    return answer_citations(answers, citation_sets(_qa_txns(spark, sf_dir)), first_n=3)


@register("answer_citations", f"""
WITH a AS ({ANSWERS_SQL})
SELECT a.question_id, h.raw_hash AS cite_id, h.pos
FROM a JOIN ({CITATION_SETS_SQL}) h ON h.account_id = a.account_id AND h.scope = a.cite_scope
             AND h.category IS NOT DISTINCT FROM a.cite_category
UNION ALL
SELECT question_id, note_id, CAST(NULL AS BIGINT) FROM a WHERE cite_scope = 'note'
""")
def q_answer_citations(spark, sf_dir):
    from cashweave.operators.advisor import answer_citations, citation_sets
    answers, _ = _answers(spark, sf_dir, retrieve=False)
    return answer_citations(answers, citation_sets(_qa_txns(spark, sf_dir)))


NO_NOTES_SQL = ANSWERS_SQL.replace("WHERE rank = 1) tn", "WHERE rank = 0) tn")


@register("answers_from_facts", NO_NOTES_SQL)
def q_answers_from_facts(spark, sf_dir):
    """The questions answered from facts that were kept up to date while the
    orders ledger grew by thirds of its days."""
    import uuid

    from cashweave.operators.advisor import answer_questions
    from cashweave.operators.fact_store import FactStore
    from cashweave.session import ensure_checkpoint_dir
    store = FactStore(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/facts-{uuid.uuid4().hex}")
    third = F.pmod(F.dayofyear("transaction_date"), F.lit(3)).cast("long")
    ledger = canonical_orders(spark, sf_dir).withColumn("batch", third)
    for b in range(3):
        store.update(ledger.where(F.col("batch") <= b), cat_ops.categorize)
    answers, _ = answer_questions(customer_questions(spark, sf_dir), None, as_of=AS_OF, facts=store.read())
    return answers


@register("answers_json", f"""
WITH a AS ({NO_NOTES_SQL}),
c AS (SELECT a.question_id, string_agg('"' || h.raw_hash || '"', ',' ORDER BY h.pos) AS ids
      FROM a JOIN ({CITATION_SETS_SQL}) h ON h.account_id = a.account_id AND h.scope = a.cite_scope
                   AND h.category IS NOT DISTINCT FROM a.cite_category GROUP BY 1)
SELECT a.question_id, '{{"question":"' || a.question || '","answer":"' || a.answer || '","citations":{{'
       || coalesce('"scope":"' || a.cite_scope || '",', '') || coalesce('"category":"' || a.cite_category || '",', '')
       || '"count":' || CAST(a.n_citations AS VARCHAR) || ',"ids":[' || coalesce(c.ids, '') || ']}},"retrieved_notes":[],"intent":"'
       || a.intent || '","backend":"' || a.backend || '"}}' AS json
FROM a LEFT JOIN c ON c.question_id = a.question_id
""")
def q_answers_json(spark, sf_dir):
    from cashweave.operators.advisor import answer_questions, answers_json, citation_sets
    t = _qa_txns(spark, sf_dir)
    answers, _ = answer_questions(customer_questions(spark, sf_dir), t, as_of=AS_OF)
    return answers_json(answers, None, citation_sets(t))


@register("answer_records", f"""
WITH a AS ({ANSWERS_SQL}),
h AS (WITH {_notes_top1_sql(QUESTIONS_SQL)}
      SELECT question_id, string_agg('{{"id":"' || note_id || '","score":' || CAST(round(score, 3) AS VARCHAR)
             || ',"text":' || CAST(to_json(note_text) AS VARCHAR) || '}}', ',' ORDER BY rank) AS found FROM topn GROUP BY 1)
SELECT a.question_id, '{{"question":' || CAST(to_json(a.question) AS VARCHAR) || ',"answer":' || CAST(to_json(a.answer) AS VARCHAR)
       || ',"citations":{{"account_id":' || CAST(a.account_id AS VARCHAR) || coalesce(',"scope":"' || a.cite_scope || '"', '')
       || coalesce(',"category":"' || a.cite_category || '"', '') || coalesce(',"note_id":"' || a.note_id || '"', '')
       || ',"count":' || CAST(a.n_citations AS VARCHAR) || '}},"retrieved_notes":[' || coalesce(h.found, '') || '],"intent":"'
       || a.intent || '","backend":"' || a.backend || '"}}' AS json
FROM a LEFT JOIN h ON h.question_id = a.question_id
""")
def q_answer_records(spark, sf_dir):
    """The record of every question with its notes; citations by their set."""
    from cashweave.operators.advisor import answer_records
    return answer_records(*_answers(spark, sf_dir))


# ---------------------------------------------------------------------------
# Reports
# ---------------------------------------------------------------------------

@register("kpis", f"""
SELECT account_id, count(*) AS transactions,
       CAST(coalesce(sum(CASE WHEN amount > 0 THEN amount END), 0) AS DECIMAL(18,2)) AS total_income,
       CAST(abs(coalesce(sum(CASE WHEN amount < 0 THEN amount END), 0)) AS DECIMAL(18,2)) AS total_expenses,
       CAST(sum(amount) AS DECIMAL(18,2)) AS net_cashflow,
       CASE WHEN sum(amount) >= 0 THEN 'positive' ELSE 'negative' END AS net_direction
FROM ({ORDERS_LEDGER_SQL}) l GROUP BY 1
""")
def q_kpis(spark, sf_dir):
    from cashweave.operators.reports import kpis
    k = kpis(canonical_orders(spark, sf_dir), by=["account_id"])
    return k.select("account_id", "transactions", *[F.col(c).cast(MONEY).alias(c) for c in
                                                    ("total_income", "total_expenses", "net_cashflow")],
                    "net_direction")


@register("kpis_total", f"""
SELECT count(*) AS transactions,
       CAST(coalesce(sum(CASE WHEN amount > 0 THEN amount END), 0) AS DECIMAL(18,2)) AS total_income,
       CAST(abs(coalesce(sum(CASE WHEN amount < 0 THEN amount END), 0)) AS DECIMAL(18,2)) AS total_expenses,
       CAST(sum(amount) AS DECIMAL(18,2)) AS net_cashflow,
       CASE WHEN sum(amount) >= 0 THEN 'positive' ELSE 'negative' END AS net_direction
FROM ({ORDERS_LEDGER_SQL}) l
""")
def q_kpis_total(spark, sf_dir):
    from cashweave.operators.reports import kpis
    k = kpis(canonical_orders(spark, sf_dir))
    return k.select("transactions", *[F.col(c).cast(MONEY).alias(c) for c in
                                      ("total_income", "total_expenses", "net_cashflow")], "net_direction")


@register("spend_by_category", f"""
SELECT category, CAST(sum(abs(amount)) AS DECIMAL(18,2)) AS amount
FROM ({CATEGORIZED_ORDERS_SQL}) t WHERE amount < 0 GROUP BY 1 ORDER BY 2 DESC
""")
def q_spend_by_category(spark, sf_dir):
    from cashweave.operators.reports import spend_by_category
    s = spend_by_category(categorized_orders(spark, sf_dir))
    return s.select("category", F.col("amount").cast(MONEY).alias("amount"))


@register("daily_cashflow", f"""
SELECT transaction_date AS date, CAST(sum(amount) AS DECIMAL(18,2)) AS net
FROM ({ORDERS_LEDGER_SQL}) l GROUP BY 1 ORDER BY 1
""")
def q_daily_cashflow(spark, sf_dir):
    from cashweave.operators.reports import daily_cashflow
    d = daily_cashflow(canonical_orders(spark, sf_dir))
    return d.select("date", F.col("net").cast(MONEY).alias("net"))


@register("transaction_detail", f"""
WITH l AS ({ORDERS_LEDGER_SQL}), {sq.categorize_cte('l')}
SELECT l.row_ord, l.transaction_date AS "Date", l.description AS "Description",
       {sq.money('l.amount')} AS "Amount", c.category AS "Category",
       format('{{:.0f}}%', c.confidence * 100) AS "Confidence"
FROM l JOIN cat c ON c.k = l.row_ord
""")
def q_transaction_detail(spark, sf_dir):
    from cashweave.operators.reports import transaction_detail
    return transaction_detail(categorized_orders(spark, sf_dir), keep=["row_ord"])


# ---------------------------------------------------------------------------
# Seasonal projection
# ---------------------------------------------------------------------------

@register("seasonal_projection", f"""
WITH f AS ({DAILY_FILLED_SQL}), sb AS ({CUSTOMER_BALANCES_SQL}),
b AS (SELECT f.account_id, f.date,
             coalesce(sb.starting_balance, 0) + sum(CAST(f.net AS DOUBLE)) OVER
               (PARTITION BY f.account_id ORDER BY f.date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS balance
      FROM f LEFT JOIN sb ON sb.account_id = f.account_id),
fr AS (SELECT account_id, min(date) AS d0, max(date) AS d1 FROM b GROUP BY 1),
s AS (SELECT b.*, fr.d0, fr.d1, CAST(date_diff('day', fr.d0, b.date) AS DOUBLE) AS t FROM b JOIN fr USING (account_id)),
fit AS (SELECT account_id, d0, d1, coalesce(regr_slope(balance, t), 0) AS slope,
               coalesce(regr_intercept(balance, t), 0) AS intercept FROM s GROUP BY 1, 2, 3),
eff AS (SELECT s.account_id, dayofweek(s.date) AS dow, avg(s.balance - (fit.intercept + fit.slope * s.t)) AS effect
        FROM s JOIN fit USING (account_id) GROUP BY 1, 2),
p AS (SELECT fit.*, g.i AS day_no, CAST(fit.d1 + CAST(g.i AS INTEGER) AS DATE) AS date
      FROM fit, (SELECT unnest(generate_series(1, 30)) AS i) g)
SELECT p.account_id, p.day_no, p.date,
       round(p.intercept + p.slope * CAST(date_diff('day', p.d0, p.date) AS DOUBLE) + coalesce(eff.effect, 0), 4)
         AS projected_balance
FROM p LEFT JOIN eff ON eff.account_id = p.account_id AND eff.dow = dayofweek(p.date)
""")
def q_seasonal_projection(spark, sf_dir):
    from cashweave.operators.seasonal import seasonal_projection
    p = seasonal_projection(events_ledger(spark, sf_dir), customer_balances(spark, sf_dir), horizon_days=30)
    return p.select("account_id", F.col("day_no").cast("long").alias("day_no"), "date",
                    F.round("projected_balance", 4).alias("projected_balance"))


# ---------------------------------------------------------------------------
# External-model batches (request build, response merge, rewrite context)
# ---------------------------------------------------------------------------

def _model_rows(spark: SparkSession, sf_dir: str):
    from cashweave.operators.model_batches import request_rows
    c = categorized_orders(spark, sf_dir)
    return request_rows(c, batch_size=5), c


from cashweave.operators.model_batches import REQUEST_PROMPT, REWRITE_PROMPT  # noqa: E402

_REQUEST_PROMPT_SQL = REQUEST_PROMPT.format(categories=", ".join(TAX_CATEGORIES)).replace("'", "''")
REQUEST_ROWS_SQL = f"""
WITH l AS ({ORDERS_LEDGER_SQL}),
n AS (SELECT account_id, count(*) AS n FROM l GROUP BY 1),
b AS (SELECT l.*, CAST(('0x' || substr(md5(CAST(l.row_ord AS VARCHAR)), 1, 8)) AS BIGINT)
                    % greatest(1, CAST(ceil(n.n / 5) AS BIGINT)) AS batch_id
      FROM l JOIN n USING (account_id))
SELECT account_id, batch_id,
       row_number() OVER (PARTITION BY account_id, batch_id ORDER BY row_ord) - 1 AS "index", row_ord,
       {sq.pii_mask('description')} AS description_masked, CAST(amount AS DOUBLE) AS amount
FROM b
"""


@register("model_request_batches", f"""
SELECT account_id, batch_id, CAST(count(*) AS INTEGER) AS n_rows,
       '{_REQUEST_PROMPT_SQL}' || chr(10) || chr(10) || 'Transactions:' || chr(10) || '[' || string_agg(
         '{{"index":' || CAST("index" AS VARCHAR) || ',"description":"' || description_masked || '","amount":'
         || CAST(amount AS VARCHAR) || '}}', ',' ORDER BY "index") || ']' AS body
FROM ({REQUEST_ROWS_SQL}) r GROUP BY 1, 2
""")
def q_model_request_batches(spark, sf_dir):
    from cashweave.operators.model_batches import request_bodies
    rows, _ = _model_rows(spark, sf_dir)
    return request_bodies(rows)


def synthetic_responses(rows: DataFrame, rules: DataFrame, key: str = "row_ord") -> DataFrame:
    """A stand-in model for tests: answers each batch from the rules output,
    but skips some rows, invents a category for others and repeats index 0 with
    a later answer. Some batches get prose, a lone object, numbers written as
    text, a confidence that is no number, text behind the list, or an index
    that is a text of no whole number."""
    r = rows.join(rules.select("account_id", key, "category", "ai_confidence_score"), ["account_id", key])
    i = F.col("index")
    kind = F.pmod(F.col("batch_id") + F.col("account_id"), F.lit(7))
    quote = F.when(kind == 2, F.lit('"')).otherwise(F.lit(""))

    def item(category, confidence):
        broken = F.when(kind == 6, F.lit('"1.7"')).otherwise(F.concat(quote, i.cast("string"), quote))
        return F.concat(F.lit('{"index": '), broken, F.lit(', "category": "'), category,
                        F.lit('", "confidence": '), confidence, F.lit("}"))

    items = r.where(F.pmod(i, F.lit(11)) != 5).select(
        "account_id", "batch_id", i.alias("pos"),
        item(F.when(F.pmod(i, F.lit(7)) == 3, F.lit("Snacks")).otherwise(F.col("category")),
             F.when((kind == 3) & (i == 0), F.lit('"high"')).otherwise(F.col("ai_confidence_score").cast("string"))).alias("it"))
    extra = r.where(i == 0).select("account_id", "batch_id", F.lit(10 ** 9).cast("long").alias("pos"),
                                   item(F.lit("Transfers"), F.lit("0.42")).alias("it"))
    g = items.unionByName(extra).groupBy("account_id", "batch_id").agg(
        F.sort_array(F.collect_list(F.struct("pos", "it"))).alias("l"))
    listed = F.concat(F.lit("```json\n["), F.array_join(F.transform("l", lambda x: x["it"]), ", "), F.lit("]\n```"))
    return g.select("account_id", "batch_id", F.when(kind == 0, F.lit("Sorry, I cannot classify these."))
                    .when(kind == 1, F.element_at("l", 1)["it"]).when(kind == 5, F.concat(listed, F.lit("\nHope this helps")))
                    .otherwise(listed).alias("response"))


OTHER_LEDGER = 1_000_000_000


@register("model_response_merge", f"""
WITH o AS ({ORDERS_LEDGER_SQL}),
l0 AS (SELECT *, {sq.content_hash('transaction_date', 'amount', 'description')} AS raw_hash FROM o),
l AS (SELECT * FROM l0 UNION ALL
      SELECT * REPLACE (account_id + {OTHER_LEDGER} AS account_id, row_ord + {OTHER_LEDGER} AS row_ord) FROM l0 WHERE row_ord % 3 = 0),
{sq.categorize_cte('l')},
n AS (SELECT account_id, count(*) AS n FROM l GROUP BY 1),
b AS (SELECT l.account_id, l.row_ord, l.raw_hash,
             CAST(('0x' || substr(md5(l.raw_hash), 1, 8)) AS BIGINT)
               % greatest(1, CAST(ceil(n.n / 5) AS BIGINT)) AS batch_id
      FROM l JOIN n USING (account_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY account_id, batch_id ORDER BY raw_hash) - 1 AS idx FROM b)
SELECT r.account_id, r.raw_hash,
       CASE WHEN (r.batch_id + r.account_id) % 7 IN (0, 1, 3, 5, 6) THEN c.category
            WHEN r.idx = 0 THEN 'Transfers'
            WHEN r.idx % 11 = 5 THEN 'Uncategorized'
            WHEN r.idx % 7 = 3 THEN 'Uncategorized'
            ELSE c.category END AS category,
       CASE WHEN (r.batch_id + r.account_id) % 7 IN (0, 1, 3, 5, 6) THEN c.confidence
            WHEN r.idx = 0 THEN 0.42
            WHEN r.idx % 11 = 5 THEN 0.0
            ELSE c.confidence END AS ai_confidence_score,
       CASE WHEN (r.batch_id + r.account_id) % 7 IN (0, 1, 3, 5, 6) THEN 'rules' ELSE 'model' END AS method
FROM r JOIN cat c ON c.k = r.row_ord
""")
def q_model_response_merge(spark, sf_dir):
    """Keyed by content hash; a third of the rows are in two ledgers alike."""
    from cashweave.operators.model_batches import merge_responses, request_rows
    c = categorized_orders(spark, sf_dir).drop("row_ord")
    other = c.where(F.substring_index("description", "#", -1).cast("long") % 3 == 0).withColumn("account_id", F.col("account_id") + OTHER_LEDGER)
    both = c.unionByName(other)
    rows = request_rows(both, batch_size=5, key="raw_hash")
    return merge_responses(rows, synthetic_responses(rows, both, "raw_hash"), both, key="raw_hash")


_REWRITE_PROMPT_SQL = REWRITE_PROMPT.replace("'", "''").replace("\n", "' || chr(10) || '")


@register("model_rewrite_context", f"""
WITH a AS ({ANSWERS_SQL}),
{_notes_top1_sql(QUESTIONS_SQL)},
ctx AS (SELECT question_id,
               string_agg('- [' || note_id || '] ' || {sq.pii_mask('note_text')}, chr(10) ORDER BY rank) AS c
        FROM topn GROUP BY 1)
SELECT a.question_id,
       '{_REWRITE_PROMPT_SQL}'
       || 'Question: ' || a.question || chr(10) || 'Draft: ' || a.answer || chr(10) || 'Context notes:' || chr(10)
       || coalesce(ctx.c, '(none)') || chr(10) || chr(10) || 'Rewritten answer:' AS prompt
FROM a LEFT JOIN ctx ON ctx.question_id = a.question_id
""")
def q_model_rewrite_context(spark, sf_dir):
    from cashweave.operators.model_batches import rewrite_context
    answers, hits = _answers(spark, sf_dir)
    return rewrite_context(answers, hits, document_notes(spark, sf_dir))


@register("transaction_records", f"""
WITH l AS ({ORDERS_LEDGER_SQL}), {sq.categorize_cte('l')}
SELECT l.row_ord, strftime(l.transaction_date, '%Y-%m-%d') AS transaction_date,
       CAST(l.amount AS VARCHAR) AS amount, l.description, 'orders' AS source,
       {sq.content_hash('l.transaction_date', 'l.amount', 'l.description')} AS raw_hash,
       c.category, c.confidence AS ai_confidence_score
FROM l JOIN cat c ON c.k = l.row_ord
""")
def q_transaction_records(spark, sf_dir):
    from cashweave.operators.normalize import transaction_record
    return transaction_record(categorized_orders(spark, sf_dir), keep=["row_ord"])


@register("model_request_rows", REQUEST_ROWS_SQL)
def q_model_request_rows(spark, sf_dir):
    rows, _ = _model_rows(spark, sf_dir)
    return rows


# ---------------------------------------------------------------------------
# Trend with change points
# ---------------------------------------------------------------------------

CUT_DAYS, CUT_MOST, CUT_PENALTY = 7, 4, 3.0
# short lines through cents often end in a 5 at the fifth decimal, where the last bit would decide
OFF_TIES = 0.0000123


def _cuts_sql() -> str:
    """CTEs up to ``seg``: the days of the events ledger with the number and
    the line of their segment. Layer k holds the best k segments of each prefix."""
    layers = "".join(f""",
p{k} AS (SELECT p.account_id, c.j, p.err + c.err AS err, list_append(p.cuts, c.i) AS cuts,
                row_number() OVER (PARTITION BY p.account_id, c.j ORDER BY p.err + c.err, c.i) AS rn
         FROM l{k - 1} p JOIN c ON c.account_id = p.account_id AND c.i = p.j),
l{k} AS (SELECT account_id, j, err, cuts FROM p{k} WHERE rn = 1)""" for k in range(2, CUT_MOST + 1))
    ends = " UNION ALL ".join(
        f"SELECT {k} AS k, l{k}.*, n.n FROM l{k} JOIN n ON n.account_id = l{k}.account_id AND n.n = l{k}.j" for k in range(1, CUT_MOST + 1))
    return f"""
f AS ({DAILY_FILLED_SQL}), sb AS ({CUSTOMER_BALANCES_SQL}),
b AS (SELECT f.account_id, f.date, row_number() OVER (PARTITION BY f.account_id ORDER BY f.date) - 1 AS t,
             coalesce(sb.starting_balance, 0) + sum(CAST(f.net AS DOUBLE)) OVER
               (PARTITION BY f.account_id ORDER BY f.date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS balance
      FROM f LEFT JOIN sb ON sb.account_id = f.account_id),
n AS (SELECT account_id, count(*) AS n FROM b GROUP BY 1),
edge AS (SELECT account_id, t AS i, n FROM b JOIN n USING (account_id) WHERE t = 0 OR t >= {CUT_DAYS}),
span AS (SELECT a.account_id, a.i, z.t + 1 AS j FROM edge a JOIN b z ON z.account_id = a.account_id
         WHERE z.t + 1 - a.i >= {CUT_DAYS} OR (a.i = 0 AND z.t + 1 = a.n)),
c AS (SELECT s.account_id, s.i, s.j,
             greatest(coalesce(regr_syy(b.balance, b.t) - CASE WHEN regr_sxx(b.balance, b.t) > 0
                      THEN pow(regr_sxy(b.balance, b.t), 2) / regr_sxx(b.balance, b.t) ELSE 0 END, 0), 0) AS err
      FROM span s JOIN b ON b.account_id = s.account_id AND b.t >= s.i AND b.t < s.j GROUP BY 1, 2, 3),
l1 AS (SELECT account_id, j, err, [i] AS cuts FROM c WHERE i = 0){layers},
choice AS (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY
                    n * ln(err / n + 0.0001) + {CUT_PENALTY} * k * ln(n), k) AS rn FROM ({ends}) e),
num AS (SELECT b.*, len(list_filter(choice.cuts, lambda x: x <= b.t)) AS segment
        FROM b JOIN choice ON choice.account_id = b.account_id AND choice.rn = 1),
line AS (SELECT account_id, segment, coalesce(regr_slope(balance, t), 0) AS slope,
                coalesce(regr_intercept(balance, t), avg(balance)) AS intercept FROM num GROUP BY 1, 2),
seg AS (SELECT num.*, slope, intercept, balance - intercept - slope * t AS off FROM num JOIN line USING (account_id, segment))"""


@register("trend_segments", f"""
WITH {_cuts_sql()}
SELECT account_id, CAST(segment AS BIGINT) AS segment, min(date) AS first_date, max(date) AS last_date, count(*) AS n_days,
       round(any_value(slope), 4) AS slope, round(any_value(intercept), 4) AS intercept, round(sum(off * off), 2) AS error
FROM seg GROUP BY 1, 2
""")
def q_trend_segments(spark, sf_dir):
    from cashweave.operators.change_points import trend_segments
    s = trend_segments(events_ledger(spark, sf_dir), customer_balances(spark, sf_dir), CUT_MOST, CUT_DAYS, CUT_PENALTY)
    return s.select("account_id", "segment", "first_date", "last_date", "n_days", F.round("slope", 4).alias("slope"),
                    F.round("intercept", 4).alias("intercept"), F.round("error", 2).alias("error"))


@register("changing_trend_projection", f"""
WITH {_cuts_sql()},
last AS (SELECT account_id, max(date) AS d1, max(t) AS t1, arg_max(slope, t) AS slope, arg_max(intercept, t) AS intercept FROM seg GROUP BY 1),
eff AS (SELECT account_id, dayofweek(date) AS dow, avg(off) AS effect FROM seg GROUP BY 1, 2),
p AS (SELECT last.*, g.i AS day_no, CAST(d1 + CAST(g.i AS INTEGER) AS DATE) AS date
      FROM last, (SELECT unnest(generate_series(1, 30)) AS i) g)
SELECT p.account_id, p.day_no, p.date, round(p.intercept + p.slope * (p.t1 + p.day_no) + coalesce(eff.effect, 0) + {OFF_TIES}, 4) AS projected_balance
FROM p LEFT JOIN eff ON eff.account_id = p.account_id AND eff.dow = dayofweek(p.date)
""")
def q_changing_trend_projection(spark, sf_dir):
    from cashweave.operators.change_points import changing_trend_projection
    p = changing_trend_projection(events_ledger(spark, sf_dir), customer_balances(spark, sf_dir), 30, CUT_MOST, CUT_DAYS, CUT_PENALTY)
    return p.select("account_id", F.col("day_no").cast("long").alias("day_no"), "date",
                    F.round(F.col("projected_balance") + OFF_TIES, 4).alias("projected_balance"))
