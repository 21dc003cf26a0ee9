"""Ledger views over the driver's tables.

The test tables hold no bank exports, so transactions are derived from them
deterministically, identically in Spark (here) and in SQL (``*_SQL`` below,
used by the DuckDB oracle):

* ``orders_ledger``: one transaction per order. account = customer, date =
  order date, amount = total price, positive (income) for finished orders and
  negative otherwise; description = a merchant text chosen by order key plus
  " #<orderkey>".
* ``events_ledger``: one transaction per event. account = user, date = event
  day, amount = value, positive for purchases and negative otherwise.

The merchant texts cover every category, keyword ties, multi-category texts,
substring surprises ("current" contains "rent") and texts with no keyword.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Merchant texts used to describe derived transactions (our own test data).
MERCHANTS: tuple[str, ...] = (
    "PAYROLL MONTHLY RUN",
    "STRIPE PAYOUT 77",
    "ADP PAYROLL SERVICE",
    "GUSTO RUN",
    "RENT UNIT NINE",
    "WEWORK DESK",
    "XFINITY BY COMCAST",
    "ELECTRIC BILL PG&E WEST",
    "STAPLES AND PAPER",
    "GITHUB TEAM PLAN",
    "AWS EU REGION",
    "NETFLIX PLAN",
    "UBER 6AM RIDE",
    "UBER EATS DINNER",
    "DELTA AIR TICKET",
    "HILTON HOTEL NIGHT",
    "STARBUCKS CORNER",
    "CHIPOTLE BOWL",
    "GOOGLE ADS SPRING",
    "FACEBOOK ADS REACH",
    "LEGALZOOM FILING",
    "CONSULTING BY THE HOUR",
    "STATE FARM INSURANCE",
    "IRS QUARTERLY TAX PAYMENT",
    "CARD SERVICE FEE",
    "OVERDRAFT CHARGE",
    "WHOLE FOODS BASKET",
    "TRADER JOE BASKET",
    "COSTCO BULK",
    "AMC THEATRES EVENING",
    "TICKETMASTER SEAT",
    "AMZN MARKET AMAZON",
    "WALMART AISLE",
    "TARGET AISLE",
    "TRANSFER TO SAVINGS VIA ZELLE",
    "CASH APP FRIEND",
    "CURRENT SERVICE LEASED",
    "COFFEE WATER AND TEA",
    "ZOOM SLACK FIGMA",
    "CAFE IN THE HOTEL",
    "CAFE RIDE LYFT",
    "QQ17 UNKNOWN VENDOR",
    "ODDS AND ENDS",
    "CHECK 20881",
    "CASH MACHINE 900800700600",
    "PAID MARY.MAJOR@MAIL.TEST",
)


MIN_PARTITIONS = "spark.cashweave.tables.minPartitions"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table. These are single row groups, so one task reads each; where
    the session sets ``spark.cashweave.tables.minPartitions`` (the benchmark
    does), rows are dealt to that many tasks. Large tables have many splits and
    need no such setting; it is unset by default."""
    rows = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    least = int(spark.conf.get(MIN_PARTITIONS, "0"))
    return rows.repartition(least) if least > 1 else rows


def merchant_for(key: Column) -> Column:
    arr = F.array(*[F.lit(m) for m in MERCHANTS])
    return F.element_at(arr, (F.pmod(key, F.lit(len(MERCHANTS))) + 1).cast("int"))


def merchant_sql(key_sql: str) -> str:
    lst = ", ".join("'" + m.replace("'", "''") + "'" for m in MERCHANTS)
    return f"list_extract([{lst}], CAST(({key_sql}) % {len(MERCHANTS)} AS INTEGER) + 1)"


def orders_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(account_id, transaction_date, amount, description, row_ord)."""
    o = table(spark, sf_dir, "orders")
    price = F.col("o_totalprice").cast("decimal(18,2)")
    return o.select(
        F.col("o_custkey").alias("account_id"),
        F.to_date("o_orderdate").alias("transaction_date"),
        F.when(F.col("o_orderstatus") == "F", price).otherwise(-price).alias("amount"),
        F.concat(merchant_for(F.col("o_orderkey")), F.lit(" #"), F.col("o_orderkey").cast("string"))
        .alias("description"),
        F.col("o_orderkey").alias("row_ord"),
    )


def events_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(account_id, transaction_date, amount, description, row_ord)."""
    e = table(spark, sf_dir, "events")
    value = F.col("value").cast("decimal(18,2)")
    return e.select(
        F.col("user_id").alias("account_id"),
        F.to_date("ts").alias("transaction_date"),
        F.when(F.col("event_type") == "purchase", value).otherwise(-value).alias("amount"),
        F.concat(merchant_for(F.col("event_id")), F.lit(" #"), F.col("event_id").cast("string"))
        .alias("description"),
        F.col("event_id").alias("row_ord"),
    )


def customer_balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starting balance per account: the customer's account balance."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("account_id"),
        F.col("c_acctbal").cast("double").alias("starting_balance"))


ORDERS_LEDGER_SQL = f"""
SELECT o_custkey AS account_id,
       CAST(o_orderdate AS DATE) AS transaction_date,
       CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS DECIMAL(18,2))
            ELSE -CAST(o_totalprice AS DECIMAL(18,2)) END AS amount,
       {merchant_sql('o_orderkey')} || ' #' || CAST(o_orderkey AS VARCHAR) AS description,
       o_orderkey AS row_ord
FROM orders
"""

EVENTS_LEDGER_SQL = f"""
SELECT user_id AS account_id,
       CAST(ts AS DATE) AS transaction_date,
       CASE WHEN event_type = 'purchase' THEN CAST(value AS DECIMAL(18,2))
            ELSE -CAST(value AS DECIMAL(18,2)) END AS amount,
       {merchant_sql('event_id')} || ' #' || CAST(event_id AS VARCHAR) AS description,
       event_id AS row_ord
FROM events
"""

CUSTOMER_BALANCES_SQL = """
SELECT c_custkey AS account_id, CAST(c_acctbal AS DOUBLE) AS starting_balance FROM customer
"""


# Question templates for the per-customer question table (our own test data).
# {amount} and {category} are filled from the customer key.
QUESTION_TEMPLATES: tuple[str, ...] = (
    "How long is the runway now?",
    "Do we go broke this year?",
    "Can I afford a new machine at ${amount}?",
    "Should I get a second van?",
    "What have we spent on {category} this month?",
    "Is our coffee spending high?",
    "How high was spending lately?",
    "What did the repairs cost?",
    "Which marketing goals do we have?",
    "Give me an overview",
)


def _template_parts(t: str) -> list[tuple[str, str]]:
    """Split a template into ("lit", text) / ("amount"|"category", "") parts."""
    parts: list[tuple[str, str]] = []
    rest = t
    while rest:
        i = min([p for p in (rest.find("{amount}"), rest.find("{category}")) if p >= 0], default=-1)
        if i < 0:
            parts.append(("lit", rest))
            break
        if i > 0:
            parts.append(("lit", rest[:i]))
        if rest.startswith("{amount}", i):
            parts.append(("amount", ""))
            rest = rest[i + len("{amount}"):]
        else:
            parts.append(("category", ""))
            rest = rest[i + len("{category}"):]
    return parts


def customer_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One question per customer: (question_id, account_id, question,
    starting_balance). The template, amount and category follow the key."""
    from cashweave.schema import TAX_CATEGORIES
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    amount = F.format_number(F.pmod(key * 37, F.lit(5000)) + 5, 0)
    cats = F.array(*[F.lit(x) for x in TAX_CATEGORIES])
    category = F.element_at(cats, (F.pmod(F.floor(key / 10), F.lit(len(TAX_CATEGORIES))) + 1).cast("int"))
    texts = []
    for t in QUESTION_TEMPLATES:
        pieces = [F.lit(v) if kind == "lit" else (amount if kind == "amount" else category)
                  for kind, v in _template_parts(t)]
        texts.append(F.concat(*pieces))
    idx = (F.pmod(key, F.lit(len(QUESTION_TEMPLATES))) + 1).cast("int")
    return c.select(key.alias("question_id"), key.alias("account_id"),
                    F.element_at(F.array(*texts), idx).alias("question"),
                    F.col("c_acctbal").cast("double").alias("starting_balance"))


def _questions_sql() -> str:
    from cashweave.schema import TAX_CATEGORIES
    cats = ", ".join("'" + x.replace("'", "''") + "'" for x in TAX_CATEGORIES)
    amount = "format('{:,}', (c_custkey * 37) % 5000 + 5)"
    category = f"list_extract([{cats}], CAST((c_custkey // 10) % {len(TAX_CATEGORIES)} AS INTEGER) + 1)"
    texts = []
    for t in QUESTION_TEMPLATES:
        pieces = []
        for kind, v in _template_parts(t):
            if kind == "lit":
                pieces.append("'" + v.replace("'", "''") + "'")
            else:
                pieces.append(amount if kind == "amount" else category)
        texts.append(" || ".join(pieces))
    return (f"SELECT c_custkey AS question_id, c_custkey AS account_id, "
            f"list_extract([{', '.join(texts)}], CAST(c_custkey % {len(QUESTION_TEMPLATES)} AS INTEGER) + 1) "
            f"AS question, CAST(c_acctbal AS DOUBLE) AS starting_balance FROM customer")


QUESTIONS_SQL = _questions_sql()
