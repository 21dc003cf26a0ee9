"""Canonical schema and the fixed vocabularies the engine must agree on.

Everything under "Fixed values" must stay equal to the behaviour we match:
the canonical column order, the tax taxonomy and its order, the keyword
lexicon and its order, the header aliases, the masking patterns and the
question-routing words.
"""

from __future__ import annotations

from pyspark.sql import types as T


class IngestionError(ValueError):
    """A file or frame cannot be normalised (missing columns, bad type, ...)."""


# ---------------------------------------------------------------------------
# Fixed values
# ---------------------------------------------------------------------------

CANONICAL_COLUMNS: tuple[str, ...] = (
    "transaction_date",
    "amount",
    "description",
    "source",
    "raw_hash",
    "category",
    "ai_confidence_score",
)

# Tax buckets, in priority order (ties between categories go to the earlier one).
TAX_CATEGORIES: tuple[str, ...] = (
    "Income",
    "Payroll",
    "Rent",
    "Utilities",
    "Office Supplies",
    "Software & Subscriptions",
    "Travel",
    "Meals",
    "Advertising",
    "Professional Services",
    "Insurance",
    "Taxes & Fees",
    "Bank Fees",
    "Groceries",
    "Entertainment",
    "Shopping",
    "Transfers",
    "Uncategorized",
)

# Keyword -> category, in lexicon order. A keyword scores its length when it
# occurs as a substring of the lower-cased description.
KEYWORD_LEXICON: tuple[tuple[str, str], ...] = (
    ("payroll", "Income"),
    ("salary", "Income"),
    ("direct deposit", "Income"),
    ("stripe payout", "Income"),
    ("invoice", "Income"),
    ("ach credit", "Income"),
    ("gusto", "Payroll"),
    ("adp payroll", "Payroll"),
    ("paychex", "Payroll"),
    ("rent", "Rent"),
    ("lease", "Rent"),
    ("wework", "Rent"),
    ("electric", "Utilities"),
    ("pg&e", "Utilities"),
    ("comcast", "Utilities"),
    ("xfinity", "Utilities"),
    ("att internet", "Utilities"),
    ("verizon", "Utilities"),
    ("water", "Utilities"),
    ("staples", "Office Supplies"),
    ("office depot", "Office Supplies"),
    ("best buy", "Office Supplies"),
    ("github", "Software & Subscriptions"),
    ("openai", "Software & Subscriptions"),
    ("anthropic", "Software & Subscriptions"),
    ("aws", "Software & Subscriptions"),
    ("google cloud", "Software & Subscriptions"),
    ("gcp", "Software & Subscriptions"),
    ("digitalocean", "Software & Subscriptions"),
    ("heroku", "Software & Subscriptions"),
    ("notion", "Software & Subscriptions"),
    ("figma", "Software & Subscriptions"),
    ("slack", "Software & Subscriptions"),
    ("zoom", "Software & Subscriptions"),
    ("netflix", "Software & Subscriptions"),
    ("spotify", "Software & Subscriptions"),
    ("adobe", "Software & Subscriptions"),
    ("uber", "Travel"),
    ("lyft", "Travel"),
    ("delta air", "Travel"),
    ("united airlines", "Travel"),
    ("southwest air", "Travel"),
    ("airbnb", "Travel"),
    ("hotel", "Travel"),
    ("marriott", "Travel"),
    ("hilton", "Travel"),
    ("starbucks", "Meals"),
    ("chipotle", "Meals"),
    ("doordash", "Meals"),
    ("ubereats", "Meals"),
    ("uber eats", "Meals"),
    ("restaurant", "Meals"),
    ("cafe", "Meals"),
    ("coffee", "Meals"),
    ("facebook ads", "Advertising"),
    ("meta ads", "Advertising"),
    ("google ads", "Advertising"),
    ("linkedin ads", "Advertising"),
    ("tiktok ads", "Advertising"),
    ("legalzoom", "Professional Services"),
    ("law firm", "Professional Services"),
    ("accountant", "Professional Services"),
    ("consulting", "Professional Services"),
    ("insurance", "Insurance"),
    ("geico", "Insurance"),
    ("state farm", "Insurance"),
    ("irs", "Taxes & Fees"),
    ("tax payment", "Taxes & Fees"),
    ("franchise tax", "Taxes & Fees"),
    ("service fee", "Bank Fees"),
    ("overdraft", "Bank Fees"),
    ("atm fee", "Bank Fees"),
    ("wire fee", "Bank Fees"),
    ("whole foods", "Groceries"),
    ("trader joe", "Groceries"),
    ("safeway", "Groceries"),
    ("kroger", "Groceries"),
    ("costco", "Groceries"),
    ("amc theatres", "Entertainment"),
    ("ticketmaster", "Entertainment"),
    ("steam games", "Entertainment"),
    ("amazon", "Shopping"),
    ("amzn", "Shopping"),
    ("target", "Shopping"),
    ("walmart", "Shopping"),
    ("ebay", "Shopping"),
    ("transfer to", "Transfers"),
    ("transfer from", "Transfers"),
    ("venmo", "Transfers"),
    ("zelle", "Transfers"),
    ("cash app", "Transfers"),
)

# Lower-cased, trimmed bank header -> canonical column. "_debit"/"_credit" are
# the split-amount columns merged into "amount".
COLUMN_ALIASES: dict[str, str] = {
    "date": "transaction_date",
    "transaction date": "transaction_date",
    "posting date": "transaction_date",
    "post date": "transaction_date",
    "trans date": "transaction_date",
    "transaction_date": "transaction_date",
    "amount": "amount",
    "amt": "amount",
    "transaction amount": "amount",
    "debit": "_debit",
    "credit": "_credit",
    "withdrawal": "_debit",
    "deposit": "_credit",
    "description": "description",
    "desc": "description",
    "memo": "description",
    "details": "description",
    "narration": "description",
    "payee": "description",
}

REQUIRED_COLUMNS: tuple[str, ...] = ("transaction_date", "amount", "description")

# Texts that mean "no amount" once trimmed and lower-cased.
NULL_AMOUNT_TOKENS: tuple[str, ...] = ("nan", "none", "null")

# Characters removed from amount text before parsing.
AMOUNT_STRIP_CHARS: tuple[str, ...] = ("$", "€", "£", ",", " ")

# Question routing, checked in this order; word-bounded, case-insensitive.
INTENT_PATTERNS: tuple[tuple[str, str], ...] = (
    ("runway", r"(?i)\b(runway|cash out|death date|go broke|out of cash)\b"),
    ("affordability", r"(?i)\b(afford|can i (buy|spend|get)|should i (buy|get))\b"),
    ("category_spend", r"(?i)\b(spend|spent|spending|cost)\b"),
)
GENERAL_INTENT = "general"

# First number in a question, dollar sign and commas allowed.
QUESTION_AMOUNT_PATTERN = r"\$?\s*([0-9][0-9,]*(?:\.[0-9]+)?)"

# Category words in questions, checked after the category names themselves.
CATEGORY_SYNONYMS: tuple[tuple[str, str], ...] = (
    ("food", "Meals"),
    ("restaurant", "Meals"),
    ("dining", "Meals"),
    ("coffee", "Meals"),
    ("gas", "Travel"),
    ("flights", "Travel"),
    ("uber", "Travel"),
    ("subscription", "Software & Subscriptions"),
    ("saas", "Software & Subscriptions"),
    ("ads", "Advertising"),
    ("marketing", "Advertising"),
    ("rent", "Rent"),
    ("office", "Office Supplies"),
)

# Token pattern of the hashing embedder.
TOKEN_PATTERN = r"([A-Za-z][A-Za-z0-9_]+)"
DEFAULT_EMBED_DIM = 256

# ---------------------------------------------------------------------------
# Spark types
# ---------------------------------------------------------------------------

AMOUNT_TYPE = T.DecimalType(38, 18)

CANONICAL_SCHEMA = T.StructType([
    T.StructField("transaction_date", T.DateType(), False),
    T.StructField("amount", AMOUNT_TYPE, False),
    T.StructField("description", T.StringType(), False),
    T.StructField("source", T.StringType(), False),
    T.StructField("raw_hash", T.StringType(), False),
    T.StructField("category", T.StringType(), True),
    T.StructField("ai_confidence_score", T.DoubleType(), True),
])

NOTE_SCHEMA = T.StructType([
    T.StructField("id", T.StringType(), True),
    T.StructField("text", T.StringType(), True),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType()), True),
    T.StructField("embedding", T.ArrayType(T.DoubleType()), True),
    T.StructField("seq", T.LongType(), True),
])
