"""Column-level functions (JVM expressions only; no Python UDFs)."""

from cashweave.functions.amounts import canon_amount_text, coerce_amount, money_text, percent_text
from cashweave.functions.dates import coerce_date, iso_date
from cashweave.functions.text import canon_description, py_strip, tokenize
from cashweave.functions.hashing import content_hash, stable_note_id
from cashweave.functions.pii import mask_pii

__all__ = [
    "canon_amount_text", "coerce_amount", "money_text", "percent_text",
    "coerce_date", "iso_date", "canon_description", "py_strip", "tokenize",
    "content_hash", "stable_note_id", "mask_pii",
]
