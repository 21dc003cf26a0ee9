"""Content hashes (X6) and note ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cashweave.functions.amounts import canon_amount_text
from cashweave.functions.dates import iso_date
from cashweave.functions.text import canon_description


def content_hash(date: Column | str, amount: Column | str, description: Column | str) -> Column:
    """SHA-256 hex of "date|amount|description" in canonical text form."""
    payload = F.concat_ws("|", iso_date(date), canon_amount_text(amount), canon_description(description))
    return F.sha2(payload, 256)


def stable_note_id(text: Column | str) -> Column:
    """First 16 hex characters of SHA-1 of the untrimmed note text."""
    col = F.col(text) if isinstance(text, str) else text
    return F.substring(F.sha1(col), 1, 16)
