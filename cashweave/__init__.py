"""cashweave: cash-flow analytics over many ledgers as Spark DataFrame operators.

Every operator takes and returns ``pyspark.sql.DataFrame`` objects (or
``Column`` expressions) so Catalyst plans the whole job. Ledgers are
separated by an ``account_id`` column; a table without one is treated as a
single ledger.
"""

from cashweave.schema import CANONICAL_COLUMNS, TAX_CATEGORIES, IngestionError

__all__ = ["CANONICAL_COLUMNS", "TAX_CATEGORIES", "IngestionError"]
