"""The corpus pipeline: language ID, line dedup, near-dedup, decontamination, packing.

Each stage takes the rows its predecessor kept (written as Parquet and read
again) and returns a DataFrame; all but the last return the columns of their
input. See the operators for nulls, ties, repeated rows and empty tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cashweave.llm import decontaminate, language_id, line_dedup, packing, simhash
from cashweave.llm.common import scratch_dir, table

LEAST_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str, languages: Sequence[str] | None = None,
                      least_score: float = LEAST_SCORE) -> DataFrame:
    """Documents in a language stay: those whose predicted language has a score
    of ``least_score`` or more, so is likelier than all others together, and is
    one of ``languages``, if they are given. Null texts and texts without a
    letter are in none. Where no language could be learned (no labelled rows),
    every text with a letter stays. Repeated rows are judged alike."""
    letters = F.coalesce(F.col("doc.text").rlike(r"\p{L}"), F.lit(False))
    lang = F.col("lang_pred")
    wanted = F.lit(True) if languages is None else lang.isin(*languages)
    # a text with letters is unknown only if there are no languages
    stays = F.when(lang == language_id.UNKNOWN, letters).otherwise((F.col("score") >= least_score) & wanted)
    return language_id.identify(docs).filter(stays).select("doc.*")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines held by many documents stay in one; ``n_chars`` follows the text."""
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return line_dedup.dedup_lines(docs).select(*[new.get(c, F.col("doc")[c]).alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the least id stays."""
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with at least one in twenty words in benchmark passages go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents that are left, with their place in a sequence."""
    return packing.pack(docs.select("doc_id", "text"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("best_fit_packing", pack_sequences),
]

# Language ID and packing are not SQL-expressible; tests/llm compares run()
# with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = scratch_dir(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
