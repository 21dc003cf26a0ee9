"""The registered queries of the operators, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cashweave.llm import alignment, bpe_words, decontaminate, html_text, importance, language_id, line_dedup, packing, simhash
from cashweave.llm import token_counts, token_files, topk_search, warc
from cashweave.llm.common import stored, table
from cashweave.llm.token_ids import default_tokenizer


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents").select("doc_id", "text"),
                                        table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
                        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read_coded(token_files.write_coded(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "capture_no")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    trees = language_id.fit(docs.filter(~language_id.held_out()))
    return language_id.predict(docs.select("doc_id", "text"), trees).select(
        "doc.doc_id", language_id.held_out("doc.doc_id").alias("held_out"), "lang_pred", "score")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document of the flat files: its number over all files, the ids
    before it, its own."""
    files = token_files.write_flat(table(spark, sf_dir, "documents").select("doc_id", "text"))
    end = token_files.end_of_document(default_tokenizer())
    found = token_counts.counts(files, end, token_files.flat_type(end))
    return token_counts.named(found, files).select("doc_id", "ordinal", "start", "n_tokens")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc.doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


def op8_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = stored(topk_search.integer_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")), "vectors")
    return topk_search.top_k(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html")) \
        .select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")) \
        .select("doc_id", "n_features", "weight", "score", "rank")


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_words.stored_digests(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment(table(spark, sf_dir, "documents").select("doc_id", "text"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_decontamination, op2_token_files, op3_warc, op4_language_id, op5_simhash, op6_token_counts, op7_line_dedup,
    op8_topk_search, op9_main_text, op10_packing, op11_importance, op12_bpe, op13_alignment, pipeline)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES = {
    "op7_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), often AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT k.doc_id, k.pos, k.line, (o.key IS NOT NULL AND k.doc_id <> o.keeper) AS dropped
  FROM keyed k LEFT JOIN often o ON k.key = o.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
}
