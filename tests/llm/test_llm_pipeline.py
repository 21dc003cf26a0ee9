"""The corpus pipeline against a brute-force version, stage by stage."""

from __future__ import annotations

import brute
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cashweave.llm import language_id
from cashweave.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_stages_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        if name == "language_id":
            scores = {r.doc.doc_id: r.score for r in language_id.identify(docs).collect()}
            want = {i: t for i, t in rows.items() if t and any(c.isalpha() for c in t) and scores[i] >= 0.5}
        elif name == "line_dedup":
            want = {i: v[2] for i, v in brute.drop_lines(rows.items()).items()}
        elif name == "simhash_near_dedup":
            groups = brute.components({i: brute.fingerprint(t) for i, t in rows.items()})
            want = {i: t for i, t in rows.items() if groups[i] == i}
        else:
            bad = brute.contamination(rows.items(), items)
            want = {i: t for i, t in rows.items() if not bad[i][4]}
        got = out.collect()
        assert len(got) == len(want) and {r.doc_id: r.text for r in got} == want, name
        assert all(r.n_chars == len(r.text) for r in got if name == "line_dedup")
        rows = want
        docs = spark.createDataFrame(got, docs.schema)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == set(rows)
    assert {(r.doc_id, r.piece) for r in corpus_pipeline.run(spark, SF).collect()} == {(r.doc_id, r.piece) for r in packed}


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None)], [(1, None, "en", "s", 0), (2, "", None, None, None)]])
def test_stages_of_empty_and_null_tables(spark, rows):
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{SF}/documents.parquet").schema)
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).collect()


def test_documents_stay_if_no_language_can_be_learned(spark):
    rows = [(1, "plain words", None, "s", 11), (2, "123 !?", None, "s", 6), (3, None, None, "s", 0), (4, "слова", None, "s", 5)]
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{SF}/documents.parquet").schema)
    assert {r.doc_id for r in corpus_pipeline.identify_language(spark, docs, SF).collect()} == {1, 4}


def test_the_prediction_decides_which_documents_stay(spark, monkeypatch):
    """Three labels of one text leave it a third each, which is no language."""
    texts = {"en": "the plain words of a page", "fr": "où est la bibliothèque", **dict.fromkeys(("xx", "yy", "zz"), "dddd eeee dddd")}
    rows = [(10 * k + i, t, lang, "s", len(t)) for k, (lang, t) in enumerate(texts.items()) for i in range(10)]
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{SF}/documents.parquet").schema)
    keep = corpus_pipeline.identify_language

    def kept(**options):
        return {r.doc_id for r in keep(spark, docs, SF, **options).collect()}

    assert kept() == set(range(20)) and kept(languages=["fr"]) == set(range(10, 20)) and kept(languages=[]) == set()
    assert kept(least_score=0.3) == set(range(50))
    identify = language_id.identify
    monkeypatch.setattr(language_id, "identify", lambda d: identify(d).withColumn("lang_pred", F.lit("und")))
    assert kept() != set(range(20))


def test_every_operator_is_registered():
    assert [n.split("_")[0] for n in QUERIES] == [*(f"op{n}" for n in range(1, 14)), "pipeline"]
    assert set(ORACLES) <= set(QUERIES)
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == [
        "identify_language", "drop_lines", "drop_near_duplicates", "drop_contaminated", "pack_sequences"]
