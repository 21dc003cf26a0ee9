import math

from pyspark.sql import functions as F

from cashweave.functions.embeddings import with_embedding
from cashweave.operators.notes import note_count, prepare_notes, search_notes, upsert_notes


def _emb(spark, texts, dim):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return {r.i: r.e for r in with_embedding(df, "t", "e", dim).collect()}


def _cos(a, b):
    m = dict(zip(b.idx, b.cnt))
    dot = sum(c * m.get(i, 0) for i, c in zip(a.idx, a.cnt))
    return 0.0 if not a.sumsq or not b.sumsq else dot / (math.sqrt(a.sumsq) * math.sqrt(b.sumsq))


def test_embedding_matches_python(spark):
    import hashlib
    import re
    text = "Autumn money for signs, SIGNS! a b2 x_1"
    e = _emb(spark, [text, ""], 128)
    toks = [t.lower() for t in re.findall(r"[A-Za-z][A-Za-z0-9_]+", text)]
    counts = {}
    for t in toks:
        b = int.from_bytes(hashlib.md5(t.encode()).digest()[:4], "big") % 128
        counts[b] = counts.get(b, 0) + 1
    assert dict(zip(e[0].idx, e[0].cnt)) == counts
    assert e[1].idx == [] and e[1].sumsq == 0


def test_near_beats_far(spark):
    e = _emb(spark, ["money for painted signs", "money planned for painted signs", "lamps with green shades"], 128)
    assert _cos(e[0], e[1]) > _cos(e[0], e[2])


def test_store_search_upsert(spark):
    b = spark.createDataFrame([("Marketing gets a fifth more money in autumn", 0), ("Two more drivers start in May", 1),
                               ("Monthly costs stay below forty thousand", 2), ("   ", 3)], "text string, o int")
    acc, rej = prepare_notes(b, order_by="o")
    assert rej.count() == 1
    store = upsert_notes(None, acc)
    assert note_count(store).first().notes == 3
    q = spark.createDataFrame([(1, "what money does marketing get"), (2, "12 34 !!")],
                              "question_id long, question string")
    hits = search_notes(store, q, k=2).orderBy("question_id", "rank").collect()
    assert hits[0].question_id == 1 and "Marketing" in hits[0].text
    assert all(h.question_id == 1 for h in hits)     # a text without tokens scores 0
    b2 = spark.createDataFrame([("note-1", "first", 0), ("note-1", "second", 1)], "id string, text string, o int")
    acc2, _ = prepare_notes(b2, id_col="id", order_by="o")
    s2 = upsert_notes(store, acc2)
    got = s2.where("id = 'note-1'").collect()
    assert len(got) == 1 and got[0].text == "second"
    assert note_count(s2).first().notes == 4


def test_search_blocks_equal_single_pass(spark):
    texts = [f"note about topic {i % 7} and money {i % 3} day{i}" for i in range(60)]
    b = spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "text string, o int")
    store = upsert_notes(None, prepare_notes(b, order_by="o")[0])
    q = spark.createDataFrame([(i, f"topic {i} money {i % 3}") for i in range(9)], "question_id long, question string")
    one = search_notes(store, q, k=4).select("question_id", "rank", "id").collect()
    many = search_notes(store, q, k=4, question_block=2, note_block=7).select("question_id", "rank", "id").collect()
    assert sorted(one) == sorted(many)


def test_empty_store(spark):
    b = spark.createDataFrame([], "text string, o int")
    store = upsert_notes(None, prepare_notes(b, order_by="o")[0])
    q = spark.createDataFrame([(1, "anything")], "question_id long, question string")
    assert search_notes(store, q).count() == 0


def test_persist_round_trip(spark, tmp_path):
    from cashweave.sinks.writers import write_notes
    from cashweave.sources.exports import read_notes
    b = spark.createDataFrame([("Cash should last a year and a half", {"type": "goal"}, 0)],
                              "text string, metadata map<string,string>, o int")
    store = upsert_notes(None, prepare_notes(b, metadata="metadata", order_by="o")[0])
    base = str(tmp_path / "notes")
    write_notes(store, base, version=1)
    write_notes(store, base, version=2)
    (tmp_path / "notes" / "v=00000003").mkdir()          # not complete
    back = read_notes(spark, base)
    assert back.count() == 1
    r = back.first()
    assert r.text == "Cash should last a year and a half" and r.metadata["type"] == "goal"
    q = spark.createDataFrame([(1, "how long should cash last")], "question_id long, question string")
    assert search_notes(back, q).count() == 1
    assert read_notes(spark, str(tmp_path / "missing")).count() == 0


def test_later_batches_continue_the_numbering(spark):
    first = upsert_notes(None, prepare_notes(spark.createDataFrame([("alpha note", 0), ("beta note", 1)], "text string, o int"), order_by="o")[0])
    more = prepare_notes(spark.createDataFrame([("alpha note", 0), ("gamma note", 1)], "text string, o int"), order_by="o")[0]
    got = [r.text for r in upsert_notes(first, more).orderBy("seq").collect()]
    assert got == ["beta note", "alpha note", "gamma note"]


def test_search_with_an_embedder_of_ones_own(spark):
    def embed(df, text, out):
        return df.withColumn(out, F.array(F.length(text).cast("double"), F.lit(1.0)))

    b = spark.createDataFrame([("aa", 0), ("a" * 50, 1)], "text string, o int")
    store = upsert_notes(None, prepare_notes(b, order_by="o", embed=embed)[0])
    q = spark.createDataFrame([(1, "a" * 40)], "question_id long, question string")
    assert [h.text for h in search_notes(store, q, k=1, embed=embed).collect()] == ["a" * 50]


def test_dense_search_of_ragged_null_and_empty_vectors(spark):
    from cashweave.operators.notes import search_vectors
    items = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [0.5, 0.5]), (7, [None, 1.0]), (8, [-1.0, 0.0])],
                                  "seq long, vec array<double>")
    queries = spark.createDataFrame([(1, [2.0, 0.0]), (2, [3.0]), (3, None), (4, [])], "question_id long, qvec array<double>")
    got = sorted((r.question_id, r.rank, r.seq, round(r.score, 6)) for r in search_vectors(items, queries).collect())
    assert got == [(1, 1, 1, 1.0), (1, 2, 6, 0.707107), (2, 1, 2, 1.0)]
    assert search_vectors(items, queries.limit(0)).count() == 0


def test_search_holds_no_block_of_vectors_in_a_row(spark):
    b = spark.createDataFrame([(f"note {i} about cash", i) for i in range(20)], "text string, o int")
    store = upsert_notes(None, prepare_notes(b, order_by="o")[0])
    q = spark.createDataFrame([(i, "cash note") for i in range(50)], "question_id long, question string")
    hits = search_notes(store, q, k=2)
    assert "collect_list" not in hits._jdf.queryExecution().executedPlan().toString()
    assert hits.count() == 100                      # equal questions have equal hits


def test_tiles_keep_the_best_of_any_vectors():
    import numpy as np
    import pyarrow as pa

    from cashweave.operators.notes import _best_notes, _drop_unscored, _Rows

    def rows(m, keys):
        lens = np.full(len(m), m.shape[1])
        return _Rows(pa.array(keys), lens, np.tile(np.arange(m.shape[1]), len(m)), m.ravel(), np.sqrt((m * m).sum(axis=1)))

    r = np.random.default_rng(5)
    for low in (-3, 0):                             # few values, so many scores are equal
        notes, asked = (r.integers(low, 4, (n, 6)).astype(float) for n in (3000, 1100))
        notes[7], asked[3] = np.nan, 0.0
        held, qs = _drop_unscored(rows(notes, np.arange(3000)[::-1].copy())), _drop_unscored(rows(asked, np.arange(1100)))
        got = {}
        for col, row, score in _best_notes(held, qs, 4):
            for c, s, v in zip(qs.keys.take(pa.array(col)).to_pylist(), held.keys.take(pa.array(row)).to_pylist(), score):
                got.setdefault(c, []).append((s, v))
        m = notes[::-1]                             # by key
        dots, scale = m @ asked.T, np.sqrt((m * m).sum(axis=1))[:, None] * np.sqrt((asked * asked).sum(axis=1))[None, :]
        scores = np.divide(dots, scale, out=np.zeros(dots.shape), where=scale > 0)
        for c in range(0, 1100, 7):
            best = [(int(s), scores[s, c]) for s in np.lexsort((np.arange(3000), -scores[:, c])) if scores[s, c] > 0][:4]
            assert got.get(c, []) == best, c
