"""Importance resampling, BPE by distinct words and tokenizer alignment against
plain versions: nulls, empty and long texts, ties, repeated rows, empty tables
and columns of clashing names."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from brute import words
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cashweave.llm import alignment, bpe_words, importance

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")
NAMES = "doc_id long, text string, word string, pos int, row long, ids string, n long, score string, rank string, bucket int, links int, tie long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, *[None] * 10) for r in rows], NAMES)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    vocabulary = "the of and over Übung stone light house été garden quick 日本 brown fox's don't 2031 3rd, (so) x-y   tall".split(" ")
    rows = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 70)))) for k in range(60)]
    signs = list("ab c d'st  \n\t.,<|>▁é日ß ​\x1c　123\u0085\U0001F600") + ["<|endoftext|>", "<s>", "'re", " the"]
    rows += [(100 + k, "".join(rng.choice(signs) for _ in range(rng.randint(1, 60)))) for k in range(150)]
    rows += [(500, None), (501, ""), (502, "   \n\n "), (503, "<|endoftext|><|endoftext|>"), (504, "a  <|endoftext|> b!!<|endoftext|>"),
             (505, "!" * 30_000), (506, " ".join(rng.choice(vocabulary) for _ in range(20_000))), (507, "x" * 5_000), (508, " " * 3_000),
             (600, rows[3][1]), (601, rows[3][1]), (602, rows[3][1]), (None, "a row without an id"), (None, "another such row"),
             (7, rows[7][1]), (7, rows[7][1])]
    return rows


# ---- importance ---------------------------------------------------------------

def resampled(docs, target, share=25, min_words=20):
    """[(doc_id, n_features, weight, score, rank)], sorted, of the plain definition."""
    def features(text):
        w = words(text)
        return [zlib.crc32(x.encode()) % 10_000 for x in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]

    found = [features(t) for _, t in docs]
    s, t = Counter(b for f in found for b in f), Counter(b for _, x in target for b in features(x))
    big_s, big_t = float(sum(s.values()) + 10_000), float(sum(t.values()) + 10_000)
    gain = [math.floor(1000 * math.log((t[b] + 1) * big_s / ((s[b] + 1) * big_t))) for b in range(10_000)]
    rows = []
    for (doc_id, text), f in zip(docs, found):
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text))])
    able = sorted((r for r in rows if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, row in enumerate(able[:share * len(able) // 100], 1):
        row[4] = rank
    return rows


def plain(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is None, x or 0) for x in r))


def test_resampling_matches_the_definition(spark, texts):
    target = [(1, "the quick brown fox over stone"), (2, "light house garden"), (3, None), (4, "")]
    got = importance.resample(frame(spark, texts).repartition(5), spark.createDataFrame(target, "item_id long, text string")) \
        .select("doc_id", "n_features", "weight", "score", "rank").collect()
    want = resampled(texts, target)
    assert plain(got) == plain(r[:5] for r in want)
    assert sum(r.rank is not None for r in got) == sum(r[5] >= 20 for r in want) * 25 // 100 > 5


def test_resampling_of_equal_texts_draws_each_row_once(spark):
    docs = [(k % 40, "one two three four five " * 5) for k in range(120)]
    got = importance.resample(spark.createDataFrame(docs, "doc_id long, text string").repartition(4),
                              spark.createDataFrame([(1, "one two")], "item_id long, text string"), share=50).collect()
    assert sorted(r.rank for r in got if r.rank) == list(range(1, 61))
    want = resampled(docs, [(1, "one two")], share=50)
    assert sorted((r.rank, r.doc_id) for r in got if r.rank) == sorted((r[4], r[0]) for r in want if r[4])


def test_resampling_without_rows_target_or_eligible_documents(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    assert importance.resample(none, some).count() == 0
    got = importance.resample(some, none.select("text")).select("doc_id", "n_features", "weight", "rank").collect()
    assert [(r.doc_id, r.n_features, r.rank) for r in sorted(got)] == [(1, 5, None), (2, 0, None)]
    assert plain(r[:4] for r in importance.resample(some, none).select("doc_id", "n_features", "weight", "score").collect()) \
        == plain(r[:4] for r in resampled([(1, "a b c"), (2, None)], []))


def test_longer_runs_of_words(spark):
    assert importance.spans_crc("A b;c", importance.scanner(3)) == (3, [zlib.crc32(x) for x in (
        b"a", b"a b", b"a b c", b"b", b"b c", b"c")])


# ---- BPE by distinct words ------------------------------------------------------

def coded(rows):
    tok = Tokenizer.from_file(BYTE_BPE)
    out = []
    for doc_id, text in rows:
        ids = tok.encode(text or "", add_special_tokens=False).ids
        out.append((doc_id, tuple(ids), tok.decode(ids, skip_special_tokens=False)))
    return sorted(out, key=str)


@pytest.mark.parametrize("max_bytes", [1 << 30, 2_000, 1])
def test_ids_and_texts_are_the_librarys(spark, texts, max_bytes):
    docs = frame(spark, texts).repartition(5, "text")
    got = bpe_words.decode(bpe_words.encode(docs, max_bytes=max_bytes)).collect()
    assert sorted(((r.doc_id, tuple(r.ids), r.text) for r in got), key=str) == coded(texts)
    assert all(r.text == (t or "") for r, t in zip(sorted(got, key=str), [x[2] for x in coded(texts)]))


def test_each_distinct_word_is_encoded_once(spark, texts):
    table = bpe_words.word_table(frame(spark, texts), BYTE_BPE)
    assert table.count() == table.select("word").distinct().count()
    frequent, least, rest = bpe_words.frequent_words(table, 2_000)
    assert 0 < frequent.count() and frequent.agg(F.min("n")).first()[0] >= least
    assert table.filter(F.col("n") < least).count() == rest > 0


def test_words_are_the_librarys_for_all_kinds_of_signs(spark):
    signs = [chr(c) for c in [*range(0x250), *range(0x370, 0x3000, 7), *range(0x3000, 0x3100), *range(0x4E00, 0xD7FF, 97),
                              *range(0xE000, 0x10000, 13), *range(0x10000, 0x20000, 31)]]
    rows = [(k, f"x{c}y {c}{c}  1{c}!\n{c}'s {c}") for k, c in enumerate(signs)]
    got = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", bpe_words.words_of(F.col("text"), []).alias("w")).collect()
    split, back = Tokenizer.from_file(BYTE_BPE).pre_tokenizer, {}
    for r in got:
        text = rows[r.doc_id][1]
        want = [text[a:b] for _, (a, b) in split.pre_tokenize_str(text)]
        if r.w != want:
            back[text[1]] = (r.w, want)
    assert not back


def test_digests_of_ids_and_texts(spark, texts):
    got = bpe_words.digests(bpe_words.encode(frame(spark, texts[:220]))).collect()
    assert sorted(map(tuple, got), key=str) == sorted(
        ((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
         for i, ids, t in coded(texts[:220])), key=str)


def test_encoding_an_empty_table_and_decoding_unknown_ids(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert bpe_words.decode(bpe_words.encode(none)).count() == 0
    got = bpe_words.decode(spark.createDataFrame([(1, [15496, -1, 60_000, 995]), (2, None), (3, [])], "doc_id long, ids array<int>")).collect()
    assert [(r.doc_id, r.text) for r in sorted(got)] == [(1, "Hello world"), (2, ""), (3, "")]


# ---- alignment ------------------------------------------------------------------

def alphabet():
    plain_bytes = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    signs = {chr(b): b for b in plain_bytes}
    for k, b in enumerate(b for b in range(256) if b not in plain_bytes):
        signs[chr(256 + k)] = b
    return signs


def aligned(rows):
    """Per row: (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, sha), overlaps."""
    a, b, signs = Tokenizer.from_file(BYTE_BPE), sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE), alphabet()
    a.encode_special_tokens = True
    found = []
    for doc_id, text in rows:
        tokens = ([], [])
        if text:
            ids = a.encode(" " + text, add_special_tokens=False)
            side_a = [(k, bytes(signs[c] for c in t)) for k, t in zip(ids.ids, ids.tokens)]
            side_b = [(k, bytes([int(p[3:5], 16)]) if b.is_byte(k) else p.replace("▁", " ").encode())
                      for k, p in ((k, b.id_to_piece(k)) for k in b.encode(text))]
            if b"".join(x for _, x in side_a) == b"".join(x for _, x in side_b) == (" " + text).encode():
                tokens = (side_a, side_b)
        spans = []
        for side in tokens:
            at, out = 0, []
            for k, piece in side:
                out.append((at, at + len(piece), k))
                at += len(piece)
            spans.append(out)
        ends = [{e: i for i, (_, e, _) in enumerate(s)} for s in spans]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        links = [(spans[0][ends[0][e]][2], spans[1][ends[1][e]][2]) for e in cuts]
        groups, before = [], 0
        for e in cuts:
            groups.append("|".join(",".join(str(k) for x, y, k in s if before < y <= e) for s in spans))
            before = e
        over = [(i, j) for i, (x, y, _) in enumerate(spans[0]) for j, (u, v, _) in enumerate(spans[1]) if x < v and u < y] \
            if len(spans[0]) < 200 else None
        found.append((doc_id, len(spans[0]), len(spans[1]), len(cuts), links, ";".join(groups), over))
    count = Counter(x for f in found for x in f[4])
    best = Counter()
    for (_, kb), n in count.items():
        best[kb] = max(best[kb], n)
    return [((i, na, nb, nc, len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links),
              hashlib.sha256(g.encode()).hexdigest() if na else ""), over) for i, na, nb, nc, links, g, over in found]


def test_alignment_matches_the_definition(spark, texts):
    rows = [r for r in texts if len(r[1] or "") < 3_000] + [(900, " ".join(t or "" for _, t in texts[:60]) * 3)]
    got = alignment.alignment(frame(spark, rows).repartition(3)).collect()
    want = aligned(rows)
    assert sorted(map(tuple, got), key=str) == sorted((r for r, _ in want), key=str)
    assert got[0].__fields__ == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert any(r[1] == 0 for r, _ in want) and any(r[4] > r[5] > 0 for r, _ in want)


def test_overlapping_tokens(spark, texts):
    rows = [r for r in texts if len(r[1] or "") < 300 and r[0] is not None]
    rows = list({r[0]: r for r in rows}.values())
    got = alignment.overlapping(frame(spark, rows), BYTE_BPE, PIECE_BPE).groupBy("doc_id") \
        .agg(F.sort_array(F.collect_list(F.struct("a_pos", "b_pos"))).alias("pairs")).collect()
    want = {r[0]: over for r, over in aligned(rows) if over}
    assert {r.doc_id: [tuple(p) for p in r.pairs] for r in got} == want


def test_frames_of_any_size_and_a_small_cache_give_equal_results(spark, texts, monkeypatch):
    pair = alignment.Sides(BYTE_BPE, PIECE_BPE)
    some = [t for _, t in texts if len(t or "") < 3_000]
    got = [pair.encode(t) for t in some]
    pair.by_word = False
    assert [pair.encode(t) for t in some] == got
    monkeypatch.setattr(alignment, "CACHE_WORDS", 7)
    pair = alignment.Sides(BYTE_BPE, PIECE_BPE)
    assert pair.by_word and [pair.encode(t) for t in some] == got and len(pair.known) <= 7
    monkeypatch.setattr(alignment, "BATCH_CHARS", 50)
    assert [k for f, e in alignment._frames(some) for k in range(f, e)] == list(range(len(some)))


def test_alignment_of_an_empty_table(spark):
    assert alignment.alignment(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_digests_are_made_where_ids_are_made(spark):
    docs = spark.createDataFrame(list(enumerate(["first text of words", "", None, "first words 123"] * 3)), "doc_id long, text string")
    got = bpe_words.encoded_digests(docs, max_bytes=200)
    assert got._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert sorted(got.collect()) == sorted(bpe_words.digests(bpe_words.encode(docs)).collect())


def test_digests_are_stored_from_small_batches(spark, monkeypatch):
    """A batch of 10,000 documents with their words was too much memory."""
    key, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", {}
    before, stored = spark.conf.get(key), bpe_words.stored
    monkeypatch.setattr(bpe_words, "stored", lambda df, tag: seen.update({tag: int(spark.conf.get(key))}) or stored(df, tag))
    monkeypatch.setattr(bpe_words, "ARROW_ROWS", 2)
    docs = spark.createDataFrame(list(enumerate(["first text of words", "", None, "first words 123"] * 3)), "doc_id long, text string")
    got = bpe_words.stored_digests(docs)
    assert seen["digests"] == 2 and spark.conf.get(key) == before
    assert "MapInArrow" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(got.collect()) == sorted(bpe_words.digests(bpe_words.encode(docs)).collect())


def test_no_word_becomes_a_row_on_its_way_to_its_ids(spark):
    """A row for every word, joined and handed to Python, was most of the time."""
    docs = spark.createDataFrame([(1, "some words of a text")], "doc_id long, text string")
    plan = bpe_words.encoded_digests(docs)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan and "Join" not in plan


def test_a_look_up_holds_less_than_the_frequent_words():
    """A hash table of all frequent words for every slice was most of a worker's memory."""
    among = pa.array([f"word {k}" for k in range(300_000)])
    words = pa.array(["word 7", None, "none", "word 299999", "word 7", "none"])
    pa.default_memory_pool().release_unused()
    before, most = pa.total_allocated_bytes(), pa.default_memory_pool().max_memory()
    assert bpe_words._looked_up(words, among).to_pylist() == [7, None, None, 299_999, 7, None]
    assert bpe_words._looked_up(words.slice(4), among.slice(0, 10)).to_pylist() == [7, None]
    assert bpe_words._looked_up(words.slice(0, 0), among).to_pylist() == []
    assert pa.default_memory_pool().max_memory() <= max(most, before + among.nbytes)


@pytest.mark.parametrize("words", [1, 3, 1000])
def test_words_are_looked_up_in_slices(words):
    table = pa.array(["a", " b", " c"]), pa.array([[1], [2, 3], []], pa.list_(pa.int32()))
    docs = [(0, ["a", " b"]), (1, None), (None, []), (3, [" b", " c", "a", " b"]), (4, ["a"])]
    batch = pa.RecordBatch.from_arrays([pa.array([d for d, _ in docs]), pa.array(range(5)), pa.array([7] * 5), pa.array([w for _, w in docs])],
                                       ["doc_id", "row", "check", "words"])
    got = list(bpe_words._encode([batch], table, bpe_words._Split(None), words))
    assert [tuple(r.values()) for b in got for r in b.to_pylist()] == [(0, [1, 2, 3]), (1, []), (None, []), (3, [2, 3, 1, 2, 3]), (4, [1])]
    assert len(got) == {1: 4, 3: 3, 1000: 1}[words]
    unknown = pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([["a", "zz"]] * 5)], batch.schema.names)
    with pytest.raises(ValueError, match="split in another way"):
        list(bpe_words._encode([unknown], table, bpe_words._Split(None)))
