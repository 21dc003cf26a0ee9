"""Operators on documents against brute force, with nulls, ties, long texts,
repeated rows, empty tables and columns of clashing names."""

from __future__ import annotations

import random
import zlib

import brute
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cashweave.llm import decontaminate, language_id, line_dedup, packing, simhash, token_counts, token_files
from cashweave.llm.token_ids import Encoder, default_tokenizer, encoder

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, words string, fp long, term string, pos int, "
          "length long, n int, start long, keeper long, component_id long, h1 long, piece int, doc_key long, phrase_id long, "
          "__row int, __stay string")
EXTRA = len(SCHEMA.split(",")) - 5


def frame(spark, rows):
    """Documents with many columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, lang, "src", len(t or ""), *[None] * EXTRA) for i, t, lang in rows], SCHEMA)


def prose(rng, n, words="the of and over under river stone light house garden quick brown fox jumps lazy dog tall grass".split()):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(7)
    base = [prose(rng, rng.randint(1, 60)) for _ in range(40)]
    passage = prose(rng, 30)
    rows = [(k, t, "en") for k, t in enumerate(base)]
    rows += [(100 + k, base[k] + " end", "en") for k in range(10)]                  # near copies
    rows += [(200 + k, base[3], "en") for k in range(8)]                            # exact copies
    rows += [(300 + k, f"{base[k]}\n{passage}\nshared line of more than twenty characters\n short \n", "en") for k in range(6)]
    rows += [(400, None, None), (401, "", "en"), (402, "   \n\n", "en"), (403, "!!! 123 ???", "en"), (404, passage.upper(), "en")]
    rows += [(500, prose(rng, 30_000) + " " + passage, "en"), (501, "A", "en"), (502, "the " * 500, "en")]
    return rows, passage


ITEMS_SCHEMA = "item_id long, text string, term string, p int"


@pytest.fixture(scope="module")
def items(corpus):
    passage = corpus[1]
    rng = random.Random(9)
    return [(1, passage), (2, passage), (10, " ".join(passage.split()[5:20])), (3, prose(rng, 40)), (4, "river stone"),
            (5, None), (6, ""), (7, "the " * 20), (8, "absentword " + prose(rng, 20)), (None, "lazy dog tall grass over")]


def test_contamination_matches_brute_force(spark, corpus, items):
    docs = [(i, t) for i, t, _ in corpus[0]]
    got = decontaminate.contamination(frame(spark, corpus[0]), spark.createDataFrame([(*r, None, None) for r in items], ITEMS_SCHEMA)) \
        .select("doc_id", "n_words", "n_hit", F.size("item_ids"), F.sha2(F.array_join("item_ids", ","), 256), "contaminated").collect()
    assert {r[0]: tuple(r)[1:] for r in got} == brute.contamination(docs, items)
    assert len(got) == len(docs) and any(r[5] for r in got) and not all(r[5] for r in got)


def test_contamination_of_rows_without_id_and_repeated_rows(spark, corpus):
    passage = corpus[1]
    rows = [(None, passage, None), (None, "clean", None), (1, passage, None), (1, passage, None), (1, "other text", None)]
    items = spark.createDataFrame([(1, passage)], "item_id long, text string")
    got = sorted((r.doc_id is None, r.n_words, r.contaminated) for r in decontaminate.contamination(frame(spark, rows), items).collect())
    assert got == sorted([(True, 30, True), (True, 1, False), (False, 30, True), (False, 30, True), (False, 2, False)])
    kept = decontaminate.decontaminate(frame(spark, rows), items)
    assert sorted((r.doc_id or -1, r.text) for r in kept.collect()) == [(-1, "clean"), (1, "other text")]
    assert kept.columns == frame(spark, rows).columns


def test_one_word_in_twenty_is_counted_exactly(spark):
    item = "b0 b1 b2 b3 b4 b5 b6"
    docs = [(n, item + " " + " ".join(f"w{i}" for i in range(n - 7))) for n in (139, 140, 141)]
    got = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"),
                                      spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert {r.doc_id: r.contaminated for r in got.collect()} == {139: True, 140: True, 141: False}


def test_contamination_without_items_or_documents(spark, corpus):
    none = spark.createDataFrame([], "item_id long, text string")
    got = decontaminate.contamination(frame(spark, corpus[0][:5]), none).collect()
    assert len(got) == 5 and not any(r.contaminated or r.n_hit or r.item_ids for r in got)
    some = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontaminate.contamination(frame(spark, []), some).count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "red x x green x blue"), (2, "red green"), (3, "blue x red x x x x x green"), (4, None)],
                                 "doc_id long, text string")
    phrases = decontaminate.phrases_of(spark.createDataFrame([(1, "blue green red"), (2, "x")], "item_id long, text string"))
    vocabulary = decontaminate.vocabulary_of(phrases)
    index = decontaminate.build_index(docs, vocabulary)
    names = {r.phrase_id: r.item_ids[0] for r in phrases.collect()}
    got = decontaminate.proximity_matches(index, phrases, vocabulary, 5).join(decontaminate.documents_of(index), ["doc_no", "doc_key"])
    assert sorted((r.doc_id, r.pos) for r in got.collect() if names[r.phrase_id] == "1") == [(1, 5)]
    assert sum(names[r.phrase_id] == "2" for r in got.collect()) == 9


def test_phrases_of_periodic_text(spark):
    docs = [(1, "a b " * 100), (2, "a " * 50 + "b " * 50)]
    items = [(1, "a b " * 10), (2, "a " * 13 + "b")]
    got = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"),
                                      spark.createDataFrame(items, "item_id long, text string"))
    want = brute.contamination(docs, items)
    assert {r.doc_id: (r.n_words, r.n_hit, len(r.item_ids)) for r in got.collect()} == {k: v[:3] for k, v in want.items()}


def test_near_duplicates_match_brute_force(spark, corpus):
    prints = {i: brute.fingerprint(t) for i, t, _ in corpus[0]}
    want = brute.components(prints)
    got = simhash.near_duplicates(frame(spark, corpus[0])).collect()
    assert {r.doc_id: r.fp % (1 << 64) for r in got} == prints
    assert {r.doc_id: r.component_id for r in got} == want and len(got) == len(prints)


@pytest.mark.parametrize("bits,limit", [(1, 2), (2, 1), (2, 64)])
def test_links_connect_what_brute_force_connects(spark, bits, limit):
    rng = random.Random(bits * 10 + limit)
    fps = set()
    for _ in range(25):
        x = rng.getrandbits(64)
        fps.add(x)
        for _ in range(rng.randint(0, 12)):                       # chains and clusters
            for b in rng.sample(range(64), rng.randint(1, 3)):
                x ^= 1 << b
            fps.add(x)
    fps |= {0, 1, 3, (1 << 64) - 1}
    nodes = spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp long")
    edges = simhash.links(nodes, bits, pair_limit=limit)
    assert all(((r.u ^ r.v) % (1 << 64)).bit_count() <= bits for r in edges.collect())
    roots = {r.node: r.root for r in simhash.components(edges).collect()}
    groups = {}
    for x in fps:
        groups.setdefault(roots.get(simhash._signed(x), simhash._signed(x)), set()).add(x)
    want = {}
    for x, root in brute.components({x: x for x in fps}, bits).items():
        want.setdefault(root, set()).add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_components_of_a_long_chain(spark):
    n = 300
    order = list(range(n))
    random.Random(5).shuffle(order)
    edges = spark.createDataFrame([(min(a, b), max(a, b)) for a, b in zip(order, order[1:])], "u long, v long")
    assert {r.root for r in simhash.components(edges).collect()} == {0}


def test_near_duplicates_of_nulls_repeats_and_nothing(spark):
    text = "one two three four five six"
    rows = [(None, text, None), (None, None, None), (5, text, None), (5, text, None), (7, text, None), (8, "", None), (9, " \n", None)]
    got = sorted((r.doc_id or -1, r.component_id) for r in simhash.near_duplicates(frame(spark, rows)).collect())
    assert got == [(-1, 5), (-1, 8), (5, 5), (5, 5), (7, 5), (8, 8), (9, 8)]
    kept = simhash.keep_one(frame(spark, rows)).collect()
    assert sorted(r.doc_id for r in kept) == [5, 8]
    assert simhash.keep_one(frame(spark, [(None, "x", None), (None, "x", None)])).count() == 1
    assert simhash.near_duplicates(frame(spark, [])).count() == 0
    assert simhash.keep_one(frame(spark, [])).columns == frame(spark, []).columns


def test_line_dedup_matches_brute_force(spark, corpus):
    rows = corpus[0] + [(600 + k, "SHARED line of more than twenty characters \r\nonly here in " + str(k), None) for k in range(3)]
    want = brute.drop_lines([(i, t) for i, t, _ in rows])
    got = line_dedup.dedup_lines(frame(spark, rows)).collect()
    assert {r.doc.doc_id: (r.n_lines, r.n_dropped, r.text) for r in got} == want
    assert len(got) == len(rows) and sum(v[1] for v in want.values()) > 5


def test_line_dedup_of_nulls_repeats_and_nothing(spark):
    line = "a line that is longer than twenty characters"
    rows = [(1, line, None), (1, line, None), (2, line + "\nx", None), (None, line, None), (None, None, None)]
    got = sorted((r.doc.doc_id or -1, r.text) for r in line_dedup.dedup_lines(frame(spark, rows)).collect())
    assert got == [(-1, ""), (-1, ""), (1, ""), (1, ""), (2, line + "\nx")]
    two = [(1, line, None), (1, line, None), (2, line, None)]          # two documents only
    assert all(r.text == line for r in line_dedup.dedup_lines(frame(spark, two)).collect())
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0


def test_runs_are_compacted_by_level(spark):
    runs = line_dedup.LineRuns(spark, fanout=2)
    for k in range(5):
        batch = spark.createDataFrame([(k, f"line number one of some length\nline of batch {k} of some length")], "doc_id long, text string")
        runs.add(line_dedup.keyed_lines(batch))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    found = runs.frequent(2).collect()
    assert [(r.n_docs, r.keeper) for r in found] == [(5, 4)]


def test_code_lengths_are_exact():
    rng = random.Random(3)
    texts = {"x": "abab cabra " * 20, "y": "".join(rng.choice("abcdé ") for _ in range(300))}
    counts = {}
    for lang, text in texts.items():
        gram, n = np.unique(language_id._grams(np.frombuffer(text.encode(), np.uint8)), return_counts=True)
        counts[lang] = dict(zip(gram.tolist(), n.tolist()))
    trees = language_id.Trees.of_rows([(lang, g, n) for lang, c in counts.items() for g, n in c.items()])

    def bits(text, lang):
        tree = {}
        for g, n in counts[lang].items():
            b = g.to_bytes(4, "big")
            for order in range(4):
                at = tree.setdefault(b[3 - order:3], {})
                at[b[3]] = at.get(b[3], 0) + n
        data, total = bytes(3) + text.encode(), 0.0
        for i in range(3, len(data)):
            for order in (3, 2, 1, 0):
                c = tree.get(data[i - order:i])
                if c:
                    size, kinds = sum(c.values()), len(c)
                    if data[i] in c:
                        total -= np.log2(c[data[i]] / (size + kinds))
                        break
                    total -= np.log2(kinds / (size + kinds))
            else:
                total += 8
        return total

    probes = ["abra cab", "é unseen ~ bytes żółw", "", "ab" * 400]
    got = trees.bits([p.encode() for p in probes])
    assert np.allclose(got, [[bits(p, lang) for lang in trees.languages] for p in probes], atol=1e-2)
    chunk, language_id.CHUNK = language_id.CHUNK, 7
    try:
        assert np.allclose(got, trees.bits([p.encode() for p in probes]), atol=1e-2)
    finally:
        language_id.CHUNK = chunk


def test_language_id_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = language_id.identify(docs).select("doc.doc_id", "doc.lang", "lang_pred", "score", language_id.held_out("doc.doc_id").alias("held")).collect()
    assert all(r.held == brute.held_out(r.doc_id) for r in got)
    held = [r for r in got if r.held]
    assert sum(r.lang_pred == r.lang for r in held) >= 0.95 * len(held) and all(0 <= r.score <= 1 for r in got)


def test_language_id_never_looks_at_label_or_source(spark, corpus):
    rows = [(k, t, lang) for k, (t, lang) in enumerate([("the house and the garden " * 3, "en"), ("la casa y el jardín " * 3, "es")] * 10)]
    trees = language_id.fit(frame(spark, rows))
    wrong = [(i, t, "es" if lang == "en" else "en") for i, t, lang in rows]
    assert [r.lang_pred for r in language_id.predict(frame(spark, wrong), trees).orderBy("doc.doc_id").collect()] == [r[2] for r in rows]


def test_language_id_of_nulls_and_nothing(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "123 !?", "en"), (None, "the house", None), (5, "the house the garden", "en"), (6, "x" * 300_000, None)]
    got = {(r.doc.doc_id, (r.doc.text or "")[:9]): (r.lang_pred, r.score) for r in language_id.identify(frame(spark, rows)).collect()}
    assert got[(1, "")] == got[(2, "")] == got[(3, "123 !?")] == ("und", 0.0)
    assert got[(None, "the house")][0] == "en" and got[(6, "x" * 9)][0] == "en"
    unlabelled = [(1, "words", None)]
    assert [r.lang_pred for r in language_id.identify(frame(spark, unlabelled)).collect()] == ["und"]
    assert language_id.identify(frame(spark, [])).count() == 0


def test_language_id_scores_large_batches_in_small_ones():
    """A batch of 10,000 rows, decoded at once, took an executor over its memory."""
    trees = language_id.Trees.of_rows([(lang, int(g), 2) for lang, t in (("en", "the house"), ("es", "la casa"))
                                       for g in np.unique(language_id._grams(np.frombuffer(t.encode(), np.uint8)))])
    n = 2 * language_id.BATCH_ROWS + 7
    texts = [(None, "12", "the house", "la casa")[k % 4] for k in range(n)]
    batch = pa.RecordBatch.from_arrays([pa.StructArray.from_arrays([pa.array(range(n)), pa.array(texts)], ["doc_id", "text"]),
                                        pa.array([k % 4 > 1 for k in range(n)])], ["doc", "letters"])
    got = list(language_id._scored(batch.slice(3), 1, trees))
    assert [b.num_rows for b in got] == [language_id.BATCH_ROWS] * 2 + [4]
    rows = [r for b in got for r in b.to_pylist()]
    assert [(r["doc"]["doc_id"], r["doc"]["text"], r["lang_pred"]) for r in rows] == [
        (k, texts[k], ("und", "und", "en", "es")[k % 4]) for k in range(3, n)]


def test_language_id_sends_each_text_to_python_once(spark):
    trees = language_id.fit(frame(spark, [(1, "the house", "en")]))
    plan = language_id.predict(frame(spark, [(1, "the house", "en")]), trees)._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() != "MapInArrow":
        plan = plan.children().apply(0)
    sent = plan.children().apply(0).output()
    assert [sent.apply(k).name() for k in range(sent.size())] == ["doc", "letters"]


def test_language_id_keeps_every_sequence_of_small_languages(spark):
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    big = "".join(rng.choice(letters) for _ in range(400_000))        # more pairs, all twice, than a cap over all languages kept
    small = "zebra quilt oxbow " * 3
    rows = [(k, big, "aa") for k in (1, 2)] + [(3, small, "zz")]
    trees = language_id.fit(frame(spark, rows))
    assert trees.languages == ["aa", "zz"]
    want = language_id.Trees.of_rows([(lang, int(g), int(n)) for lang, text, copies in (("aa", big, 2), ("zz", small, 1))
                                      for g, n in zip(*np.unique(language_id._grams(np.frombuffer(text.encode(), np.uint8)), return_counts=True))
                                      for n in [n * copies]])
    probes = [small.encode(), big[:5000].encode(), b"quilt zebra"]
    assert np.allclose(trees.bits(probes), want.bits(probes), rtol=1e-5)
    got = language_id.predict(frame(spark, [(1, big[:3000], None), (2, "oxbow zebra quilt", None)]), trees).orderBy("doc.doc_id").collect()
    assert [r.lang_pred for r in got] == ["aa", "zz"]


def test_language_id_learns_every_label(spark):
    rows = [(k, f"{chr(0x4e00 + k)}{chr(0x5e00 + k)} " * 5, f"l{k:03d}") for k in range(80)]
    trees = language_id.fit(frame(spark, rows))
    assert [r.lang_pred for r in language_id.predict(frame(spark, rows), trees).orderBy("doc.doc_id").collect()] == [r[2] for r in rows]
    assert language_id.fit(frame(spark, rows), languages=3).languages == ["l000", "l001", "l002"]


def test_encoder_is_the_library(corpus):
    enc = Encoder(default_tokenizer())
    rng = random.Random(11)
    pool = [chr(c) for c in [*range(1, 0x180), *range(0x300, 0x310), 0x3A3, 0x130, 0x1E9E, 0x2028, 0xA0, 0x1F600, 0xD55C, 0x661]]
    pool += [" ", "\n", "'s", "<|endoftext|>", "'LL", "\t"] * 12
    texts = ["".join(rng.choices(pool, k=rng.randint(0, 30))) for _ in range(1500)] + [t for _, t, _ in corpus[0] if t]
    assert all(enc.encode(t).tolist() == enc.tok.encode(t, add_special_tokens=False).ids for t in texts)
    assert enc.encode(None).tolist() == []


def _ids(text, end):
    return np.append(encoder(default_tokenizer()).encode(text).astype("<u4"), np.uint32(end)).astype("<u4")


def test_packing(spark, corpus):
    rows = corpus[0] + [(None, "no id", None), (700, "twice", None), (700, "twice", None)]
    got = packing.pack(frame(spark, rows)).collect()
    ids = {i: _ids(t, 1) for i, t, _ in rows}
    for r in got:
        piece = ids[r.doc_id][r.start:r.start + r.length]
        assert len(piece) == r.length and zlib.crc32(piece.tobytes()) == r.ids_crc32 and r.start == 4096 * r.piece
    assert sum(r.length for r in got) == sum(len(ids[i]) for i, _, _ in rows)
    filled = _gapless(got)
    assert len(filled) <= -(-sum(r.length for r in got) // 4096) + 1
    assert packing.pack(frame(spark, [])).count() == 0


def _gapless(rows):
    filled = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values()) <= 4096
    return filled


@pytest.mark.parametrize("seed", range(6))
def test_packing_plan_covers_every_piece_and_is_tight(seed):
    rng = np.random.default_rng(seed)
    lengths = np.clip(np.exp(rng.normal(rng.uniform(2, 8), rng.uniform(0.1, 1.2), int(rng.integers(1, 4000)))), 1, 4096).astype(int)
    histogram = {int(a): int(b) for a, b in zip(*np.unique(lengths, return_counts=True))}
    places, sequences = packing.plan_packing(histogram)
    used, ranks = {}, {}
    for length, low, high, first, offset in places:
        ranks.setdefault(length, []).append((low, high))
        for k in range(high - low):
            used.setdefault(first + k, []).append((offset, length))
    for length, spans in ranks.items():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] == histogram[length] and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    assert set(ranks) == set(histogram) and len(used) == sequences
    for items in used.values():
        items.sort()
        assert [o for o, _ in items] == [0, *np.cumsum([n for _, n in items])[:-1]] and sum(n for _, n in items) <= 4096
    free: list[int] = []                                     # best fit, longest first, piece by piece
    for n in sorted(lengths.tolist(), reverse=True):
        fits = [i for i, f in enumerate(free) if f >= n]
        if fits:
            free[min(fits, key=lambda i: free[i])] -= n
        else:
            free.append(4096 - n)
    assert sequences <= len(free) * 1.01 + 1


def test_ranks_of_one_hot_length(spark):
    rows = [(i, "same words in every one of them", None) for i in range(3000)]
    got = packing.pack(frame(spark, rows)).collect()
    assert len(got) == 3000 and len({r.doc_id for r in got}) == 3000
    assert len(_gapless(got)) == -(-3000 // (4096 // got[0].length))


def test_coded_files_round_trip(spark, corpus):
    rows = corpus[0] + [(None, "no id", None), (700, "twice", None), (700, "twice", None)]
    got = token_files.read_coded(token_files.write_coded(frame(spark, rows))).collect()
    want, at = [], 0
    for i, t in sorted(((i, t) for i, t, _ in rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = _ids(t, 2)
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert token_files.read_coded(token_files.write_coded(frame(spark, []))).count() == 0


def test_damaged_block_is_noticed():
    from cashweave.llm import range_coder as rc

    ids = np.random.default_rng(1).integers(0, 300, 9000)
    blocks = rc.encode_blocks(ids, 500)
    cut = [(*rc.HEADER.unpack(b[:12])[::2], b[12:]) for b in blocks]
    assert np.array_equal(rc.decode_blocks(cut, 500), ids)
    assert np.array_equal(rc.decode_blocks(cut[1:2], 500), ids[rc.BLOCK:2 * rc.BLOCK])       # on its own
    n, crc, data = cut[0]
    bad = bytes([data[0] ^ 1]) + data[1:]
    with pytest.raises(ValueError):
        rc.decode_blocks([(n, crc, bad)], 500)
    assert sum(map(len, blocks)) < 2 * len(ids)


@pytest.mark.parametrize("size,top", [(0, 5), (1, 5), (5000, 3), (4096, 1), (8193, 70_000)])
def test_coder_round_trips(size, top):
    from cashweave.llm import range_coder as rc

    ids = np.random.default_rng(size).integers(0, top, size)
    cut = [(*rc.HEADER.unpack(b[:12])[::2], b[12:]) for b in rc.encode_blocks(ids, top + 1)]
    assert np.array_equal(rc.decode_blocks(cut, top + 1), ids)


def test_lanes_of_unlike_ids_round_trip(monkeypatch):
    """Lanes that repeat themselves, lanes of new ids, a short last lane, more
    lanes than look up their ids together; a block's bytes are its own."""
    from cashweave.llm import range_coder as rc

    monkeypatch.setattr(rc, "GROUP_LANES", 2)
    rng = np.random.default_rng(5)
    ids = np.concatenate([np.zeros(rc.BLOCK, np.int64), rng.permutation(60_000)[:rc.BLOCK], np.tile(rng.integers(0, 49_000, 64), rc.BLOCK // 64),
                          rng.zipf(1.3, rc.BLOCK) % 49_000, np.arange(rc.BLOCK) // 3, rng.integers(0, 9, 1500)])
    blocks = rc.encode_blocks(ids, 60_000)
    cut = [(*rc.HEADER.unpack(b[:12])[::2], b[12:]) for b in blocks]
    assert np.array_equal(rc.decode_blocks(cut, 60_000), ids)
    assert np.array_equal(rc.decode_blocks(cut[::-1], 60_000)[:1500], ids[-1500:])
    assert blocks[3] == rc.encode_blocks(ids[3 * rc.BLOCK:4 * rc.BLOCK], 60_000)[0]
    assert len(blocks[0]) < 100 and len(blocks[2]) < rc.BLOCK


def test_an_id_puts_out_one_word_at_most():
    """Also with the widest ids, all of them new; more are refused."""
    from cashweave.llm import range_coder as rc

    top = 1 << rc.MAX_ID_BITS
    ids = np.random.default_rng(2).permutation(top)[:rc.BLOCK + 700]
    blocks = rc.encode_blocks(ids, top)
    cut = [(*rc.HEADER.unpack(b[:12])[::2], b[12:]) for b in blocks]
    assert np.array_equal(rc.decode_blocks(cut, top), ids)
    assert all(len(data) <= 4 * (n + 2) for n, _, data in cut)
    with pytest.raises(ValueError):
        rc.encode_blocks(ids, top + 1)


def test_shares_of_the_coding_range_stay_apart():
    """Whatever kinds come, every kind keeps a share that leaves room for the widest id."""
    from cashweave.llm import range_coder as rc

    rng = np.random.default_rng(3)
    for p in ([1, 0, 0, 0], [0, 0, 0, 1], [0, .5, .5, 0], [.97, .01, .01, .01]):
        model = rc._Model(1)
        h = model.of_context[:, 0]
        for k, kind in enumerate(rng.choice(4, 1500, p=p)):
            ends = model.mix[:1].copy()
            model.learn(h[:, None], np.zeros((2, 1), np.int32), np.zeros((2, 1), np.int32), np.array([0]), ends,
                        np.array([kind]), np.zeros((2, 1), bool), np.zeros(1, np.int32), rc.RATE[k >= 512])
            at = [0, *(int(model.mix[0]) >> 16 * j & 0xFFFF for j in range(4))]
            assert at[4] == 1 << rc.MIX_BITS and min(np.diff(at)) >= 15


def test_rows_encode_as_the_library_does(monkeypatch):
    from cashweave.llm import token_ids

    rng = random.Random(11)
    alphabet = list("abcXYZ '\"!?.,;0123\t\n\n  \r\u00a0éÉßÿµ×÷İſK中あ😀\u0301\ufeff") + ["'s", "'LL", "the ", "<|endoftext|"]
    texts = [None, "", " ", "\n\n", "x" * 100 + " " + "x" * 100, "it's IT'S a <|endoftext|> b", "'", None]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    texts += [prose(rng, rng.randint(0, 80)) + "." for _ in range(100)]
    for path in (default_tokenizer(), public_tokenizers.path("byte_bpe_50k.json")):
        enc = Encoder(path)
        want = [enc.tok.encode(t or "", add_special_tokens=False).ids for t in texts]
        for size, words in ((1, 5), (300, 50), (12_000_000, 300_000)):
            monkeypatch.setattr(token_ids, "ROWS_BYTES", size)
            monkeypatch.setattr(token_ids, "CACHE_WORDS", words)
            ids, counts = map(np.concatenate, zip(*enc.encode_rows(pa.array(texts))))
            assert counts.tolist() == [len(w) for w in want]
            assert ids.tolist() == [i for w in want for i in w]
            assert len(enc.recent) <= words + 1 or not enc.by_word
        assert list(enc.encode_rows(pa.array([], pa.string()))) == []


def test_files_are_written_from_distinct_words(monkeypatch):
    """A word is cut once, however often it stands in a slice, and pieces
    met again outlast a cache that overflows."""
    from cashweave.llm import token_ids

    enc = Encoder(default_tokenizer())
    spelled, words = [], []
    cut, of_words = enc._spelled, enc._words
    monkeypatch.setattr(enc, "_spelled", lambda p: spelled.append(p) or cut(p))
    monkeypatch.setattr(enc, "_words", lambda w: words.append(len(w)) or of_words(w))
    monkeypatch.setattr(token_ids, "CACHE_WORDS", 6)
    for k in range(8):
        list(enc.encode_rows(pa.array(["the river the House, the\nriver"] * 50 + [f"w{'abcdefgh'[k]}x w{'abcdefgh'[k]}y"])))
    assert words == [5] * 8
    assert spelled.count("the") == spelled.count("river") == spelled.count("house") == 1


def test_a_task_reads_one_file(spark):
    files = spark.createDataFrame([(k, f"file {k}") for k in range(40)], "part int, file string")
    assert [len(part) for part in token_files.one_a_task(files).rdd.glom().collect()] == [1] * 40
    assert token_files.one_a_task(files.limit(0)).count() == 0


@pytest.mark.parametrize("block", [1, 3, 7, 1000])
def test_separator_scan_stitches_blocks(spark, tmp_path, block):
    contents = [[1, 2, 9, 3, 9], [9, 9, 4, 5, 6, 7, 8, 1, 2, 3], [5], [9]]
    rows, want, at = [], [], 0
    for part, ids in enumerate(contents):
        path = tmp_path / f"f{part}"
        path.write_bytes(np.array(ids, "<u2").tobytes())
        rows.append((part, str(path), len(ids)))
        docs = " ".join(map(str, ids)).split("9")
        for k, d in enumerate(docs):
            n = len(d.split())
            if k < len(docs) - 1 or n:
                want.append((len(want), at, n))
                at += n
    files = spark.createDataFrame([*rows, (9, "none", 0)], "part int, file string, n_ids long")
    got = token_counts.counts(files, 9, np.dtype("<u2"), block).collect()
    assert sorted((r.ordinal, r.start, r.n_tokens) for r in got) == want


def test_token_counts_of_documents(spark, corpus):
    rows = corpus[0] + [(None, "no id", None), (700, "twice", None), (700, "twice", None)]
    docs = frame(spark, rows)
    end = token_files.end_of_document(default_tokenizer())
    files = token_files.write_flat(docs)
    got = token_counts.named(token_counts.counts(files, end, token_files.flat_type(end), 1000), files) \
        .collect()
    got.sort(key=lambda r: r.ordinal)
    want = [(i, len(_ids(t, 0)) - 1) for i, t, _ in rows]
    assert sorted(((r.doc_id, r.n_tokens) for r in got), key=str) == sorted(want, key=str)
    assert [r.ordinal for r in got] == list(range(len(rows)))
    want = [(r.doc_id, r.n_tokens) for r in got]
    assert [r.start for r in got] == [0, *np.cumsum([n for _, n in want])[:-1]]
    assert token_counts.counts(token_files.write_flat(frame(spark, [])), end, token_files.flat_type(end)).count() == 0


def test_keyed_hash_of_line_store_is_stable(spark):
    docs = spark.createDataFrame([(1, "  Twenty characters and some more \t")], "doc_id long, text string")
    other = spark.createDataFrame([(2, "twenty characters AND some more")], "doc_id long, text string")
    key = [line_dedup.keyed_lines(d).select("h1", "h2").first() for d in (docs, other)]
    assert key[0] == key[1]
