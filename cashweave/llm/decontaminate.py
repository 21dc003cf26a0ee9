"""Benchmark decontamination by a distributed positional inverted index.

The index holds one posting (term, document, position) per occurrence in the
training documents of a term of its vocabulary, in segments: each input split
writes its own, sorted by term, document and position, so that a look-up of a
few terms reads few row groups and building it moves no data. A document's
last posting is that of the empty term; its position is the number of words.

A phrase query takes, for each window, the postings of the window's rarest
term, shifts them by the term's place in the phrase, intersects them with the
equally shifted postings of the second and third rarest, and then with those
of all terms of the phrase. Runs of consecutive hits that are long enough are
the exact matches. Only DataFrame functions are used.

Nulls and ties: a null or empty text has no words; rows that share a
``doc_id`` but not the text, or that have no ``doc_id``, are documents of
their own; equal rows get equal results. Benchmark rows without words match
nothing; a null item id counts as the empty id; items of equal words are
searched once and reported under all their ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cashweave.llm.common import ascii_lower, doc_key, doc_no, packed, small_side, stored

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
ONE_IN = 20
END = ""                       # the term of a document's last posting
PROBES = 3                     # rarest terms that are intersected one by one
BROADCAST_ROWS = 200_000       # counted rows up to which a table of the benchmark or of bad documents is broadcast

DOC = ["doc_no", "doc_key"]


def words_of(text):
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def phrases_of(items: DataFrame) -> DataFrame:
    """Distinct word sequences: ``phrase_id, words, n, item_ids``."""
    return stored(
        items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"),
                     words_of(F.col("text")).alias("words"))
        .filter(F.size("words") > 0)
        .groupBy("words").agg(F.sort_array(F.collect_set("item")).alias("item_ids"))
        .select(F.monotonically_increasing_id().alias("phrase_id"), "words",
                F.size("words").alias("n"), "item_ids"), "phrases")


def vocabulary_of(phrases: DataFrame) -> DataFrame:
    """``term, term_id`` of all terms of the phrases, and of END."""
    terms = phrases.select(F.explode("words").alias("term")).distinct()
    end = phrases.sparkSession.range(1).select(F.lit(END).alias("term"))
    return stored(terms.union(end).select("term", F.monotonically_increasing_id().alias("term_id")), "terms")


def build_index(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Postings ``term_id, doc_no, doc_key, pos`` of the vocabulary's terms;
    ``doc_id`` is given with a document's last posting."""
    tokens = docs.select(
        "doc_id", doc_no().alias("doc_no"), doc_key().alias("doc_key"),
        F.posexplode(F.concat(words_of(F.col("text")), F.array(F.lit(END)))).alias("pos", "term"))
    postings = tokens.join(small_side(vocabulary, BROADCAST_ROWS), "term").select(
        "term_id", "doc_no", "doc_key", "pos",
        F.when(F.col("term") == END, F.col("doc_id")).alias("doc_id"), (F.col("term") == END).alias("is_end"))
    return stored(postings.sortWithinPartitions("term_id", "doc_no", "pos"), "postings")


def documents_of(index: DataFrame) -> DataFrame:
    return index.filter("is_end").select("doc_id", *DOC, F.col("pos").cast("long").alias("n_words"))


def located_terms(phrases: DataFrame, vocabulary: DataFrame, index: DataFrame) -> DataFrame:
    """``phrase_id, p, n, term_id, freq``: the terms of the phrases with their
    number of postings."""
    counts = index.groupBy("term_id").agg(F.count(F.lit(1)).alias("freq"))
    return stored(
        phrases.select("phrase_id", "n", F.posexplode("words").alias("p", "term"))
        .join(vocabulary, "term").join(counts, "term_id", "left")
        .select("phrase_id", "p", "n", "term_id", F.coalesce("freq", F.lit(0)).alias("freq")), "located")


def probes_of(located: DataFrame, window: int) -> DataFrame:
    """The rarest terms of each window, rarest first, once for all windows of a
    phrase that share them. Of equally rare terms that at a multiple of the
    window goes first, so that few places serve all windows of a phrase."""
    rated = F.struct("freq", (F.col("p") % window != 0).alias("off"), "p", "term_id")
    rows = located.groupBy("phrase_id", "n").agg(F.sort_array(F.collect_list(F.struct("p", rated.alias("t")))).alias("ts"))
    width = F.least(F.col("n"), F.lit(window))
    starts = rows.select("phrase_id", F.col("ts.t").alias("ts"), width.alias("w"),
                         F.explode(F.sequence(F.lit(0), F.col("n") - width)).alias("s"))
    rarest = starts.select("phrase_id", F.array_sort(F.slice("ts", F.col("s") + 1, F.col("w"))).alias("r"))
    columns = []
    for k in range(PROBES):
        at = F.coalesce(F.get("r", F.lit(k)), F.get("r", F.lit(0)))
        columns += [at["p"].alias(f"p{k}"), at["term_id"].alias(f"t{k}")]
    return stored(rarest.filter(F.element_at("r", 1)["freq"] > 0).select("phrase_id", *columns).distinct(), "probes")


def phrase_matches(index: DataFrame, phrases: DataFrame, vocabulary: DataFrame, window: int = WINDOW) -> DataFrame:
    """All maximal runs of at least ``window`` consecutive words of a phrase
    (all its words, if fewer): ``doc_no, doc_key, phrase_id, start, length``,
    the start in words of the document."""
    located = located_terms(phrases, vocabulary, index)
    probes = probes_of(located, window)
    found = None
    for k in range(PROBES):
        places = [c for j in range(k + 1) for c in (f"p{j}", f"t{j}")]
        step = small_side(stored(probes.select("phrase_id", *places).distinct(), "probe"), BROADCAST_ROWS)
        if found is None:
            lists = index.select(F.col("term_id").alias("t0"), *DOC, "pos")
            found = lists.join(step, "t0").withColumn("diagonal", F.col("pos") - F.col("p0")).drop("pos")
        else:
            found = found.join(step, ["phrase_id", *places[:-2]])
            terms = small_side(stored(probes.select(F.col(f"t{k}").alias("term_id")).distinct(), "probe"), BROADCAST_ROWS)
            lists = index.join(terms, "term_id", "left_semi").select(F.col("term_id").alias(f"t{k}"), *DOC, "pos")
            found = found.withColumn("pos", F.col("diagonal") + F.col(f"p{k}")) \
                .join(lists, [f"t{k}", *DOC, "pos"], "left_semi").drop("pos")
    diagonals = found.select(*DOC, "phrase_id", "diagonal").distinct()
    wanted = diagonals.join(small_side(located, BROADCAST_ROWS).drop("freq"), "phrase_id") \
        .withColumn("pos", F.col("diagonal") + F.col("p"))
    hits = wanted.join(index.select("term_id", *DOC, "pos"), ["term_id", *DOC, "pos"], "left_semi")
    line = Window.partitionBy(*DOC, "phrase_id", "diagonal").orderBy("p")
    runs = hits.withColumn("run", F.col("p") - F.row_number().over(line)) \
        .groupBy(*DOC, "phrase_id", "diagonal", "n", "run") \
        .agg(F.min("pos").alias("start"), F.count(F.lit(1)).cast("int").alias("length"))
    return runs.filter(F.col("length") >= F.least(F.col("n"), F.lit(window))) \
        .select(*DOC, "phrase_id", "start", "length")


def proximity_matches(index: DataFrame, phrases: DataFrame, vocabulary: DataFrame, distance: int) -> DataFrame:
    """Places where every term of a phrase occurs, in any order, within
    ``distance`` words of an occurrence of the phrase's rarest term:
    ``doc_no, doc_key, phrase_id, pos``, the position of that occurrence."""
    terms = located_terms(phrases, vocabulary, index).select("phrase_id", "term_id", "freq").distinct()
    order = Window.partitionBy("phrase_id")
    ranked = terms.withColumn("rarest", F.row_number().over(order.orderBy("freq", "term_id")) == 1) \
        .withColumn("others", F.count(F.lit(1)).over(order) - 1)
    anchors = index.join(ranked.filter("rarest").select("phrase_id", "term_id", "others"), "term_id") \
        .select("phrase_id", "others", *DOC, "pos").distinct()
    near = anchors.join(ranked.filter("not rarest").select("phrase_id", "term_id"), "phrase_id") \
        .join(index.select("term_id", *DOC, F.col("pos").alias("at")), ["term_id", *DOC]) \
        .filter(F.abs(F.col("at") - F.col("pos")) <= distance)
    complete = near.groupBy("phrase_id", "others", *DOC, "pos").agg(F.count_distinct("term_id").alias("met")) \
        .filter(F.col("met") == F.col("others"))
    alone = anchors.filter("others = 0")
    return complete.select(*DOC, "phrase_id", "pos").union(alone.select(*DOC, "phrase_id", "pos"))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, one_in: int = ONE_IN) -> DataFrame:
    """One row per document: ``doc_id, doc_no, doc_key, n_words, n_hit,
    item_ids`` (sorted) and ``contaminated``: at least one word in ``one_in``
    lies in a match."""
    phrases = phrases_of(items)
    vocabulary = vocabulary_of(phrases)
    index = build_index(docs, vocabulary)
    matches = phrase_matches(index, phrases, vocabulary, window)
    spans = matches.join(small_side(phrases, BROADCAST_ROWS).select("phrase_id", "item_ids"), "phrase_id") \
        .groupBy(*DOC).agg(
            F.collect_set(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias("spans"),
            F.collect_set("item_ids").alias("ids"))
    hits = spans.select(*DOC, F.size(F.array_distinct(F.flatten("spans"))).cast("long").alias("n_hit"),
                        F.array_sort(F.array_distinct(F.flatten("ids"))).alias("item_ids"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return documents_of(index).join(hits, DOC, "left").select(
        "doc_id", *DOC, "n_words", n_hit.alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        ((n_hit > 0) & (n_hit * one_in >= F.col("n_words"))).alias("contaminated"))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, one_in: int = ONE_IN) -> DataFrame:
    """The documents that are not contaminated, all their columns."""
    bad = stored(contamination(docs.select("doc_id", "text"), items, window, one_in).filter("contaminated").select(*DOC), "contaminated")
    return packed(docs).join(small_side(bad, BROADCAST_ROWS), DOC, "left_anti").select("doc.*")
