"""Keyword categorizer.

Each keyword that occurs as a substring of the lower-cased description adds
its length to its category's score. The best score wins; a tie goes to the
category whose earliest matched keyword comes first in the lexicon.
Confidence = min(0.99, 0.55 + best/total * 0.4) rounded to 3 places the way
Python rounds floats (``py_round``). No match:
("Income", 0.55) for a positive amount, else ("Uncategorized", 0.30).

A lexicon given as a list is configuration: it becomes column expressions, so
the whole categorizer is one narrow projection with no shuffle, no join and no
Python worker. A lexicon given as a table, or a list too long for generated
code, is scanned for through a stored index (``lexicon_index``), with equal results.
"""

from __future__ import annotations

import json
from functools import lru_cache
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cashweave.functions.numeric import py_round
from cashweave.operators.lexicon_index import with_scores
from cashweave.schema import KEYWORD_LEXICON, TAX_CATEGORIES

RULES_METHOD = "rules"
EXPRESSION_LEXICON_LIMIT = 400  # keywords compiled to expressions; longer lists become a table, with equal results

RESULT_TYPE = T.StructType([
    T.StructField("category", T.StringType(), False),
    T.StructField("confidence", T.DoubleType(), False),
    T.StructField("rationale", T.StringType(), False),
])


def _lexicon_pairs(lexicon) -> list[tuple[str, str]]:
    """Normalise a user lexicon (dict or pairs)."""
    if lexicon is None:
        return list(KEYWORD_LEXICON)
    if isinstance(lexicon, DataFrame):
        raise TypeError("a lexicon table is joined: use categorize()")
    pairs = list(lexicon.items()) if isinstance(lexicon, dict) else list(lexicon)
    if not pairs:  # an empty lexicon falls back to the default one
        return list(KEYWORD_LEXICON)
    # A dict keeps one category per keyword (the last assignment) at the
    # position of its first occurrence.
    merged: dict[str, str] = {}
    for k, c in pairs:
        merged[k] = c
    return list(merged.items())


def _category_blocks(pairs: Sequence[tuple[str, str]]) -> list[tuple[str, list[tuple[int, str]]]]:
    by_cat: dict[str, list[tuple[int, str]]] = {}
    for pos, (kw, cat) in enumerate(pairs):
        by_cat.setdefault(cat, []).append((pos, kw))
    return list(by_cat.items())


def _sql_str(v: str) -> str:
    return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"


@lru_cache(maxsize=32)
def _score_sql(pairs: tuple[tuple[str, str], ...], text: str) -> tuple[tuple[str, str, str], ...]:
    """Per category: (score SQL, first-match SQL, category) over column ``text``.

    score = sum of the lengths of the category's keywords found in the text;
    first = minus the lexicon position of its first found keyword (or null).
    Written as SQL text so a lexicon of hundreds of keywords is one parse on
    the driver instead of thousands of small expression objects.
    """
    out = []
    for cat, kws in _category_blocks(pairs):
        terms = [f"CASE WHEN contains({text}, {_sql_str(kw)}) THEN {float(len(kw))} ELSE 0.0 END" for _, kw in kws]
        whens = " ".join(f"WHEN contains({text}, {_sql_str(kw)}) THEN {-pos}" for pos, kw in kws)
        out.append((" + ".join(terms), f"CASE {whens} END", cat))
    return tuple(out)


def _score_columns(text: Column, pairs: Sequence[tuple[str, str]]) -> list[tuple[Column, Column, str]]:
    """Column form of ``_score_sql`` for an arbitrary text column."""
    out = []
    for cat, kws in _category_blocks(pairs):
        score = None
        for pos, kw in kws:
            sc = F.when(text.contains(F.lit(kw)), F.lit(float(len(kw)))).otherwise(F.lit(0.0))
            score = sc if score is None else score + sc
        first = None
        for pos, kw in kws:
            hit = text.contains(F.lit(kw))
            first = F.when(hit, F.lit(-pos)) if first is None else first.when(hit, F.lit(-pos))
        out.append((score, first, cat))
    return out


def _fusion_barrier(c: Column) -> Column:
    """Always 0.0, but evaluated by an interpreted (higher-order) function.

    A projection holding such an expression is not fused into a whole-stage
    method. The keyword scoring is a few hundred expressions; fused with its
    neighbours it exceeds the JVM's 64 KB method limit, and Spark would retry
    that failing compile on every query before falling back. Kept apart, it
    is compiled as an ordinary split projection that the JIT handles well.
    """
    return F.size(F.filter(F.array(c), lambda x: F.lit(False))).cast("double")


def _finish(best: Column, total: Column, amount: Column) -> Column:
    """Struct(category, confidence, rationale) from the best category struct
    (score, neg_pos, category) and the total score."""
    matched = best["score"] > 0
    conf = py_round(F.least(F.lit(0.99), F.lit(0.55) + (best["score"] / total) * F.lit(0.4)), 3)
    positive = amount.cast("double") > 0
    category = F.when(matched, best["category"]).when(positive, F.lit("Income")) \
        .otherwise(F.lit("Uncategorized"))
    confidence = F.when(matched, conf).when(positive, F.lit(0.55)).otherwise(F.lit(0.30))
    rationale = F.when(matched, F.concat(F.lit("matched keywords -> "), best["category"])) \
        .when(positive, F.lit("positive amount, no keyword match")) \
        .otherwise(F.lit("no keyword matched"))
    return F.struct(category.alias("category"), confidence.alias("confidence"),
                    rationale.alias("rationale"))


def classify_column(description: Column | str, amount: Column | str, lexicon=None) -> Column:
    """Single-row classification as a struct column.

    For whole tables prefer ``categorize``, which stages the work so each
    intermediate is computed once.
    """
    d = F.col(description) if isinstance(description, str) else description
    a = F.col(amount) if isinstance(amount, str) else amount
    pairs = _lexicon_pairs(lexicon)
    text = F.lower(F.coalesce(d.cast("string"), F.lit("")))
    if len(pairs) > EXPRESSION_LEXICON_LIMIT:
        scores = _array_scores(text, pairs)
        best = F.array_max(scores)
        total = F.aggregate(scores, F.lit(0.0), lambda acc, x: acc + x["score"])
        return _finish(best, total, a)
    cols = _score_columns(text, pairs)
    best = F.greatest(*[F.struct(sc.alias("score"), fp.alias("neg_pos"), F.lit(c).alias("category"))
                        for sc, fp, c in cols]) if len(cols) > 1 else \
        F.struct(cols[0][0].alias("score"), cols[0][1].alias("neg_pos"), F.lit(cols[0][2]).alias("category"))
    total = cols[0][0]
    for sc, _, _ in cols[1:]:
        total = total + sc
    return _finish(best, total, a)


def categorize(df: DataFrame, lexicon=None, description: str = "description",
               amount: str = "amount", with_rationale: bool = False,
               method_col: bool = False) -> DataFrame:
    """Fill ``category`` and ``ai_confidence_score``.

    Row count and order are unchanged. Staged as three projections (the
    lower-cased text; per-category scores; the result struct) so every
    intermediate is computed once per row and the default lexicon path stays
    inside whole-stage codegen. A lexicon table (``keyword, category`` and
    perhaps ``ord``) is never collected; an empty one is the default lexicon.
    """
    if isinstance(lexicon, DataFrame) and lexicon.isEmpty():
        lexicon = None
    pairs = [] if isinstance(lexicon, DataFrame) else _lexicon_pairs(lexicon)
    if len(pairs) > EXPRESSION_LEXICON_LIMIT:
        lexicon = df.sparkSession.createDataFrame([(i, k, c) for i, (k, c) in enumerate(pairs)], "ord int, keyword string, category string")
    t, r = "_cat_text", "_cat_result"
    text = F.lower(F.coalesce(F.col(description).cast("string"), F.lit("")))
    if isinstance(lexicon, DataFrame):
        staged = with_scores(df, text, lexicon)
    else:
        staged = df.withColumn(t, text)
        cols = _score_sql(tuple(pairs), t)
        names = [f"_cat_s{i}" for i in range(len(cols))]
        firsts = [f"_cat_p{i}" for i in range(len(cols))]
        # Both apart from their neighbours: fused with them, the keywords are one
        # method too long for the JIT. Only categories found are asked for their
        # first keyword, as only the best score's ties need it.
        first_score = F.expr(cols[0][0])
        staged = staged.select("*", (first_score + _fusion_barrier(F.length(t))).alias(names[0]),
                               *[F.expr(sc).alias(n) for (sc, _, _), n in zip(cols[1:], names[1:])])
        found = [F.when(F.col(n) > 0, F.expr(fp)) for (_, fp, _), n in zip(cols, names)]
        staged = staged.select("*", *[f.alias(n) for f, n in zip(found, firsts)],
                               _fusion_barrier(F.length(t)).alias("_cat_apart"))
        structs = [F.struct(F.col(n).alias("score"), F.col(p).alias("neg_pos"), F.lit(c).alias("category"))
                   for n, p, (_, _, c) in zip(names, firsts, cols)]
        best = F.greatest(*structs) if len(structs) > 1 else structs[0]
        total = F.col(names[0])
        for n in names[1:]:
            total = total + F.col(n)
        staged = staged.select(*df.columns, t, best.alias("_cat_best"),
                               (total + F.col("_cat_apart")).alias("_cat_total"))
    staged = staged.withColumn(r, _finish(F.col("_cat_best"), F.col("_cat_total"), F.col(amount)))
    cols = []
    for c in df.columns:
        if c == "category":
            cols.append(F.col(f"{r}.category").alias("category"))
        elif c == "ai_confidence_score":
            cols.append(F.col(f"{r}.confidence").alias("ai_confidence_score"))
        else:
            cols.append(F.col(c))
    if "category" not in df.columns:
        cols.append(F.col(f"{r}.category").alias("category"))
    if "ai_confidence_score" not in df.columns:
        cols.append(F.col(f"{r}.confidence").alias("ai_confidence_score"))
    if with_rationale:
        cols.append(F.col(f"{r}.rationale").alias("rationale"))
    if method_col:
        cols.append(F.lit(RULES_METHOD).alias("categorizer_method"))
    return staged.select(*cols)


def _array_scores(text: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    """array<struct<score, neg_pos, category>> of the categories found, from a
    constant array of keywords: the form for long keyword lists, whose cost in
    code does not grow with the list."""
    words = json.dumps([{"k": k, "c": c, "p": p} for p, (k, c) in enumerate(pairs)])
    keywords = F.from_json(F.lit(words), "array<struct<k:string,c:string,p:int>>")
    hits = F.filter(keywords, lambda w: text.contains(w["k"]))

    def scored(hits):
        return F.transform(F.array_distinct(F.transform(hits, lambda w: w["c"])), lambda c: F.struct(
            F.aggregate(F.filter(hits, lambda w: w["c"] == c), F.lit(0.0), lambda a, w: a + F.length(w["k"])).alias("score"),
            (-F.array_min(F.transform(F.filter(hits, lambda w: w["c"] == c), lambda w: w["p"]))).alias("neg_pos"),
            c.alias("category")))

    return F.element_at(F.transform(F.array(hits), scored), 1)
