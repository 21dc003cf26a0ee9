"""Note store and similarity search.

A note store is a DataFrame ``(id, text, metadata, embedding, seq)``; ``seq``
is the insertion order (later = newer) and breaks score ties, as the
in-memory store's list order did.

Search scores every question against every note without a row per pair: both
sides are dealt into blocks, and every pair of blocks meets in one run of rows,
the notes first and the questions after them. A task holds the notes of one
meeting and a batch of questions, however many there are of either, and keeps
the k best notes of each question. A final ``row_number() <= k`` per question
merges them. Questions of equal texts are embedded once, and those of equal
vectors, which have equal hits, are scored once.
The vectors asked for, and with ``keep`` their best notes, are stored in the
shared folder, so hits may be used often for one search. Nothing passes through the driver but two counts. Vectors of different widths,
and vectors that are null, zero or not finite, score 0, which is no hit; notes
without a ``seq`` take no part.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cashweave.functions.embeddings import with_embedding
from cashweave.functions.hashing import stable_note_id
from cashweave.functions.text import py_strip
from cashweave.schema import DEFAULT_EMBED_DIM
from cashweave.session import ship_package, stored

DEFAULT_K = 4
QUESTION_BLOCK = 65_536
NOTE_BLOCK = 16_384
TILE = 1 << 19          # numbers in a dense tile
MOST_TASKS = 10_000


# ---------------------------------------------------------------------------
# Building and upserting notes
# ---------------------------------------------------------------------------

def prepare_notes(batch: DataFrame, text: str = "text", id_col: str | None = None,
                  metadata: str | Column | None = None, order_by: str | None = None,
                  dim: int = DEFAULT_EMBED_DIM, embed=None) -> tuple[DataFrame, DataFrame]:
    """Validate and embed a batch of notes.

    Returns ``(accepted, rejected)``. Blank texts are rejected (the store
    refuses them); the id defaults to the stable hash of the untrimmed text;
    the stored text is trimmed; the embedding is taken from the untrimmed
    text, by ``embed(frame, text column, new column)`` if given (H2; it adds
    array<double> vectors), else by the hashing embedder. ``order_by`` gives
    the batch order (``pos``); without it, the order of the scan.
    """
    raw = F.col(text).cast("string")
    blank = raw.isNull() | (py_strip(raw) == "")
    ident = stable_note_id(raw) if id_col is None else F.coalesce(F.col(id_col).cast("string"), stable_note_id(raw))
    if metadata is None:
        meta = F.create_map().cast("map<string,string>")
    else:
        m = F.col(metadata) if isinstance(metadata, str) else metadata
        meta = F.coalesce(m, F.create_map().cast("map<string,string>"))
    pos = F.col(order_by).cast("long") if order_by else F.monotonically_increasing_id()
    staged = batch.select(ident.alias("id"), raw.alias("_raw"), meta.alias("metadata"), pos.alias("pos"),
                          blank.alias("_blank"))
    rejected = staged.where("_blank").select("id", F.col("_raw").alias("text"), "pos")
    # a later note of the same id replaces it, so only the last is embedded
    last = Window.partitionBy("id").orderBy(F.col("pos").desc())
    kept = staged.where(~F.col("_blank")).withColumn("_rk", F.row_number().over(last)).where("_rk = 1")
    ok = (embed or _hashing(dim))(kept.drop("_rk"), "_raw", "embedding")
    accepted = ok.select("id", py_strip("_raw").alias("text"), "metadata", "embedding", "pos")
    return accepted, rejected


def upsert_notes(store: DataFrame | None, batch: DataFrame) -> DataFrame:
    """Insert-or-replace a prepared batch into a store.

    A record with an existing id replaces it and moves to the end; within the
    batch the later duplicate wins. Keep-last is ``row_number() == 1`` per id,
    which Spark pre-filters per partition before the shuffle.
    """
    fresh = batch.select("id", "text", "metadata", "embedding", F.col("pos").cast("long").alias("seq"))
    if store is not None:
        # one row, so it can be broadcast; it continues the numbering
        top = store.agg((F.coalesce(F.max("seq"), F.lit(-1)) + 1).alias("_base"))
        fresh = fresh.join(F.broadcast(top)).withColumn("seq", F.col("seq") + F.col("_base")).drop("_base")
    both = fresh if store is None else store.select("id", "text", "metadata", "embedding", "seq").unionByName(fresh)
    w = Window.partitionBy("id").orderBy(F.col("seq").desc())
    return both.withColumn("_rk", F.row_number().over(w)).where("_rk = 1").drop("_rk")


def note_count(store: DataFrame) -> DataFrame:
    """Store size."""
    return store.agg(F.count(F.lit(1)).alias("notes"))


# ---------------------------------------------------------------------------
# Search
# ---------------------------------------------------------------------------

def _keep_best(cols: np.ndarray, scores: np.ndarray, seqs: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best by (score desc, seq asc) of each column, by column."""
    order = np.lexsort((seqs, -scores, cols))
    c = cols[order]
    starts = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
    rank = np.arange(len(c)) - np.repeat(starts, np.diff(np.r_[starts, len(c)]))
    return order[rank < k]


def _hashing(dim: int):
    return lambda df, text, out: with_embedding(df, text, out, dim)


def _as_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """``key, width, idx, val, norm`` of a sparse hashing embedding or a dense
    array; null and empty arrays are left out. (Zero vectors are told later: a
    filter on the norm would be pushed below the embedding's steps and have
    them computed again and again.)"""
    v = F.col(vector)
    if isinstance(df.schema[vector].dataType, T.StructType):
        out = df.select(F.col(key).alias("key"), F.lit(-1).alias("width"), v["idx"].alias("idx"),
                        v["cnt"].cast("array<double>").alias("val"), F.sqrt(v["sumsq"].cast("double")).alias("norm"))
    else:
        val = F.transform(v, lambda x: F.coalesce(x.cast("double"), F.lit(0.0)))
        out = df.where(v.isNotNull() & (F.size(v) > 0)).select(
            F.col(key).alias("key"), F.size(v).alias("width"), F.sequence(F.lit(0), F.size(v) - 1).alias("idx"), val.alias("val"))
        out = out.withColumn("norm", F.sqrt(F.aggregate("val", F.lit(0.0), lambda a, x: a + x * x)))
    return out


class _Rows(NamedTuple):
    """Sparse vectors in parallel arrays; ``keys`` is an Arrow array."""
    keys: pa.Array
    lens: np.ndarray
    idx: np.ndarray
    val: np.ndarray
    norms: np.ndarray

    @staticmethod
    def of(batch: pa.RecordBatch, key: str) -> "_Rows":
        idx, val = batch.column("idx"), batch.column("val")
        return _Rows(batch.column(key), np.diff(idx.offsets.to_numpy()), idx.flatten().to_numpy(), val.flatten().to_numpy(),
                     batch.column("norm").to_numpy(zero_copy_only=False))

    def dense(self, a: int, z: int, at: np.ndarray, width: int) -> np.ndarray:
        """Vectors a to z; ``at`` is where each vector starts."""
        m = np.zeros((z - a, width))
        part = slice(at[a], at[z])
        m[np.repeat(np.arange(z - a), self.lens[a:z]), self.idx[part]] = self.val[part]
        return m

    def least(self) -> float:
        """Smallest positive share of a vector's length, or -1 if any is negative."""
        share = self.val / np.repeat(np.where(self.norms > 0, self.norms, 1.0), self.lens)
        return -1.0 if share.min(initial=0.0) < 0 else float(share[share > 0].min(initial=1.0))


def _join_rows(parts: list[_Rows]) -> _Rows:
    return _Rows(pa.concat_arrays([p.keys for p in parts]), *[np.concatenate([getattr(p, f) for p in parts]) for f in _Rows._fields[1:]])


def _drop_unscored(rows: _Rows) -> _Rows:
    """Without the vectors that score 0 with everything: zero or not finite."""
    ok = np.isfinite(rows.norms) & (rows.norms > 0)
    if ok.all():
        return rows
    held = np.repeat(ok, rows.lens)
    return _Rows(rows.keys.filter(pa.array(ok)), rows.lens[ok], rows.idx[held], rows.val[held], rows.norms[ok])


def _best_notes(notes: _Rows, asked: _Rows, k: int):
    """(question places, note places, scores) of the k best notes of each question.

    Tile by tile, products of single precision sort out what cannot be among
    the k best (they are off by less than ``slack``); the rest is scored in
    double precision. Notes begin with a small tile, for a bound at once."""
    if not len(notes.lens) or not len(asked.lens):
        return
    width = 1 + int(max(notes.idx.max(initial=0), asked.idx.max(initial=0)))
    real = np.float32 if width <= 4096 else np.float64
    slack = 2 * (width + 8) * float(np.finfo(real).eps)
    small = (notes.least(), asked.least())
    floor = 0.0 if min(small) > 0 and small[0] * small[1] > 1e-30 else -slack
    tile = max(16, min(1024, TILE // width))
    seqs = notes.keys.to_numpy()
    n_at, q_at = np.r_[0, np.cumsum(notes.lens)], np.r_[0, np.cumsum(asked.lens)]
    for a in range(0, len(asked.lens), tile):
        z = min(a + tile, len(asked.lens))
        q, qnorms = asked.dense(a, z, q_at, width), asked.norms[a:z]
        unit = (q / qnorms[:, None]).astype(real)
        col, row, score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        bound = np.full(z - a, floor)
        start, size = 0, 64
        while start < len(notes.lens):
            end = min(start + size, len(notes.lens))
            m = notes.dense(start, end, n_at, width)
            near = (m / notes.norms[start:end, None]).astype(real) @ unit.T
            r, c = np.nonzero(near > bound[None, :].astype(real))
            if len(r):
                dots = np.concatenate([np.einsum("ij,ij->i", m[r[i:i + step]], q[c[i:i + step]])
                                       for step in [max(1, 4 * TILE // width)] for i in range(0, len(r), step)])
                scale = notes.norms[start + r] * qnorms[c]
                s = np.divide(dots, scale, out=np.zeros(len(r)), where=scale > 0)
                hit = s > 0
                col, row, score = np.r_[col, c[hit]], np.r_[row, start + r[hit]], np.r_[score, s[hit]]
                best = _keep_best(col, score, seqs[row], k)
                col, row, score = col[best], row[best], score[best]
                last = np.flatnonzero(np.r_[col[1:] != col[:-1], True][:len(col)])
                full = last[np.bincount(col, minlength=z - a)[col[last]] == k]
                # a little lower than the bound in either precision
                bound[col[full]] = np.maximum(score[full] - slack, floor)
            start, size = end, min(2 * size, tile)
        yield col + a, row, score


def _meet(k: int):
    """Scores streams of rows in order of meeting; a meeting's notes come
    before its questions, so only its notes are held and questions pass by."""
    def score(batches):
        meeting, parts, notes = None, [], None
        for b in batches:
            of = np.stack([b.column(c).to_numpy() for c in ("width", "i", "q", "asks")])
            cuts = np.flatnonzero(np.r_[True, (of[:, 1:] != of[:, :-1]).any(axis=0)]) if b.num_rows else np.empty(0, int)
            for a, z in zip(cuts, np.r_[cuts[1:], b.num_rows]):
                if meeting != tuple(of[:3, a]):
                    meeting, parts, notes = tuple(of[:3, a]), [], None
                run = b.slice(a, z - a)
                if not of[3, a]:
                    parts.append(_drop_unscored(_Rows.of(run, "seq")))
                elif parts:
                    notes = notes or _join_rows(parts)
                    asked = _drop_unscored(_Rows.of(run, "vec"))
                    for col, row, s in _best_notes(notes, asked, k):
                        yield pa.RecordBatch.from_arrays([asked.keys.take(pa.array(col)), notes.keys.take(pa.array(row)), pa.array(s)],
                                                         ["vec", "seq", "score"])
    return score


def _grid(items: DataFrame, item: str, item_vector: str, queries: DataFrame, query: str, query_vector: str, k: int,
          item_block: int, query_block: int, questions: DataFrame | None = None, keep: bool = False) -> DataFrame:
    """``question_id, seq, score, rank`` of the k best items of each query, or
    of each of the ``questions`` (question_id, <query>) that ask one. ``keep``
    stores what was found, as each use of it would embed and search again."""
    left = _as_vectors(items, item, item_vector).where(F.col("key").isNotNull())
    vec = F.unhex(F.md5(F.to_json(F.struct("width", "idx", "val"))))
    asked = stored(_as_vectors(queries, query, query_vector).withColumn("vec", vec), "asked-vectors")
    right = asked.select("vec", "width", "idx", "val", "norm").dropDuplicates(["vec"])
    n_items, n_queries = (max(1, -(-rows // size)) for rows, size in
                          ((items.select(item).count(), item_block), (asked.select("vec").distinct().count(), query_block)))

    def others(count):
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    common = ["width", "i", "q", "asks", "seq", "vec", "idx", "val", "norm"]
    notes = left.withColumn("i", F.pmod(F.xxhash64("key", "idx"), F.lit(n_items)).cast("int")).withColumn("q", others(n_queries)) \
        .select("width", "i", "q", F.lit(0).alias("asks"), F.col("key").cast("long").alias("seq"), F.lit(None).cast("binary").alias("vec"), "idx", "val", "norm")
    asks = right.withColumn("q", F.pmod(F.xxhash64("vec"), F.lit(n_queries)).cast("int")).withColumn("i", others(n_items)) \
        .withColumn("asks", F.lit(1)).withColumn("seq", F.lit(None).cast("long")).select(*common)
    tasks = min(4 * n_items * n_queries, MOST_TASKS)        # more than meetings, as they are dealt by hash
    met = notes.unionByName(asks).repartition(tasks, "width", "i", "q") \
        .sortWithinPartitions("width", "i", "q", "asks")
    ship_package(items.sparkSession)
    found = met.mapInArrow(_meet(k), "vec binary, seq long, score double")
    best_first = [F.col("score").desc(), F.col("seq").asc()]
    of_vector = Window.partitionBy("vec").orderBy(*best_first)
    top = found.withColumn("rank", F.row_number().over(of_vector)).where(F.col("rank") <= k).drop("rank")
    top = stored(top, "best-notes") if keep else top
    # Ids may repeat, with other texts.
    hits = asked.select(F.col("key").alias("question_id" if questions is None else query), F.col("vec").alias("_vec")) \
        .join(top, F.col("_vec") == F.col("vec")).drop("vec", "_vec")
    if questions is not None:
        hits = questions.join(hits, query).drop(query)
    of_question = Window.partitionBy("question_id").orderBy(*best_first)
    return hits.withColumn("rank", F.row_number().over(of_question).cast("int")).where(F.col("rank") <= k)


def search_notes(notes: DataFrame, questions: DataFrame, k: int = DEFAULT_K,
                 dim: int = DEFAULT_EMBED_DIM, question_text: str = "question", embed=None,
                 note_block: int = NOTE_BLOCK, question_block: int = QUESTION_BLOCK, keep: bool = False) -> DataFrame:
    """Top-k notes per question by cosine similarity.

    ``notes``: (id, text, metadata, embedding, seq); ``questions``:
    (question_id, <question_text>). ``embed`` is the embedder the notes were
    made with (H2). Returns (question_id, rank, id, text, metadata, score) for
    hits with score > 0, best first, ties to the older note. With ``keep`` the
    search is done here, once for all uses of the hits.
    """
    asked = questions.select(F.col("question_id").cast("long").alias("question_id"), F.col(question_text).alias("_qt"))
    # Stored, as filters on the vectors would be pushed below the distinct, and embed each question.
    texts = (embed or _hashing(dim))(stored(asked.select("_qt").distinct(), "asked-texts"), "_qt", "qemb")
    top = _grid(notes, "seq", "embedding", texts, "_qt", "qemb", k, note_block, question_block, asked, keep)
    return notes.select("seq", "id", "text", "metadata").join(top, "seq") \
        .select("question_id", "rank", "id", "text", "metadata", "score", "seq")


def search_vectors(items: DataFrame, queries: DataFrame, k: int = DEFAULT_K,
                   item_block: int = NOTE_BLOCK, query_block: int = QUESTION_BLOCK) -> DataFrame:
    """Top-k items per query by cosine of dense vectors (X14 with L2 norm).

    ``items``: (seq long, vec array<float|double>); ``queries``:
    (question_id long, qvec array<double>). Returns (question_id, rank, seq,
    score) for scores above 0.
    """
    return _grid(items, "seq", "vec", queries, "question_id", "qvec", k, item_block, query_block) \
        .select("question_id", "rank", "seq", "score")
