"""Keyword lexicon of any size as a table (J1, H1): a stored index, scanned for.

1. Keywords are sorted by their place and numbered, and stored in the shared
   folder (``place_no, keyword, category, n``).
2. Tasks take distinct lower-cased descriptions, ``BATCH`` bytes of them at a
   time, through the index in slices of about ``SLICE`` keywords. A place of a
   text is only looked up if some keyword begins with the same three bytes, and
   only in the lengths that such keywords have; what is looked up is the whole
   keyword, in a hash table. Scores are added up per category where they are
   found, so a description has one row, the number of the first keyword of its
   best category with its scores.
3. That number fetches the category from the index, and the description its
   rows, in two joins.

Descriptions are dealt once as distinct ones, then a row each; no substrings
and no meetings of texts and keywords are shuffled. Nothing is collected or
broadcast. A task holds a slice of the index, and up to ``KEEP`` bytes of slices
that it need not read again for its next batch. Scores equal those of the
expression form: a keyword given twice has the later category at the earlier
place, ties go to the category whose first found keyword comes first. Null and
empty keywords match nothing.
"""

from __future__ import annotations

from typing import Iterator, NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cashweave.session import list_files, scratch_dir, shared_fs, ship_package

BATCH = 4 << 20         # bytes of descriptions that meet the index together
WINDOW = 1 << 20        # places of them looked at together
SLICE = 1 << 20         # keywords of a slice
SLICE_BYTES = 32 << 20
KEEP = 256 << 20        # bytes of slices that a worker keeps
LOOKED_UP = 16 << 20    # bytes of substrings looked up together


def _keep_apart(side: DataFrame) -> DataFrame:
    """Joined by shuffle, however small Spark takes the side for: it grows with
    the descriptions or the lexicon and would be broadcast from the driver."""
    return side.hint("merge")


def keyword_table(lexicon: DataFrame) -> DataFrame:
    """``keyword, category, place``: each keyword once, with its later category
    at its first place (by ``ord``, or by keyword where there is none)."""
    rank = F.struct(F.col("ord") if "ord" in lexicon.columns else F.lit(0).alias("ord"), F.col("keyword").alias("k"))
    return lexicon.where(F.length("keyword") > 0).select("keyword", "category", rank.alias("rank")) \
        .groupBy("keyword").agg(F.max_by("category", "rank").alias("category"), F.min("rank").alias("place"))


def store_index(lexicon: DataFrame) -> str:
    """Folder of ``place_no`` (in order of place), ``keyword, category, n`` (code points)."""
    folder = scratch_dir(lexicon.sparkSession, "lexicon")
    keyword_table(lexicon).select("place", "keyword", F.col("category").cast("string").alias("category")).orderBy("place") \
        .select(F.monotonically_increasing_id().alias("place_no"), F.col("keyword").cast("string").alias("keyword"), "category", F.length("keyword").alias("n")) \
        .write.parquet(folder)
    return folder


class _Slice(NamedTuple):
    """Keywords by their length in bytes, and the lengths that follow a beginning."""
    words: dict[int, tuple[np.ndarray, np.ndarray, int]]    # their hashes, sorted; their bytes; most that share a hash
    at: dict[int, np.ndarray]           # their places in the columns below
    place_no: np.ndarray
    n: np.ndarray
    category: pa.Array                  # dictionary
    begins: list                        # per 64 lengths: (lengths, masks by 1, 2 and 3 bytes)

    @staticmethod
    def of(table: pa.Table) -> "_Slice":
        data, offsets = _bytes(table["keyword"])
        lens = np.diff(offsets)
        words, at, begins = {}, {}, []
        lengths = np.unique(lens)
        for part in (lengths[k:k + 64] for k in range(0, len(lengths), 64)):
            masks = [np.zeros(size, np.uint64) for size in (1 << 8, 1 << 16, 1 << 16)]
            for bit, m in enumerate(part.tolist()):
                at[m] = np.flatnonzero(lens == m).astype(np.int32)
                held = _cut(data, offsets[:-1][at[m]], m)
                hashes = _hash(held)
                order = np.argsort(hashes, kind="stable")
                hashes, at[m] = hashes[order], at[m][order]
                firsts = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]])
                words[m] = hashes, held[order], int(np.diff(np.r_[firsts, len(hashes)]).max())
                masks[min(m, 3) - 1][np.unique(_begins(held[:, :3].T)[-1])] |= np.uint64(1 << bit)
            begins.append((part.tolist(), masks))
        return _Slice(words, at, table["place_no"].to_numpy(), table["n"].to_numpy(), table["category"].combine_chunks(), begins)

    def nbytes(self) -> int:
        return sum(h.nbytes + w.nbytes for h, w, _ in self.words.values()) + sum(a.nbytes for a in self.at.values()) + self.place_no.nbytes + self.n.nbytes \
            + self.category.nbytes + sum(m.nbytes for _, masks in self.begins for m in masks)


def _bytes(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and where each begins and the last ends."""
    column = pc.cast(column, pa.large_binary()).combine_chunks()
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8) if len(column) else np.empty(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def _cut(data: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    return data[at[:, None] + np.arange(size)]


def _hash(cut: np.ndarray) -> np.ndarray:
    h = np.full(len(cut), 14695981039346656037, np.uint64)
    for k in range(cut.shape[1]):
        h = (h ^ cut[:, k]) * np.uint64(1099511628211)
    return h


def _begins(b) -> list[np.ndarray]:
    """Numbers of the first byte, the first two and, hashed, the first three, as far as there are."""
    b = [x.astype(np.uint32) for x in b]
    out = b[:1]
    if len(b) > 1:
        out.append(b[0] << 8 | b[1])
    if len(b) > 2:
        out.append(((out[1] << 8 | b[2]) * np.uint32(2654435761)) >> np.uint32(16))
    return [x.astype(np.uint16) for x in out]


def _slices(folder: str) -> Iterator[_Slice]:
    """The index in slices; those that fit into ``KEEP`` bytes are kept by the worker."""
    import pyarrow.parquet as pq

    if _KEPT.get("folder") != folder:
        _KEPT.clear()
        _KEPT.update(folder=folder, slices=[], whole=False)
    yield from _KEPT["slices"]
    if _KEPT["whole"]:
        return
    kept, size, done = list(_KEPT["slices"]), sum(s.nbytes() for s in _KEPT["slices"]), 0
    filling, skip = True, len(kept)
    for done, table in enumerate(_tables(folder, pq)):
        if done < skip:
            continue
        s = _Slice.of(table)
        size += s.nbytes()
        filling = filling and size <= KEEP
        if filling:
            _KEPT["slices"].append(s)
        yield s
    _KEPT["whole"] = filling


_KEPT: dict = {}


def _tables(folder: str, pq) -> Iterator[pa.Table]:
    system, parts, rows, size = shared_fs(folder)[0], [], 0, 0
    for path in list_files(folder, ".parquet"):
        with system.open_input_file(path) as file:
            for b in pq.ParquetFile(file, read_dictionary=["category"]).iter_batches(min(SLICE, 1 << 17)):
                if parts and (rows + b.num_rows > SLICE or size + b.nbytes > SLICE_BYTES):
                    yield pa.Table.from_batches(parts).unify_dictionaries()
                    parts, rows, size = [], 0, 0
                parts.append(b)
                rows, size = rows + b.num_rows, size + b.nbytes
    if rows:
        yield pa.Table.from_batches(parts).unify_dictionaries()


def _found(data: np.ndarray, offsets: np.ndarray, begins: list[np.ndarray], s: _Slice) -> tuple[np.ndarray, np.ndarray]:
    """(texts, places in the slice) of the keywords found, once for each time."""
    rows, hits = [np.empty(0, np.int32)], [np.empty(0, np.int32)]
    for start in range(0, len(data), WINDOW):
        for lengths, masks in s.begins:
            mask = np.zeros(min(WINDOW, len(data) - start), np.uint64)
            for numbers, m in zip(begins, masks):
                if m.any():
                    mask |= m[numbers[start:start + WINDOW]]
            at = np.flatnonzero(mask)
            mask, at = mask[at], at + start
            row = (np.searchsorted(offsets, at, side="right") - 1).astype(np.int32)
            room = offsets[row + 1] - at
            for bit, m in enumerate(lengths):
                some = np.flatnonzero((mask >> np.uint64(bit) & np.uint64(1)).astype(bool) & (room >= m))
                step = max(1, LOOKED_UP // m)
                for k in range(0, len(some), step):
                    part = some[k:k + step]
                    which, word = _look_up(_cut(data, at[part], m), *s.words[m])
                    rows.append(row[part[which]])
                    hits.append(s.at[m][word])
    return np.concatenate(rows), np.concatenate(hits)


def _look_up(cut: np.ndarray, hashes: np.ndarray, words: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(places in ``cut``, places in ``words``) of what is the same."""
    h = _hash(cut)
    at = np.searchsorted(hashes, h)
    which, found = [], []
    for k in range(most):
        near = np.minimum(at + k, len(hashes) - 1)
        same = np.flatnonzero((hashes[near] == h) & (at + k < len(hashes)))
        same = same[(words[near[same]] == cut[same]).all(axis=1)]
        which.append(same), found.append(near[same])
    return np.concatenate(which), np.concatenate(found)


def _best(texts: pa.Array, folder: str) -> pa.RecordBatch:
    """A row for each text that holds a keyword."""
    data, offsets = _bytes(pa.chunked_array([texts]))
    padded = np.r_[data, np.zeros(2, np.uint8)]
    begins = _begins([padded[k:k + len(data)] for k in range(3)])
    row, place, n, category = [], [], [], []
    for s in _slices(folder):
        r, hit = _found(data, offsets, begins, s)
        each = np.lexsort((hit, r))
        r, hit = r[each], hit[each]
        once = np.r_[True, (r[1:] != r[:-1]) | (hit[1:] != hit[:-1])][:len(r)]
        r, hit = r[once], hit[once]
        row.append(r), place.append(s.place_no[hit]), n.append(s.n[hit])
        category.append(pc.cast(s.category.take(pa.array(hit)), pa.string()))
    names = ["_cat_text", "place_no", "score", "total"]
    if not sum(map(len, row)):
        return pa.RecordBatch.from_arrays([texts[:0], *[pa.array([], t) for t in (pa.int64(), pa.float64(), pa.float64())]], names)
    row, place, n = np.concatenate(row), np.concatenate(place), np.concatenate(n).astype(float)
    code = pa.concat_arrays(category).dictionary_encode(null_encoding="encode").indices.to_numpy()
    order = np.lexsort((place, code, row))
    row, place, n, code = row[order], place[order], n[order], code[order]
    start = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (code[1:] != code[:-1])])
    row, place, score = row[start], place[start], np.add.reduceat(n, start)     # a row for each category of a text
    order = np.lexsort((place, -score, row))
    row, place, score = row[order], place[order], score[order]
    start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    return pa.RecordBatch.from_arrays([texts.take(pa.array(row[start])), pa.array(place[start]), pa.array(score[start]),
                                       pa.array(np.add.reduceat(score, start))], names)


def best_keywords(texts: DataFrame, folder: str) -> DataFrame:
    """``_cat_text, place_no, score, total`` of the texts (``_cat_text``) that
    hold keywords: the first keyword of the best category, its score, and that
    of all categories."""
    def scan(batches):
        held, size = [], 0
        for b in batches:
            for k in range(0, b.num_rows, 1024):
                part = b.column(0).slice(k, 1024)
                held.append(part)
                size += part.nbytes
                if size >= BATCH:
                    yield _best(pa.concat_arrays(held), folder)
                    held, size = [], 0
        if held:
            yield _best(pa.concat_arrays(held), folder)

    ship_package(texts.sparkSession)
    return texts.where(F.col("_cat_text").isNotNull()).mapInArrow(scan, "_cat_text string, place_no long, score double, total double")


def with_scores(df: DataFrame, text: Column, lexicon: DataFrame) -> DataFrame:
    """``df`` with ``_cat_best`` (score, category; null without a match) and ``_cat_total``."""
    rows = df.withColumn("_cat_text", text)
    folder = store_index(lexicon)
    found = best_keywords(rows.select("_cat_text").distinct(), folder)
    index = df.sparkSession.read.schema("place_no long, category string").parquet(folder)
    best = _keep_apart(found).join(_keep_apart(index), "place_no") \
        .select("_cat_text", F.struct("score", "category").alias("_cat_best"), F.col("total").alias("_cat_total"))
    return rows.join(_keep_apart(best), "_cat_text", "left")
