"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts of up to ``ORDER`` bytes, learned
from labelled documents. Under frozen statistics the code length of a byte is
exact and fixed: -log2 of its share in the deepest context that the language
knows, or that context's escape plus the code length one byte shorter, down to
eight bits for a byte never seen. So each tree is laid out once as sorted
tables (byte sequence: code length, context: escape) in a file of the shared
folder that workers map, and scoring looks up each distinct sequence of a
chunk of text once per language. The language of least code length wins; the
score is its probability if all languages are equally likely beforehand.

The classifier is fitted on a bounded sample: about ``ROWS_PER_LANGUAGE``
whole labelled documents of each language, picked by a hash of the row. That
is the only bound: all byte sequences of the sample are kept, each tree is
built in a task of its own, and of every label (``languages`` names a number
to keep the most frequent labels only). Every document is scored over its
whole text.

Nulls and ties: null text, text without a letter, and any text if nothing
could be learned, is ``und`` with score 0; rows without a label or an id are
scored like others and only taught from if labelled; of equal code lengths
the alphabetically first language wins.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cashweave.llm.common import list_files, packed, scratch_dir, shared_fs

ORDER = 3
ROWS_PER_LANGUAGE = 2000
CHUNK = 1 << 18            # bytes scored at a time
BATCH_ROWS = 500           # rows whose texts a task holds decoded; 10,000 of them are hundreds of megabytes
UNKNOWN = "und"


def _grams(data: np.ndarray) -> np.ndarray:
    """Each byte with the three before it (zeros before the beginning), as one number."""
    d = np.concatenate((np.zeros(ORDER, np.uint32), data.astype(np.uint32)))
    return d[:-3] << 24 | d[1:-2] << 16 | d[2:-1] << 8 | d[3:]


def gram_counts(rows: DataFrame) -> DataFrame:
    """``lang, gram, n`` of labelled rows (``lang, text``), languages by number."""

    def run(batches):
        for b in batches:
            parts: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                parts.setdefault(lang, []).append(_grams(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)))
            for lang, grams in parts.items():
                gram, n = np.unique(np.concatenate(grams), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(gram), lang, np.int64)), pa.array(gram.astype(np.int64)), pa.array(n.astype(np.int64))],
                    ["lang", "gram", "n"])

    return rows.select("lang", "text").mapInArrow(run, "lang long, gram long, n long") \
        .groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Tree:
    """The frozen tree of one language: by order, the sorted sequences (context
    and byte) with their code lengths, the sorted contexts with their escapes."""

    def __init__(self, orders: list[tuple[np.ndarray, ...]]):
        self.orders = orders

    @classmethod
    def of_counts(cls, gram, n) -> Tree:
        """From counted byte sequences: arrays of the sequence and its count."""
        gram, n, orders = np.asarray(gram).astype(np.uint32), np.asarray(n, np.float64), []
        for order in range(ORDER + 1):
            grams, where = np.unique(gram & _mask(order), return_inverse=True)
            c = np.bincount(where, n)
            contexts, first, which, kinds = np.unique(grams >> 8, return_index=True, return_inverse=True, return_counts=True)
            size = np.add.reduceat(c, first) + kinds
            orders.append((grams, -np.log2(c / size[which]).astype(np.float32), contexts, -np.log2(kinds / size).astype(np.float32)))
        return cls(orders)

    def costs(self, grams: np.ndarray) -> np.ndarray:
        """Code length in bits of the last byte of each sequence after the others."""
        out, rest = np.zeros(len(grams), np.float32), np.arange(len(grams))
        for order in range(ORDER, -1, -1):
            known, cost, contexts, escape = self.orders[order]
            key = grams[rest] & _mask(order)
            at, found = _find(known, key)
            out[rest[found]] += cost[at[found]]
            rest, key = rest[~found], key[~found] >> 8
            at, found = _find(contexts, key)
            out[rest[found]] += escape[at[found]]
        out[rest] += 8
        return out

    def save(self, file: str) -> None:
        system, path = shared_fs(file)
        with system.open_output_stream(path) as out:
            out.write(np.array([len(a) for order in self.orders for a in order], np.int64).tobytes())
            for order in self.orders:
                for a in order:
                    out.write(a.tobytes())

    @classmethod
    def load(cls, file: str) -> Tree:
        """Mapped from a local or mounted folder, read from another store."""
        system, path = shared_fs(file)
        if system.type_name == "local":
            data = pa.memory_map(path).read_buffer()
        else:
            with system.open_input_stream(path) as f:
                data = f.read()
        at, orders, arrays = 32 * (ORDER + 1), [], []
        for k, size in enumerate(np.frombuffer(data, np.int64, 4 * (ORDER + 1))):
            arrays.append(np.frombuffer(data, np.float32 if k % 2 else np.uint32, int(size), at))
            at += 4 * int(size)
        for order in range(ORDER + 1):
            orders.append(tuple(arrays[4 * order:4 * order + 4]))
        return cls(orders)


def _mask(order: int) -> np.uint32:
    return np.uint32((1 << 8 * (order + 1)) - 1)


def _find(known: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each key among the sorted known ones, and whether it is there."""
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return at, known[at] == keys


class Trees:
    """The frozen trees of all languages, in memory or in files."""

    def __init__(self, languages: list[str], trees: list[Tree] | None = None, files: list[str] | None = None):
        self.languages = list(languages)
        self.files = files
        self._trees = trees

    @property
    def trees(self) -> list[Tree]:
        if self._trees is None:
            self._trees = [Tree.load(f) for f in self.files]
        return self._trees

    @classmethod
    def of_rows(cls, rows: list[tuple[str, int, int]]) -> Trees:
        languages = sorted({r[0] for r in rows})
        return cls(languages, [Tree.of_counts([g for l, g, _ in rows if l == lang], [n for l, _, n in rows if l == lang]) for lang in languages])

    def saved(self, folder: str) -> list[str]:
        """The trees' files; trees in memory are written to ``folder`` before."""
        if self.files is None:
            system, path = shared_fs(folder)
            system.create_dir(path, recursive=True)
            files = [f"{folder}/{k}.tree" for k in range(len(self.trees))]
            for tree, file in zip(self.trees, files):
                tree.save(file)
            self.files = files
        return self.files

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Code length in bits of each text (one row) under each language."""
        out = np.zeros((len(texts), len(self.languages)))
        for first, last in _groups([len(t) for t in texts]):
            pad = bytes(ORDER)
            data = np.frombuffer(pad + pad.join(texts[first:last]), np.uint8).astype(np.uint32)
            sizes = np.array([len(t) for t in texts[first:last]])
            ends = np.cumsum(sizes + ORDER)
            for at in range(0, len(data) - ORDER, CHUNK):
                d = data[at:at + CHUNK + ORDER]
                grams, where = np.unique(d[:-3] << 24 | d[1:-2] << 16 | d[2:-1] << 8 | d[3:], return_inverse=True)
                a = np.clip(ends - sizes - ORDER - at, 0, len(where))
                b = np.clip(ends - ORDER - at, 0, len(where))
                total = np.zeros(len(where) + 1)
                for k, tree in enumerate(self.trees):
                    np.cumsum(tree.costs(grams)[where], dtype=np.float64, out=total[1:])
                    out[first:last, k] += total[b] - total[a]
        return out


def _groups(sizes: list[int]):
    """Slices of consecutive texts of about a chunk together."""
    first, held = 0, 0
    for k, size in enumerate(sizes):
        if held and held + size > CHUNK:
            yield first, k
            first, held = k, 0
        held += size + ORDER
    if sizes:
        yield first, len(sizes)


def fit(labelled: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE, languages: int | None = None) -> Trees:
    """Trees from ``doc_id, text, lang``; rows without text or label teach nothing."""
    spark = labelled.sparkSession
    rows = labelled.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & (F.length("text") > 0))
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    if languages is not None:
        sizes = sizes.orderBy(F.desc("n"), "lang").limit(languages)
    sizes = {r[0]: r[1] for r in sizes.collect()}
    if not sizes:
        return Trees([], [])
    names = sorted(sizes)
    shares = spark.createDataFrame([(lang, k, min(1.0, rows_per_language / sizes[lang])) for k, lang in enumerate(names)],
                                   "lang string, place long, share double")
    picked = rows.join(F.broadcast(shares), "lang").filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < F.col("share") * (1 << 20))
    counted, folder = scratch_dir(spark, "gram-counts"), scratch_dir(spark, "trees")
    gram_counts(picked.select(F.col("place").alias("lang"), "text")).orderBy("lang", "gram").write.parquet(counted)

    def build(batches):
        from pyarrow import dataset

        system, path = shared_fs(folder)
        system.create_dir(path, recursive=True)
        source = dataset.dataset(list_files(counted, ".parquet"), format="parquet", filesystem=shared_fs(counted)[0])
        for b in batches:
            for k in b.column(0).to_pylist():
                rows = source.to_table(columns=["gram", "n"], filter=dataset.field("lang") == k, use_threads=False)
                file = f"{folder}/{k}-{uuid.uuid4().hex}.tree"
                Tree.of_counts(rows["gram"].to_numpy(), rows["n"].to_numpy()).save(file)
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([file])], ["lang", "file"])

    built = spark.range(0, len(names), 1, len(names)).mapInArrow(build, "lang long, file string").collect()
    files = {r[0]: r[1] for r in built}
    return Trees(names, files=[files[k] for k in range(len(names))])


def predict(docs: DataFrame, trees: Trees) -> DataFrame:
    """``doc`` (the whole row), ``lang_pred`` and ``score`` of every row."""
    rows = packed(docs).select("doc", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    schema = rows.select("doc").schema.add("lang_pred", "string").add("score", "double")
    languages, files = trees.languages, trees.saved(scratch_dir(docs.sparkSession, "trees"))
    text_at = [c.lower() for c in docs.columns].index("text")     # texts travel once, in their rows

    def run(batches):
        for b in batches:
            yield from _scored(b, text_at, load(languages, files))

    return rows.mapInArrow(run, schema)


def _scored(b: pa.RecordBatch, text_at: int, trees: Trees):
    """Batches ``doc, lang_pred, score`` of a batch ``doc, letters``, of which
    only ``BATCH_ROWS`` rows at a time are held as Python's texts."""
    for first in range(0, b.num_rows, BATCH_ROWS):
        part = b.slice(first, BATCH_ROWS)
        letters = np.array(part.column(1).to_pylist(), bool)
        lang, score = [UNKNOWN] * part.num_rows, np.zeros(part.num_rows)
        which = np.flatnonzero(letters) if trees.languages else []
        if len(which):
            texts = [t.encode("utf-8", "surrogatepass") for t in part.column(0).field(text_at).take(pa.array(which)).to_pylist()]
            bits = trees.bits(texts)
            best = bits.argmin(1)
            over = np.minimum(bits - bits.min(1, keepdims=True), 1000)
            score[which] = 1 / np.exp2(-over).sum(1)
            for i, k in zip(which, best):
                lang[i] = trees.languages[k]
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                                         ["doc", "lang_pred", "score"])


_LOADED: dict[tuple, Trees] = {}


def load(languages: list[str], files: list[str]) -> Trees:
    """The process's copy of saved trees (workers are reused)."""
    if tuple(files) not in _LOADED:
        _LOADED.clear()
        _LOADED[tuple(files)] = Trees(languages, files=files)
    return _LOADED[tuple(files)]


def held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> DataFrame:
    """Fit on the documents that are not held out, predict all."""
    trees = fit(docs.select("doc_id", "text", "lang").filter(~held_out()), rows_per_language)
    return predict(docs, trees)
