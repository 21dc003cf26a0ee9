"""Binary files of token ids in ascending order of ``doc_id``.

``write_coded`` writes range-coded files (see ``range_coder``): a header, runs
of coded blocks, and a footer with each document's id and number of ids.
``read_coded`` reads them back, group of blocks by group of blocks.
``write_flat`` writes nothing but the ids, fixed width, each document followed
by an end-of-document id, in the order of the input.

For coded files, documents are dealt by ranges of ``doc_id`` (rows without an id
come first, rows of one id by a hash of their text). One task writes one file. A file is
written under a name of its own and then renamed, so a task that is run again
replaces what a lost one left. Null and empty texts are documents without
ids but the end id; repeated rows are documents each; an empty table gives no
document.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cashweave.llm import range_coder as rc
from cashweave.llm.common import list_files, scratch_dir, shared_fs, shuffle_partitions, stored
from cashweave.llm.token_ids import default_tokenizer, encoder

MAGIC = b"CWIDS3\n\0"
TAIL = "<QQI"                       # footer's place, its length, vocabulary
DOCUMENT = np.dtype([("null", "u1"), ("doc_id", "<i8"), ("n", "<u8")])
GROUP = rc.LANES * rc.BLOCK
FILES_SCHEMA = "part int, file string, n_docs long, n_ids long"
FLAT_SCHEMA = FILES_SCHEMA + ", doc_ids array<long>"


def in_order(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` in ranges of ``doc_id``, each sorted."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.xxhash64("text").alias("tie"))
    parts = shuffle_partitions(docs.sparkSession)
    return rows.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")


class _File:
    """A file that appears under its name only when it is complete."""

    def __init__(self, folder: str, name: str):
        self.fs, path = shared_fs(folder)
        self.fs.create_dir(path, recursive=True)
        self.name = f"{path}/{name}"
        self.draft = f"{path}/.{name}-{uuid.uuid4().hex}"
        self.stream = self.fs.open_output_stream(self.draft)

    def done(self) -> str:
        self.stream.close()
        self.fs.move(self.draft, self.name)
        return self.name


def _write(docs: DataFrame, folder: str, task) -> DataFrame:
    return stored(in_order(docs).mapInArrow(task, FILES_SCHEMA), "files")


def _file_row(part: int, name: str, n_docs: int, n_ids: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([part], pa.int32()), pa.array([name]), pa.array([n_docs], pa.int64()), pa.array([n_ids], pa.int64())],
        ["part", "file", "n_docs", "n_ids"])


def _with_ends(ids: np.ndarray, ends: np.ndarray, end_id: int) -> np.ndarray:
    """The ids with the end id put in, so that it stands at ``ends``."""
    out = np.full(len(ids) + len(ends), end_id, np.result_type(ids.dtype, np.min_scalar_type(end_id)))
    others = np.ones(len(out), bool)
    others[ends] = False
    out[others] = ids
    return out


def write_coded(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2, folder: str | None = None) -> DataFrame:
    """Write coded files; one row per file: ``part, file, n_docs, n_ids``."""
    path, where = tokenizer or default_tokenizer(), folder or scratch_dir(docs.sparkSession, "coded-ids")

    def task(batches):
        out, index, held, n_held, n_ids, vocabulary = None, [], [], 0, 0, 0

        def flush(all_of_it: bool):
            nonlocal held, n_held
            while n_held >= GROUP or (all_of_it and n_held):
                ids = np.concatenate(held)
                part, rest = ids[:GROUP], ids[GROUP:]
                for block in rc.encode_blocks(part, vocabulary):
                    out.stream.write(block)
                held, n_held = ([rest], len(rest)) if len(rest) else ([], 0)

        for b in batches:
            enc = encoder(path)
            if out is None:
                vocabulary = max(enc.tok.get_vocab_size(with_added_tokens=True), end_id + 1)
                out = _File(where, f"part-{TaskContext.get().partitionId():05d}.ids")
                out.stream.write(MAGIC)
            rows = np.zeros(b.num_rows, DOCUMENT)
            rows["null"] = b.column(0).is_null().to_numpy(zero_copy_only=False)
            rows["doc_id"] = b.column(0).fill_null(0).to_numpy()
            at = 0
            for ids, counts in enc.encode_rows(b.column(1)):
                ends = np.cumsum(counts + 1)
                rows["n"][at:at + len(counts)] = counts + 1
                at += len(counts)
                ids = _with_ends(ids, ends - 1, end_id)
                held.append(ids)
                n_held += len(ids)
                n_ids += len(ids)
                flush(False)
            index.append(rows)
        if out is None:
            return
        flush(True)
        place = out.stream.tell()
        footer = zlib.compress(np.concatenate(index).tobytes(), 1)
        out.stream.write(footer + struct.pack(TAIL, place, len(footer), vocabulary))
        yield _file_row(TaskContext.get().partitionId(), out.done(), sum(map(len, index)), n_ids)

    return _write(docs, where, task)


def read_coded_file(fs, name: str):
    """Yields (doc_id, first id's place in the file, ids) of each document."""
    size = fs.get_file_info(name).size
    with fs.open_input_file(name) as f:
        f.seek(size - struct.calcsize(TAIL))
        place, length, vocabulary = struct.unpack(TAIL, f.read(struct.calcsize(TAIL)))
        f.seek(place)
        index = np.frombuffer(zlib.decompress(f.read(length)), DOCUMENT)
        f.seek(0)
        if f.read(len(MAGIC)) != MAGIC:
            raise ValueError(f"{name} is no file of coded ids")
        held, first = np.zeros(0, "<u4"), 0
        for null, doc_id, n in index.tolist():
            while len(held) < n:
                blocks = []
                while len(blocks) < rc.LANES and f.tell() < place:
                    count, length, crc = rc.HEADER.unpack(f.read(rc.HEADER.size))
                    blocks.append((count, crc, f.read(length)))
                if not blocks:
                    raise ValueError(f"{name} ends too early")
                held = np.concatenate((held, rc.decode_blocks(blocks, vocabulary)))
            yield (None if null else doc_id), first, held[:n]
            held = held[n:]
            first += n


def one_a_task(files: DataFrame) -> DataFrame:
    """The files in ranges of ``part``, one each; by a hash, some tasks had several."""
    return files.repartitionByRange(max(1, files.count()), "part")


def read_coded(files: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document in the files,
    ``start`` counted over all files."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = stored(files.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0))), "placed")
    spread = one_a_task(placed).select("file", "base")

    def run(batches):
        for b in batches:
            for name, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                cols: list[list] = [[], [], [], []]
                for doc_id, first, ids in read_coded_file(shared_fs(name)[0], name):
                    for c, v in zip(cols, (doc_id, base + first, len(ids), zlib.crc32(ids.tobytes()))):
                        c.append(v)
                    if len(cols[0]) >= 20_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols],
                                                         ["doc_id", "start", "n_tokens", "ids_crc32"])
                        cols = [[], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols],
                                                 ["doc_id", "start", "n_tokens", "ids_crc32"])

    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def end_of_document(path: str) -> int:
    """The first id that the tokenizer never gives."""
    return encoder(path).tok.get_vocab_size(with_added_tokens=True)


def write_flat(docs: DataFrame, tokenizer: str | None = None, folder: str | None = None) -> DataFrame:
    """Write flat files of 16-bit ids (32-bit for larger vocabularies), without
    any index, one per input split and in its order, so no text moves. One row
    per file, with the ``doc_ids`` it was written from; the end id is
    ``end_of_document``."""
    path, where = tokenizer or default_tokenizer(), folder or scratch_dir(docs.sparkSession, "flat-ids")

    def task(batches):
        out, doc_ids, n_ids = None, [], 0
        for b in batches:
            enc, end = encoder(path), end_of_document(path)
            kind = flat_type(end)
            if out is None:
                out = _File(where, f"part-{TaskContext.get().partitionId():05d}.flat")
            doc_ids += b.column(0).to_pylist()
            for text in b.column(1).to_pylist():
                ids = np.append(enc.encode(text), end).astype(kind)
                out.stream.write(ids.tobytes())
                n_ids += len(ids)
        if out is not None:
            row = _file_row(TaskContext.get().partitionId(), out.done(), len(doc_ids), n_ids)
            yield pa.RecordBatch.from_arrays([*row.columns, pa.array([doc_ids], pa.list_(pa.int64()))], [*row.schema.names, "doc_ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stored(rows.mapInArrow(task, FLAT_SCHEMA), "files")


def flat_type(end: int) -> np.dtype:
    return np.dtype("<u2") if end < 1 << 16 else np.dtype("<u4")


__all__ = ["write_coded", "read_coded", "read_coded_file", "write_flat", "end_of_document", "flat_type", "in_order", "list_files"]
