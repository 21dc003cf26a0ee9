"""BPE encoding and decoding through a table of distinct words.

1. Spark splits texts into words, as the byte-level pre-tokenizer does: added
   tokens are words of their own, the text between them is split by the
   pattern. No token crosses a word.
2. Distinct words are counted (summed per task before the shuffle), and each
   is encoded once, whatever the number of its occurrences.
3. Ids are joined back to the words' positions. The most frequent words, by
   whole powers of two of their counts and up to ``FREQUENT_BYTES``, are a table
   of the shared folder that every task joins its documents' words with in
   Arrow, so no hot word is shuffled or made a row. The occurrences of all other
   words meet their ids in a shuffle join and are written per input split; the
   last scan, which keeps the documents where they are, merges them in by
   position. Where all words are within the bound, that second way is empty and
   left out.
4. Decoding joins ids with the pieces of the vocabulary (a bounded table, sent
   to all tasks, batch by batch) and puts their bytes together by position.

The words of a document stay in order in its row; merged rows are checked by
position and the hash of their text, and the task raises where they don't
follow. ``docs`` should be files or a stored table: its splits are
listed twice. Null and empty texts have no ids; repeated rows are documents
each; ids may be null. An empty table gives no rows. Other columns are not
read.
"""

from __future__ import annotations

import functools
import hashlib
import json
import operator
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cashweave.llm.alignment import _byte_alphabet
from cashweave.llm.common import arrow_records, list_files, scratch_dir, shared_fs, stored

FREQUENT_BYTES = 40 << 20       # of the frequent words, ids and their row overhead
ROW_BYTES = 64
SLICE_WORDS = 500_000           # words that a task looks up at a time
ARROW_ROWS = 250                # documents in an Arrow batch

# Fixed value: the split of byte-level BPE, with Unicode's white space spelled
# out, which Java's \s is not. <L> and <N> stand for further letters and numbers.
# The commonest kinds stand first: no other kind can begin where they match.
_SPACE = r"\x{9}-\x{d}\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_WORDS = (r" ?[\p{L}<L>]++| ?[\p{N}<N>]++|'(?:s|t|re|ve|m|ll|d)| ?[^" + _SPACE + r"\p{L}\p{N}<L><N>]++"
          r"|[" + _SPACE + r"]+(?![^" + _SPACE + r"])|[" + _SPACE + r"]+")


@functools.lru_cache(maxsize=1)
def _newer_signs() -> tuple[str, str]:
    """Ranges of letters and of numbers by the library's own split, among signs
    that Unicode 3.2 had not assigned: Java may know fewer of them."""
    from tokenizers import pre_tokenizers

    split = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    signs = [chr(c) for c in range(0x34000) if not 0xD800 <= c < 0xE000 and unicodedata.ucd_3_2_0.category(chr(c)) == "Cn"]
    ranges = []
    for before in "a1":      # a letter stays together with letters, a number with numbers
        same = [ord(c) for c in signs if split.pre_tokenize_str(before + c)[0][1] == (0, 2)]
        text, first = "", None
        for k, c in enumerate(same):
            first = c if first is None else first
            if k + 1 == len(same) or same[k + 1] != c + 1:
                text += f"\\x{{{first:x}}}-\\x{{{c:x}}}"
                first = None
        ranges.append(text)
    return ranges[0], ranges[1]


def default_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def added_tokens(path: str) -> list[str]:
    """The file's added tokens; raises where it is no plain byte-level BPE."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    split, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
    if (spec.get("normalizer") or spec.get("post_processor") or split.get("type") != "ByteLevel" or not split.get("use_regex")
            or split.get("add_prefix_space") or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added)):
        raise ValueError(f"{path} is not a byte-level BPE without normalizer, prefix space and greedy added tokens")
    return [t["content"] for t in added]


def words_of(text, added: list[str]):
    """The words of a text in order; their concatenation is the text."""
    def split(part):
        plain, full = (F.regexp_extract_all(part, F.lit(_WORDS.replace("<L>", letters).replace("<N>", numbers)), F.lit(0))
                       for letters, numbers in (("", ""), _newer_signs()))
        known = (F.length(part) == F.octet_length(part)) | ~part.rlike(r"\p{Cn}")
        return F.when(known, plain).otherwise(full)

    if not added:
        return split(text)
    either = "|".join(re.escape(t).replace("\\<", "<").replace("\\>", ">") for t in sorted(added, key=len, reverse=True))
    between = F.split(text, f"(?={either})|(?<={either})")
    parts = F.transform(between, lambda s: F.when(s.isin(*added), F.array(s)).otherwise(split(s)))
    return F.when(functools.reduce(operator.or_, [text.contains(t) for t in added]), F.flatten(parts)).otherwise(split(text))


def _rows(docs: DataFrame) -> DataFrame:
    """``row`` numbers the rows of a split; the split's number stands above ``_ROW_BITS``."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .withColumn("row", F.monotonically_increasing_id())


_ROW_BITS = 33


def split_rows(rows: DataFrame, added: list[str]) -> DataFrame:
    """``doc_id, row, check, words``: documents with their words, in order, and
    a hash of their text."""
    return rows.select("doc_id", "row", F.xxhash64("text").alias("check"), words_of(F.col("text"), added).alias("words"))


def positions(rows: DataFrame, added: list[str]) -> DataFrame:
    """One row per word, in order; documents without words have one of null."""
    # The hash is taken once a document, below the generator, not once a word.
    return split_rows(rows, added).select("doc_id", "row", "check", F.posexplode_outer("words").alias("pos", "word"))


def word_table(docs: DataFrame, path: str) -> DataFrame:
    """``word, n, ids``: each distinct word once, with its occurrences and ids."""
    def run(batches):
        import os

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        for b in batches:
            found = [e.ids for e in tok.encode_batch(b.column(0).to_pylist(), add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.list_(pa.int32()))], ["word", "n", "ids"])

    words = docs.select(F.explode(words_of(F.col("text").cast("string"), added_tokens(path))).alias("word"))
    return stored(words.groupBy("word").agg(F.count("*").alias("n")).mapInArrow(run, "word string, n long, ids array<int>"), "words")


def frequent_words(table: DataFrame, max_bytes: int = FREQUENT_BYTES) -> tuple[DataFrame, int, int]:
    """The words whose count is at least the smallest power of two for which
    they fit ``max_bytes``; that count; how many words have fewer."""
    size = F.octet_length("word") + 4 * F.size("ids") + ROW_BYTES
    steps = table.groupBy((F.length(F.bin("n")) - 1).alias("power")).agg(F.sum(size).alias("bytes"), F.count("*").alias("words")).collect()
    least, total, rest = 1 << 62, 0, sum(s.words for s in steps)
    for step in sorted(steps, reverse=True):      # at most 63
        total += step.bytes
        if total > max_bytes:
            break
        least, rest = 1 << step.power, rest - step.words
    return table.filter(F.col("n") >= least), least, rest


def _rest_by_split(words: DataFrame, frequent: DataFrame, rest: DataFrame, folder: str) -> None:
    """Write the positions and ids of all words that are not frequent, one
    folder for each split of the documents."""
    seldom = words.filter(F.col("word").isNotNull()).join(F.broadcast(frequent.select("word")), "word", "left_anti")
    found = seldom.join(rest.select("word", "ids").hint("merge"), "word") \
        .select(F.shiftright("row", _ROW_BITS).alias("split"), "row", "pos", "check", "ids")
    found.repartition("split").sortWithinPartitions("split", "row", "pos").write.partitionBy("split").parquet(folder)


class _Split:
    """The rows that ``_rest_by_split`` wrote for this task's split, in order."""

    def __init__(self, folder: str | None):
        self.rows, self.at = None, 0
        if folder:
            names = list_files(f"{folder}/split={TaskContext.get().partitionId()}", ".parquet")
            if names:
                system = shared_fs(folder)[0]
                self.rows = pa.concat_tables([pq.read_table(n, filesystem=system, columns=["row", "pos", "check", "ids"], partitioning=None)
                                              for n in names]).sort_by([("row", "ascending"), ("pos", "ascending")]).combine_chunks()

    def fill(self, ids: pa.ListArray, b: pa.RecordBatch, ends: np.ndarray, n: np.ndarray) -> pa.ListArray:
        """The ids of the batch's words, of which each document has ``n`` up to
        ``ends``; holes are filled from the next rows of the split."""
        holes = np.flatnonzero(ids.is_null().to_numpy(zero_copy_only=False))
        if not len(holes):
            return ids
        doc = np.searchsorted(ends, holes, side="right")
        want = {"row": b.column("row").to_numpy()[doc], "pos": holes - (ends - n)[doc], "check": b.column("check").to_numpy()[doc]}
        part = self.rows.slice(self.at, len(holes)) if self.rows is not None else None
        self.at += len(holes)
        if part is None or part.num_rows < len(holes) or any(not np.array_equal(part.column(c).to_numpy(), v) for c, v in want.items()):
            raise ValueError("the documents are split in another way than before; store them first")
        take = np.arange(len(ids))
        take[holes] = len(ids) + np.arange(len(holes))
        return pa.concat_arrays([ids, part.column("ids").combine_chunks().cast(ids.type)]).take(pa.array(take))


_LOADED: dict[str, tuple[pa.Array, pa.Array]] = {}


def _frequent(folder: str) -> tuple[pa.Array, pa.Array]:
    """The process's copy of the frequent words and their ids (workers are reused)."""
    if folder not in _LOADED:
        _LOADED.clear()
        system = shared_fs(folder)[0]
        found = pa.concat_tables([pq.read_table(n, filesystem=system, columns=["word", "ids"], partitioning=None)
                                  for n in list_files(folder, ".parquet")])
        _LOADED[folder] = found["word"].combine_chunks(), found["ids"].combine_chunks()
    return _LOADED[folder]


def _looked_up(words: pa.Array, among: pa.Array) -> pa.Array:
    """Each word's place in ``among``, whose words are distinct, or null. The
    hash table is of the slice's distinct words, far fewer than ``among`` has."""
    coded = words.dictionary_encode()
    at = pc.index_in(among, value_set=coded.dictionary)
    held = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
    places = np.full(len(coded.dictionary), -1)
    places[at.drop_null().to_numpy()] = held
    places = pa.array(places, pa.int32(), mask=places < 0)
    return places.take(coded.indices)


def _encode(batches, frequent: tuple[pa.Array, pa.Array], split: _Split, words: int = SLICE_WORDS):
    """Batches ``doc_id, ids`` of documents ``doc_id, row, check, words``, of
    which about ``words`` words are looked up at a time."""
    for b in batches:
        total = np.cumsum(b.column("words").value_lengths().fill_null(0).to_numpy())
        first = 0
        while first < b.num_rows:
            last = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + words, side="right")))
            part, first = b.slice(first, last - first), last
            n = part.column("words").value_lengths().fill_null(0).to_numpy()
            ends = np.cumsum(n)
            ids = split.fill(frequent[1].take(_looked_up(part.column("words").flatten(), frequent[0])), part, ends, n)
            places = np.concatenate(([0], np.cumsum(ids.value_lengths().fill_null(0).to_numpy())))
            cuts = places[np.concatenate(([0], ends))].astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(cuts), ids.flatten())], ["doc_id", "ids"])


def encode(docs: DataFrame, path: str | None = None, max_bytes: int = FREQUENT_BYTES) -> DataFrame:
    """``doc_id, ids`` of every document: what ``encode(text,
    add_special_tokens=False)`` gives."""
    return _encoded(docs, path, max_bytes, lambda batches: batches, "doc_id long, ids array<int>")


def _encoded(docs: DataFrame, path: str | None, max_bytes: int, finish, schema: str) -> DataFrame:
    """``finish`` of the batches ``doc_id, ids`` of every document, in the task
    that makes them."""
    path = path or default_bpe()
    rows, added = _rows(docs), added_tokens(path)
    table = word_table(docs, path)
    frequent, least, rest = frequent_words(table, max_bytes)
    often = scratch_dir(docs.sparkSession, "frequent-words")
    frequent.select("word", "ids").repartition(4).write.parquet(often)      # all tasks list and read them
    folder = None
    if rest:
        folder = scratch_dir(docs.sparkSession, "word-ids")
        _rest_by_split(positions(rows, added), frequent, table.filter(F.col("n") < least), folder)

    def run(batches):
        yield from finish(_encode(batches, _frequent(often), _Split(folder)))
        pa.default_memory_pool().release_unused()      # the worker stays and would hold it

    return split_rows(rows, added).mapInArrow(run, schema)


def pieces(path: str) -> list[bytes]:
    """The bytes of each id's piece, by id: as many as the vocabulary has ids."""
    from tokenizers import Tokenizer

    alphabet, vocabulary = _byte_alphabet(), Tokenizer.from_file(path).get_vocab(with_added_tokens=True)
    out = [b""] * (max(vocabulary.values(), default=-1) + 1)
    for piece, k in vocabulary.items():
        out[k] = bytes(alphabet[c] for c in piece) if all(c in alphabet for c in piece) else piece.encode()
    return out


def _decoder(table: list[bytes]):
    """A function from a list array of ids to their texts."""
    joined = pa.array([*table, b""], pa.binary())

    def texts(ids: pa.ListArray) -> list[str]:
        flat = ids.flatten().to_numpy(zero_copy_only=False)
        found = joined.take(pa.array(np.where((flat >= 0) & (flat < len(table)), flat, len(table))))
        data = memoryview(found.buffers()[2] or b"")
        place = np.frombuffer(found.buffers()[1], np.int32)[found.offset:found.offset + len(found) + 1]
        ends = np.concatenate(([0], np.cumsum(ids.value_lengths().fill_null(0).to_numpy())))
        cuts = place[ends].tolist() if len(place) else [0] * len(ends)
        return [str(data[x:y], "utf-8", "replace") for x, y in zip(cuts, cuts[1:])]

    return texts


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, ids, text`` of rows ``doc_id, ids``: what ``decode(ids,
    skip_special_tokens=False)`` gives; bytes that are no UTF-8 become U+FFFD.
    Each batch's ids are joined with the pieces by id; ids outside of the
    vocabulary are skipped, null lists are empty."""
    table = pieces(path or default_bpe())

    def run(batches):
        texts = _decoder(table)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts(b.column(1)), pa.string())], ["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _digests(table: list[bytes]):
    """Digests of batches ``doc_id, ids``, whose pieces are ``table``."""
    def run(batches):
        texts, decimal = _decoder(table), [str(k).encode() for k in range(len(table))]
        for b in batches:
            n = b.column(1).value_lengths().fill_null(0).to_numpy()
            ends, flat = np.cumsum(n).tolist(), b.column(1).flatten().to_numpy(zero_copy_only=False)
            ids = [hashlib.sha256(b",".join([decimal[k] for k in flat[e - m:e].tolist()])).hexdigest() for e, m in zip(ends, n.tolist())]
            decoded = [hashlib.sha256(t.encode()).hexdigest() for t in texts(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded)],
                                             ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def digests(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of rows ``doc_id, ids``:
    digests of the decimal ids joined by commas and of the decoded text."""
    return encoded.select("doc_id", "ids").mapInArrow(_digests(pieces(path or default_bpe())), DIGESTS)


def encoded_digests(docs: DataFrame, path: str | None = None, max_bytes: int = FREQUENT_BYTES) -> DataFrame:
    """``digests`` of what ``encode`` gives, a few hundred documents at a time
    in the task that encodes them: their ids are not handed to the JVM and back."""
    return _encoded(docs, path, max_bytes, _digests(pieces(path or default_bpe())), DIGESTS)


def stored_digests(docs: DataFrame, path: str | None = None, max_bytes: int = FREQUENT_BYTES) -> DataFrame:
    """``encoded_digests``, stored: its tasks are handed ``ARROW_ROWS`` documents
    with their words at a time, where a default batch is a whole input split."""
    found = encoded_digests(docs, path, max_bytes)      # the word table has batches of its own
    with arrow_records(docs.sparkSession, ARROW_ROWS):
        return stored(found, "digests")
