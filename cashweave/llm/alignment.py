"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes.

Side A is a byte-level ``tokenizers`` file on space + text, side B a
``sentencepiece`` model on the text (to which it adds the space). Per batch
of documents both sides become frames of token starts, keyed by document. A
pandas ``merge_asof`` on the start, within the document, gives each token of
one side the covering token of the other; the union of both directions is all
overlapping pairs. Overlapping pairs with equal ends are links, and the ends
they share cut a document into groups.

How often an id pair is linked in the whole corpus is summed per batch, then
over batches. Linked tokens end together, so one's bytes end in the other's:
for each token there is at most one pair per suffix of it and spelling of that
suffix, and the table of pairs is bounded by the two vocabularies' bytes
(``pair_bound``), whatever the corpus. It is sent to all tasks.

Side B encodes whole texts. Side A remembers words: ASCII and Latin-1 text is
split by the byte-level pattern, which no token crosses; other text is cut
before single spaces between two such signs, and the library encodes the rest.

Null and empty texts, and texts that either side does not give back byte by
byte, have no tokens: all counts are 0 and the digest is empty. Repeated rows
are documents each and count each; ids may be null. An empty table gives no
rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cashweave.llm.common import arrow_records, stored

ARROW_ROWS = 500           # documents handed to Python at a time, with some 8 bytes of links for each token
BATCH_CHARS = 500_000      # characters of text per frame; a longer text is a frame of its own
CACHE_WORDS = 150_000      # entries of each of the cache's two generations; the older one goes when the newer is full
CACHE_WORD_CHARS = 40      # longer words are encoded without being remembered

# The split of byte-level BPE on ASCII and Latin-1 letters.
_LETTERS, _SPACES = "A-Za-zÀ-ÖØ-öø-ÿ", r"\t-\r "
_KNOWN = re.compile(f"[\\x00-\\x7e{_LETTERS}]+")
_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^{_SPACES}{_LETTERS}0-9]+"
                    f"|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+")
_SIGN = "[!-~À-ÖØ-öø-ÿ]"
_CUT = re.compile(f"(?<={_SIGN})(?= {_SIGN})")

ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links array<long>"


def _byte_alphabet() -> dict[str, int]:
    """The sign that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(256 + k): b for k, b in enumerate(other)}}


class Sides:
    """Both tokenizers, the bytes of their pieces, and the chunks met before."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        alphabet = _byte_alphabet()
        self.bytes_a = [b""] * self.a.get_vocab_size(with_added_tokens=True)
        for piece, k in self.a.get_vocab(with_added_tokens=True).items():
            self.bytes_a[k] = bytes(alphabet[c] for c in piece) if all(c in alphabet for c in piece) else piece.encode()
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode()
                        for k, p in enumerate(pieces)]
        self.len_a, self.len_b = (np.array([len(x) for x in side], np.int64) for side in (self.bytes_a, self.bytes_b))
        # Texts of the ids with what follows them in a digest: "," within a group, "|" or ";" at its end.
        self.text_a, self.text_b = ([f"{k}{sep}".encode() for k in range(len(side)) for sep in (",", end)]
                                    for side, end in ((self.bytes_a, "|"), (self.bytes_b, ";")))
        with open(path_a, encoding="utf-8") as f:
            spec = json.load(f)
        split = spec.get("pre_tokenizer") or {}
        self.by_word = (not spec.get("normalizer") and split.get("type") == "ByteLevel" and split.get("use_regex")
                        and not split.get("add_prefix_space"))
        self.model = self.a.model
        signs = {b: c for c, b in alphabet.items()}
        self.spelt = {c: "".join(signs[b] for b in chr(c).encode()) for c in range(256)}
        self.known: dict[str, bytes | None] = {}
        self.older: dict[str, bytes | None] = {}

    def _library_a(self, text: str) -> bytes | None:
        """Ids of side A, None if their bytes are not the text's."""
        return self._checked(self.a.encode(text, add_special_tokens=False).ids, text)

    def _checked(self, ids: list[int], text: str) -> bytes | None:
        same = b"".join([self.bytes_a[k] for k in ids]) == text.encode("utf-8", "surrogatepass")
        return np.array(ids, "<i4").tobytes() if same else None

    def _word(self, word: str) -> bytes | None:
        if word in self.older:
            ids = self.older[word]
        elif _KNOWN.fullmatch(word):      # one word of the pattern: no further split
            ids = self._checked([t.id for t in self.model.tokenize(word.translate(self.spelt))], word)
        else:
            ids = self._library_a(word)
        if len(word) <= CACHE_WORD_CHARS:
            if len(self.known) >= CACHE_WORDS:
                self.known, self.older = {}, self.known
            self.known[word] = ids
        return ids

    def _side_a(self, text: str) -> bytes | None:
        if not self.by_word:
            return self._library_a(text)
        words = _WORDS.findall(text) if _KNOWN.fullmatch(text) else [
            w for c in _CUT.split(text) for w in (_WORDS.findall(c) if _KNOWN.fullmatch(c) else [c])]
        known = self.known.get
        got = [known(w) or self._word(w) for w in words]
        return None if None in got else b"".join(got)

    def encode(self, text: str | None) -> tuple[bytes, bytes]:
        """Ids of both sides as little-endian 32-bit integers; none if either
        side's bytes differ from space + text."""
        if not text:
            return b"", b""
        b = self.b.encode(text, num_threads=1)
        if b"".join([self.bytes_b[k] for k in b]) != (" " + text).encode("utf-8", "surrogatepass"):
            return b"", b""
        a = self._side_a(" " + text)
        return (a, np.array(b, "<i4").tobytes()) if a else (b"", b"")


_SIDES: dict[tuple[str, str], Sides] = {}


def sides(path_a: str, path_b: str) -> Sides:
    """The process's pair of tokenizers (workers are reused)."""
    if (path_a, path_b) not in _SIDES:
        _SIDES[path_a, path_b] = Sides(path_a, path_b)
    return _SIDES[path_a, path_b]


def pair_bound(path_a: str, path_b: str) -> int:
    """More id pairs than this can't be linked: each is a token and a suffix of
    it, and a suffix has at most two spellings (a piece and a single byte's)."""
    s = sides(path_a, path_b)
    return 2 * int(s.len_a.sum() + s.len_b.sum())


class Aligned:
    """The tokens of a batch of documents: ids, documents, byte ranges, overlaps."""

    def __init__(self, texts: list[str | None], pair: Sides):
        got = [pair.encode(t) for t in texts]
        self.n_docs = len(texts)
        self.n = [np.array([len(g[k]) // 4 for g in got], np.int64) for k in (0, 1)]
        self.ids = [np.frombuffer(b"".join(g[k] for g in got), "<i4") for k in (0, 1)]
        self.doc = [np.repeat(np.arange(self.n_docs), n) for n in self.n]
        lengths = [pair.len_a[self.ids[0]], pair.len_b[self.ids[1]]]
        # Documents lie one behind the other, so starts are sorted over the batch.
        self.end = [np.cumsum(x) for x in lengths]
        self.start = [e - x for e, x in zip(self.end, lengths)]

    def covering(self, side: int) -> np.ndarray:
        """For each token of ``side``, the other side's token that covers its start."""
        here, there = (pd.DataFrame({"doc": self.doc[k], "start": self.start[k]}) for k in (side, 1 - side))
        there["token"] = np.arange(len(there))
        return pd.merge_asof(here, there, on="start", by="doc")["token"].to_numpy()

    def overlaps(self) -> tuple[np.ndarray, np.ndarray]:
        """All overlapping (A token, B token) pairs, each once, in order."""
        if not len(self.ids[0]):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        of_a, of_b = self.covering(0), self.covering(1)
        a, b = np.arange(len(of_a)), np.arange(len(of_b))
        new = self.start[0][of_b] != self.start[1]       # equal starts are in the other direction's pairs
        a, b = np.concatenate((a, of_b[new])), np.concatenate((of_a, b[new]))
        order = np.lexsort((b, a))
        return a[order], b[order]

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """The overlapping pairs with equal ends, in order."""
        a, b = self.overlaps()
        same = self.end[0][a] == self.end[1][b]
        return a[same], b[same]


def group_digests(batch: Aligned, a: np.ndarray, b: np.ndarray, pair: Sides) -> list[str]:
    """SHA-256 of each document's groups as text; empty without tokens."""
    n_a, n_b = len(batch.ids[0]), len(batch.ids[1])
    last_a, last_b = np.zeros(n_a, np.int64), np.zeros(n_b, np.int64)
    last_a[a], last_b[b] = 1, 1
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    ends_a, ends_b = np.concatenate(([0], a + 1)), np.concatenate(([0], b + 1))
    # A group is its A tokens, then its B tokens.
    line = np.empty(n_a + n_b, np.int64)
    line[np.arange(n_a) + ends_b[group_a]] = batch.ids[0] * 2 + last_a
    line[np.arange(n_b) + ends_a[group_b + 1]] = batch.ids[1] * 2 + last_b + len(pair.text_a)
    texts = pair.text_a + pair.text_b
    out, at = [], 0
    for size in (batch.n[0] + batch.n[1]).tolist():
        text = b"".join([texts[k] for k in line[at:at + size].tolist()])
        out.append(hashlib.sha256(text[:-1]).hexdigest() if size else "")
        at += size
    return out


def _frames(texts: list[str | None]):
    """Ranges of documents of about ``BATCH_CHARS`` characters together."""
    first, chars = 0, 0
    for k, t in enumerate(texts):
        chars += len(t or "")
        if chars >= BATCH_CHARS:
            yield first, k + 1
            first, chars = k + 1, 0
    if first < len(texts):
        yield first, len(texts)


def _lists(n: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), pa.array(values))


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Per document: numbers of tokens, groups and links, the digest of the
    groups, and ``links``, the linked id pairs in order as A id * B's
    vocabulary + B id."""

    def run(batches):
        pair = sides(path_a, path_b)
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            for first, end in _frames(texts):
                batch = Aligned(texts[first:end], pair)
                la, lb = batch.links()
                n_links = np.bincount(batch.doc[0][la], minlength=end - first)
                codes = batch.ids[0][la].astype(np.int64) * len(pair.bytes_b) + batch.ids[1][lb]
                yield pa.RecordBatch.from_arrays(
                    [ids[first:end], pa.array(batch.n[0]), pa.array(batch.n[1]), pa.array(n_links), pa.array(n_links),
                     pa.array(group_digests(batch, la, lb, pair)), _lists(n_links, codes)],
                    ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .mapInArrow(run, ALIGNED)


def overlapping(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row per overlapping pair of tokens: ``doc_id, a_pos, b_pos, a_id,
    b_id, same_end``, positions from 0 in the document."""

    def run(batches):
        pair = sides(path_a, path_b)
        for rows in batches:
            ids, texts = rows.column(0), rows.column(1).to_pylist()
            for first, end in _frames(texts):
                batch = Aligned(texts[first:end], pair)
                a, b = batch.overlaps()
                doc = batch.doc[0][a]
                base = [np.concatenate(([0], np.cumsum(n)))[doc] for n in batch.n]
                yield pa.RecordBatch.from_arrays(
                    [ids[first:end].take(pa.array(doc)), pa.array(a - base[0]), pa.array(b - base[1]), pa.array(batch.ids[0][a]),
                     pa.array(batch.ids[1][b]), pa.array(batch.end[0][a] == batch.end[1][b])],
                    ["doc_id", "a_pos", "b_pos", "a_id", "b_id", "same_end"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .mapInArrow(run, "doc_id long, a_pos long, b_pos long, a_id int, b_id int, same_end boolean")


def pair_counts(aligned: DataFrame, vocabulary_b: int) -> DataFrame:
    """``pair, n, best``: how many links hold an id pair, and whether that is
    the most for its B id."""

    def run(batches):
        for b in batches:
            pairs, n = np.unique(b.column(0).flatten().to_numpy(), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n.astype(np.int64))], ["pair", "n"])

    counted = aligned.select("links").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    most = F.max("n").over(Window.partitionBy(F.col("pair") % vocabulary_b))
    return counted.withColumn("best", F.col("n") == most)


def link_statistics(aligned: DataFrame, pairs: DataFrame, bound: int) -> DataFrame:
    """Adds ``n_best`` and ``count_sum``; ``pairs`` has at most ``bound`` rows."""
    table = pairs.orderBy("pair").toArrow()
    if table.num_rows > bound:
        raise ValueError(f"{table.num_rows} id pairs are more than the vocabularies can link ({bound})")
    keys, n, best = (table.column(k).to_numpy() for k in ("pair", "n", "best"))
    shared = aligned.sparkSession.sparkContext.broadcast((keys, n, best.astype(np.int64)))
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]

    def run(batches):
        keys, n, best = shared.value
        for b in batches:
            at = np.searchsorted(keys, b.column("links").flatten().to_numpy())
            ends = np.concatenate(([0], np.cumsum(b.column("n_links").to_numpy())))
            found = []
            for values in (best, n):
                sums = np.concatenate(([0], np.cumsum(values[at])))
                found.append(pa.array(sums[ends[1:]] - sums[ends[:-1]]))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), *found, b.column("groups_sha256")],
                                             [*columns, "n_best", "count_sum", "groups_sha256"])

    return aligned.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, "
                                   "count_sum long, groups_sha256 string")


def alignment(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """Alignment of every document with the statistics of its links."""
    import public_tokenizers

    path_a = path_a or public_tokenizers.path("byte_bpe_50k.json")
    path_b = path_b or public_tokenizers.path("piece_bpe_32k.model")
    with arrow_records(docs.sparkSession, ARROW_ROWS):
        aligned = stored(align(docs, path_a, path_b), "aligned")
        pairs = stored(pair_counts(aligned, len(sides(path_a, path_b).bytes_b)), "pairs")
        return stored(link_statistics(aligned, pairs, pair_bound(path_a, path_b)), "alignment")
