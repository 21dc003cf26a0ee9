"""Whole-text token ids by a ``tokenizers`` file, with a bounded word cache.

``Encoder.encode`` returns what ``Tokenizer.encode(text,
add_special_tokens=False).ids`` returns. Most of the library's time on prose
goes into normalising and splitting words it has met before, so for the
common pipeline (NFC, white space to one space, lower case, split by a
letters/digit/other pattern, byte-level alphabet, BPE) the text is cut at
blanks and line feeds, which no token crosses, and each cut is encoded once
and remembered. Words of other characters than ASCII and Latin-1 letters go
through the library as they are; so does any text that holds the spelling of
an added token, and any text under a tokenizer of another pipeline.

``encode_rows`` does so for a column of texts: Arrow finds the distinct words of
some megabytes of text, all of them are cut into pieces at once, and the ids of
every word are copied to where it stands.
"""

from __future__ import annotations

import json
import re
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHE_WORDS = 300_000      # entries; the cache starts anew beyond this
CACHE_WORD_CHARS = 40      # longer words are encoded without being remembered
ROWS_BYTES = 12_000_000     # texts whose distinct words are found together

# The pipeline under which cutting at blanks is safe.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PLAIN = re.compile(r"[\x21-\x7eÀ-ÖØ-öø-ÿ]+")
_LETTER = r"a-zß-öø-ÿ"
_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[0-9]|[^0-9{_LETTER}]+")
_PLAIN_LINES = re.compile(r"[\x21-\x7eÀ-ÖØ-öø-ÿ\n]*")
_PIECES_OF_LINES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[0-9]|\n|[^0-9{_LETTER}\n]+")


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [t["content"] for t in spec.get("added_tokens") or []]
        self.dtype = np.dtype("<u2") if self.tok.get_vocab_size(with_added_tokens=True) <= 1 << 16 else np.dtype("<u4")
        norm = [(n["type"], n.get("pattern"), n.get("content"))
                for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.by_word = (
            norm == [("NFC", None, None), ("Replace", {"Regex": r"\s+"}, " "), ("Lowercase", None, None)]
            and [p["type"] for p in pre] == ["Split", "ByteLevel"]
            and pre[0]["pattern"] == {"Regex": _SPLIT} and pre[0]["invert"] and pre[0]["behavior"] == "Removed"
            and not pre[1]["add_prefix_space"] and not pre[1]["use_regex"]
            and not spec.get("post_processor"))
        alphabet = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        chars = [chr(c) for c in [*range(0x21, 0x7F), *range(0xC0, 0x100)]]
        self.bytes_of = {ord(c): alphabet.pre_tokenize_str(c)[0][0] for c in chars} if self.by_word else {}
        self.mark = np.iinfo(self.dtype).max        # ends a word's ids; no id where words are cut
        self.by_word_rows = self.by_word and self.tok.get_vocab_size(with_added_tokens=True) <= self.mark
        self.model = self.tok.model
        self.words: dict[str, bytes] = {"": b""}
        self.pieces: dict[str, bytes] = {}
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _library(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _spelled(self, piece: str) -> bytes:
        spelled = piece if piece.isascii() else piece.translate(self.bytes_of)     # ASCII stands for itself
        ids = [t.id for t in self.model.tokenize(spelled)]
        return struct.pack(f"<{len(ids)}{self.dtype.char}", *ids)

    def _piece(self, piece: str) -> bytes:
        out = self._spelled(piece)
        if len(piece) <= CACHE_WORD_CHARS:
            if len(self.pieces) >= CACHE_WORDS:
                self.pieces.clear()
            self.pieces[piece] = out
        return out

    def _recent(self, piece: str) -> bytes:
        """The same for ``encode_rows``; pieces met of late outlast the others."""
        out = self.recent.get(piece) or self.older.get(piece) or self._spelled(piece)
        if len(piece) <= CACHE_WORD_CHARS:
            if len(self.recent) >= CACHE_WORDS:
                self.older, self.recent = self.recent, {}
            self.recent[piece] = out
        return out

    def _word(self, word: str) -> bytes:
        if _PLAIN.fullmatch(word):
            known = self.pieces.get
            out = b"".join([known(p) or self._piece(p) for p in _PIECES.findall(word.lower())])
        else:
            out = self._library(word)
        if len(word) <= CACHE_WORD_CHARS:
            self.words[word] = out
        return out

    def encode_bytes(self, text: str | None) -> bytes:
        """Ids as little-endian ``self.dtype`` integers; null and empty: none."""
        if not text:
            return b""
        if not self.by_word or any(a in text for a in self.added):
            return self._library(text)
        if len(self.words) >= CACHE_WORDS:
            self.words = {"": b""}
        known, words = self.words.get, text.replace("\n", " ").split(" ")
        out = list(map(known, words))
        if None in out:
            out = [(known(w) or self._word(w)) if ids is None else ids for w, ids in zip(words, out)]
        return b"".join(out)

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.encode_bytes(text), self.dtype)

    def encode_rows(self, texts: pa.Array):
        """Yields (the texts' ids one after another, how many each has) of
        slices of the column."""
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy())
        a = 0
        while a < len(texts):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + ROWS_BYTES, side="right")))
            yield self._rows(texts[a:b].cast(pa.large_string()))
            a = b

    def _rows(self, texts: pa.Array):
        if not self.by_word_rows or any(pc.any(pc.match_substring(texts, t)).as_py() for t in self.added):
            rows = [self.encode(t) for t in texts.to_pylist()]
            return np.concatenate(rows), np.array([len(r) for r in rows], np.int64)
        words = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = words.flatten().dictionary_encode()
        ids, first, count = self._words(coded.dictionary)
        which = coded.indices.to_numpy()
        counts = count.take(which)
        before = np.zeros(len(which) + 1, np.int64)
        np.cumsum(counts, out=before[1:])
        place = np.repeat(first.take(which) - before[:-1], counts)
        place += np.arange(len(place))
        of_row = before.take(np.cumsum(pc.fill_null(pc.list_value_length(words), 0).to_numpy()))
        return ids.take(place), np.diff(of_row, prepend=0)

    def _words(self, words: pa.Array):
        """Ids of the words, and where each word's begin and how many they are."""
        if not len(words):
            return np.zeros(0, self.dtype), np.zeros(0, np.int64), np.zeros(0, np.int64)
        lines, others = pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words), pa.scalar("\n", words.type))[0].as_py() + "\n", []
        if not _PLAIN_LINES.fullmatch(lines):
            plain = lines.split("\n")
            others = [(k, w) for k, w in enumerate(plain) if w and not _PLAIN.fullmatch(w)]
            for k, _ in others:
                plain[k] = ""
            lines = "\n".join(plain)
        self.recent["\n"] = np.array(self.mark, self.dtype).tobytes()
        pieces = _PIECES_OF_LINES.findall(lines.lower())
        out = list(map(self.recent.get, pieces))
        if None in out:
            out = [self._recent(p) if ids is None else ids for p, ids in zip(pieces, out)]
        ids = np.frombuffer(b"".join(out), self.dtype)
        ends = np.flatnonzero(ids == self.mark)
        first = np.concatenate(([0], ends + 1))[:len(words)]
        count = ends - first
        if others:
            more = [np.frombuffer(self._library(w), self.dtype) for _, w in others]
            at = [k for k, _ in others]
            count[at] = [len(m) for m in more]
            first[at] = len(ids) + np.cumsum(count[at]) - count[at]
            ids = np.concatenate((ids, *more))
        return ids, first, count


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The process's encoder for a tokenizer file (workers are reused)."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
