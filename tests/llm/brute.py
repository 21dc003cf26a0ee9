"""Plain single-process versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

import xxhash

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(ASCII))


def contamination(docs, items, window=13):
    """{doc_id: (n_words, n_hit, n_items, sha, contaminated)}"""
    grams = defaultdict(set)
    for item, text in items:
        w = words(text)
        k = min(window, len(w))
        for s in range(len(w) - k + 1 if w else 0):
            grams[tuple(w[s:s + k])].add("" if item is None else str(item))
    sizes = {len(g) for g in grams}
    out = {}
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for k in sizes:
            for s in range(len(w) - k + 1):
                ids = grams.get(tuple(w[s:s + k]))
                if ids:
                    hit.update(range(s, s + k))
                    found |= ids
        ids = ",".join(sorted(found))
        out[doc_id] = (len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(),
                       bool(hit) and 20 * len(hit) >= len(w))
    return out


def fingerprint(text):
    w = (text or "").translate(ASCII)
    w = re.findall(r"[^\x20\x09-\x0D]+", w)
    if not w:
        return 0
    shingles = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(prints, bits=2):
    """{doc_id: least doc_id reachable} from {doc_id: fingerprint}."""
    ids = sorted(prints)
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    by = defaultdict(list)
    for i in ids:
        by[prints[i]].append(i)
    fps = list(by)
    for same in by.values():
        for i in same[1:]:
            a, b = find(same[0]), find(i)
            parent[max(a, b)] = min(a, b)
    for x in range(len(fps)):
        for y in range(x):
            if (fps[x] ^ fps[y]).bit_count() <= bits:
                a, b = find(by[fps[x]][0]), find(by[fps[y]][0])
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def drop_lines(docs, min_chars=20, min_docs=3):
    """{doc_id: (n_lines, n_dropped, kept text)}"""
    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate(ASCII)

    held = defaultdict(set)
    for doc_id, text in docs:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                held[key(line)].add(doc_id)
    out = {}
    for doc_id, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < min_chars or len(held[key(x)]) < min_docs or max(held[key(x)]) == doc_id]
        out[doc_id] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def top_k(vectors, k=10):
    """{query: [(vec_id, score)]} for {vec_id: list of float} and queries 0 mod 100."""
    import numpy as np

    ids = sorted(vectors)
    v = np.array([[int(np.floor(1024 * float(x))) for x in vectors[i]] for i in ids], np.int64)
    out = {}
    for row, q in zip(v, ids):
        if q % 100 == 0:
            scores = (v @ row).tolist()
            out[q] = sorted(((i, s) for i, s in zip(ids, scores) if i != q), key=lambda x: (-x[1], x[0]))[:k]
    return out


def warc_rows(pages):
    """{page_id: (bytes, digest, type, refers_to)} from (page_id, html)."""
    import base64

    first = {}
    for page_id, html in sorted(pages):
        first.setdefault((html or "").encode(), page_id)
    out = {}
    for page_id, html in pages:
        p = (html or "").encode()
        out[page_id] = (len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(),
                        *(("response", None) if first[p] == page_id else ("revisit", first[p])))
    return out
