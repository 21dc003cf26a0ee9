"""WARC archives of pages, and their index by external merge.

Every page becomes a WARC record, one gzip member each: a response with the
page as payload, or, if another page of smaller ``page_id`` has the same
payload, a revisit that refers to it and leaves the payload out. The archive's
tasks leave one run of captures each, sorted by URL key and time. The runs are
cut at common keys, and each range is merged from the runs by a loser tree,
which gives the captures of every URL in the order of time.

Nulls and ties: a null html is an empty payload. Of equal payloads, the rows
with the smallest ``page_id`` are responses (all of them, if rows are
repeated); rows without an id revisit if a row with an id has their payload,
else they are responses. A null url has the empty key. Captures of one URL and
time are in the order of ``page_id``, those without one first.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from datetime import datetime, timedelta, timezone

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cashweave.llm.common import scratch_dir, shared_fs, shuffle_partitions, stored
from cashweave.llm.token_files import _File

MIN_BYTES = 0                # payloads from this size on can be revisited
FIRST_CAPTURE = datetime(2000, 1, 1, tzinfo=timezone.utc)
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")       # that of RFC 4122 for URLs
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURES = "url_key string, captured long, page_id long, file string, offset long, length long"


def url_key(url: str | None) -> str:
    """Sort-friendly form: host reversed, without scheme, ``www`` and fragment."""
    m = re.match(r"(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#]*)([^?#]*)(\?[^#]*)?", url or "")
    if not m:
        return (url or "").lower()
    host = m[1].lower().removeprefix("www.").split(":")[0]
    query = "&".join(sorted(m[3][1:].split("&"))) if m[3] else ""
    return ",".join(reversed(host.split("."))) + ")" + (m[2] or "/") + ("?" + query if query else "")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'page:{page_id}')}>"


def record(page_id, url: str | None, payload: bytes, refers_to, captured: int) -> bytes:
    """One uncompressed WARC record."""
    digest = base32_sha1(payload)
    date = (FIRST_CAPTURE + timedelta(seconds=captured)).strftime("%Y-%m-%dT%H:%M:%SZ")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    target = re.sub(r"[\r\n]+", " ", url or "")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}",
             f"WARC-Date: {date}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}",
             "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Headers (by lower-case name) of a record, and ``payload``."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("no WARC record")
    out = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines)}
    block = rest[:int(out["content-length"])]
    if len(block) != int(out["content-length"]) or rest[len(block):] != b"\r\n\r\n":
        raise ValueError("a WARC record of another length than it says")
    http, _, payload = block.partition(b"\r\n\r\n")
    out["full_length"] = re.search(rb"Content-Length: (\d+)", http)[1].decode()
    out["payload"] = payload
    return out


def with_first(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """``page_id, url, payload, refers_to``; a payload's copies are counted by
    digest before pages meet them, so many copies are no hot group."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url",
                        F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    keyed = rows.withColumn("digest", F.sha1("payload")).withColumn("bytes", F.length("payload"))
    first = stored(keyed.groupBy(F.col("digest").alias("first_digest"), F.col("bytes").alias("first_bytes"))
                   .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies")).filter("copies > 1"), "first-captures")
    joined = keyed.join(first, (F.col("digest") == F.col("first_digest")) & (F.col("bytes") == F.col("first_bytes")), "left")
    revisits = (F.col("bytes") >= min_bytes) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "payload", F.when(revisits, F.col("first")).alias("refers_to"))


def write_archive(pages: DataFrame, folder: str | None = None, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write one archive file per task; returns its captures (``CAPTURES``),
    stored as one sorted run per task."""
    where = folder or scratch_dir(pages.sparkSession, "warc")

    def task(batches):
        out, captures, at = None, [], 0
        for b in batches:
            if out is None:
                out = _File(where, f"part-{TaskContext.get().partitionId():05d}.warc.gz")
            for page_id, url, payload, refers_to in zip(*(c.to_pylist() for c in b.columns)):
                captured = (page_id or 0) % (1 << 32)
                packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                member = packer.compress(record(page_id, url, payload, refers_to, captured)) + packer.flush()
                out.stream.write(member)
                captures.append((url_key(url), captured, page_id, out.name, at, len(member)))
                at += len(member)
        if out is None:
            return
        out.done()
        captures.sort(key=capture_order)
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        names = ["url_key", "captured", "page_id", "file", "offset", "length"]
        for k in range(0, len(captures), 10_000):
            cols = zip(*captures[k:k + 10_000])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)

    return stored(with_first(pages, min_bytes).mapInArrow(task, CAPTURES), "capture-runs")


def capture_order(c):
    """Sort key of a capture (url_key, captured, page_id, file, offset, ...)."""
    return c[0].encode("utf-8", "surrogatepass"), c[1], c[2] is not None, c[2] or 0, c[3], c[4]


class LoserTree:
    """Merges sorted sequences: each inner node keeps the loser of its match,
    so the next winner costs one comparison per level."""

    def __init__(self, runs, key):
        self.runs, self.key = [iter(r) for r in runs], key
        self.k = len(self.runs)
        self.heads = [self._next(i) for i in range(self.k)]
        self.losers = [-1] * self.k
        self.winner = self._build(1) if self.k else -1

    def _next(self, i):
        row = next(self.runs[i], None)
        return None if row is None else (self.key(row), row)

    def _beats(self, a, b):
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and (x[0], a) < (y[0], b))

    def _build(self, node):
        if node >= self.k:
            return node - self.k
        a, b = self._build(2 * node), self._build(2 * node + 1)
        win, lose = (a, b) if self._beats(a, b) else (b, a)
        self.losers[node] = lose
        return win

    def __iter__(self):
        while self.k and self.heads[self.winner] is not None:
            w = self.winner
            yield self.heads[w][1]
            self.heads[w] = self._next(w)
            node = (w + self.k) // 2
            while node:
                if self._beats(self.losers[node], w):
                    self.losers[node], w = w, self.losers[node]
                node //= 2
            self.winner = w


def merge_index(captures: DataFrame) -> DataFrame:
    """All captures in global order: ``CAPTURES`` and ``capture_no`` (from 1
    within a URL key), stored in ranges that follow each other. The ranges are
    cut by key, time and place, so a URL with very many captures is cut too."""
    parts = shuffle_partitions(captures.sparkSession)
    key = ["url_key", "captured", "page_id", "file", "offset"]
    ranged = captures.repartitionByRange(parts, *key).sortWithinPartitions("file", *key[:3], "offset")

    def merge(batches):
        runs: dict[str, list] = {}
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                runs.setdefault(row[3], []).append(row)
        part, held = TaskContext.get().partitionId(), []
        for n, row in enumerate(LoserTree(runs.values(), capture_order)):
            held.append((part, n, *row))
            if len(held) == 10_000:
                yield _rows(held)
                held = []
        if held:
            yield _rows(held)

    def _rows(rows):
        kinds = [pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        names = ["part", "place", "url_key", "captured", "page_id", "file", "offset", "length"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    merged = stored(ranged.select("url_key", "captured", "page_id", "file", "offset", "length")
                    .mapInArrow(merge, "part int, place long, " + CAPTURES), "merged-captures")
    here = merged.groupBy("url_key", "part").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("url_key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = here.select("url_key", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return merged.join(offsets, ["url_key", "part"]).withColumn("capture_no", F.col("place") + F.col("shift") + 1)


def read_archive(captures: DataFrame) -> DataFrame:
    """Read all records of the archive's files back: ``page_id, payload_bytes,
    payload_digest, record_type, refers_to, file, offset``."""
    files = stored(captures.select("file").distinct(), "archive-files")
    spread = files.repartition(max(1, min(files.count(), 10_000)), "file")

    def run(batches):
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "file", "offset"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        for b in batches:
            for name in b.column(0).to_pylist():
                rows = []
                for offset, data in members(shared_fs(name)[0], name):
                    r = parse(data)
                    digest = r["warc-payload-digest"].removeprefix("sha1:")
                    if r["warc-type"] == "response" and base32_sha1(r["payload"]) != digest:
                        raise ValueError(f"{name} at {offset}: the payload doesn't match its digest")
                    rows.append((_int(r.get("x-page-id")), int(r["full_length"]), digest, r["warc-type"],
                                 _int(r.get("x-refers-to-page-id")), name, offset))
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    return spread.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, "
                                  "refers_to long, file string, offset long")


def _int(text):
    return None if text is None else int(text)


def members(fs, name: str, chunk: int = 1 << 20):
    """(offset, content) of each gzip member of a file."""
    with fs.open_input_stream(name, compression=None) as f:
        data, offset = f.read(chunk), 0
        while data:
            unpack, out, used = zlib.decompressobj(31), [], 0
            while True:
                out.append(unpack.decompress(data))
                used += len(data) - len(unpack.unused_data)
                if unpack.eof:
                    data = unpack.unused_data or f.read(chunk)
                    break
                data = f.read(chunk)
                if not data:
                    raise ValueError(f"{name} ends within a record")
            yield offset, b"".join(out)
            offset += used


def archive(pages: DataFrame, folder: str | None = None, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write the archive, merge its index, read it back: one row per page, with
    the place of the record and its number among the captures of its URL."""
    captures = write_archive(pages, folder, min_bytes)
    index = merge_index(captures).select(F.col("file").alias("f"), F.col("offset").alias("o"), "url_key", "captured", "capture_no")
    return read_archive(captures).join(index, (F.col("file") == F.col("f")) & (F.col("offset") == F.col("o"))).drop("f", "o")
