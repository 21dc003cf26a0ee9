"""SimHash near-duplicates by pigeonring filtering.

Fingerprints of 64 bits are cut into a ring of ``SEGMENTS`` segments. If two
of them differ in at most ``d`` bits, then some chain of consecutive segments
exists whose first ``l`` segments together differ in at most ``l * d /
SEGMENTS`` bits, for every ``l``. While that budget is below one, the segments
must be equal: they are the join key, one for each place where a chain can
begin. The longer chains then prune the candidates, the last is the full
Hamming check.

Equal fingerprints are one node from the start. A key that more than
``PAIR_LIMIT`` distinct fingerprints share is not paired: each of its
fingerprints meets its neighbours at values one bit away (two fingerprints
differ in at most two bits exactly if they share such a value), which costs
as many rows as free bits instead of the square of the group.

Nulls and ties: null and empty texts have the fingerprint zero and are linked
like others; rows without a ``doc_id`` take part but never name a group, whose
id is null if no member has one; equal rows are exact copies.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cashweave.llm.common import arrow_records, doc_key, doc_no, packed, stored

SHINGLE = 3
MAX_BITS = 2
SEGMENTS = 5
PAIR_LIMIT = 64
SEED = 42
ARROW_ROWS = 500         # documents that a task is handed at a time


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of the text's word shingles."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - size + 1)
    last = ends[-n:]
    hash_of = xxhash.xxh64_intdigest
    hashes = np.fromiter((hash_of(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), last.tolist())), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):      # bounds the memory of very long texts
        bits = np.unpackbits(hashes[at:at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return _signed(sum(1 << k for k in range(64) if 2 * ones[k] > n))


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``doc_id, doc_no, doc_key, fp`` of every row, stored."""

    def run(batches):
        for b in batches:
            fp = pa.array([fingerprint(t, size) for t in b.column(3).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), fp], ["doc_id", "doc_no", "doc_key", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), doc_no().alias("doc_no"), doc_key().alias("doc_key"),
                       F.col("text").cast("string").alias("text"))
    with arrow_records(docs.sparkSession, ARROW_ROWS):
        return stored(rows.mapInArrow(run, "doc_id long, doc_no long, doc_key long, fp long"), "fingerprints")


def ring(segments: int) -> list[int]:
    """Bit masks of the segments, as equal as can be."""
    cuts = [64 * k // segments for k in range(segments + 1)]
    return [((1 << b) - (1 << a)) for a, b in zip(cuts, cuts[1:])]


def chains(segments: int, max_bits: int) -> tuple[list[list[int]], list[int]]:
    """Masks by beginning and length of the chain, and the budgets by length."""
    seg = ring(segments)
    masks = []
    for i in range(segments):
        row, mask = [], 0
        for l in range(segments):
            mask |= seg[(i + l) % segments]
            row.append(mask)
        masks.append(row)
    return masks, [(l + 1) * max_bits // segments for l in range(segments)]


def links(nodes: DataFrame, max_bits: int = MAX_BITS, segments: int = SEGMENTS, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """Edges ``u, v`` between distinct fingerprints ``fp`` at most ``max_bits``
    (up to 2) apart: every such pair, or, for keys of many fingerprints, stars
    that connect the same nodes."""
    if not 0 < max_bits <= 2 or segments <= max_bits:
        raise ValueError("1 or 2 bits, and more segments than bits")
    masks, budgets = chains(segments, max_bits)
    equal = sum(b == 0 for b in budgets)
    begins = F.explode(F.array(*[
        F.struct(F.lit(i).alias("chain"), F.col("fp").bitwiseAND(F.lit(_signed(masks[i][equal - 1]))).alias("key"))
        for i in range(segments)])).alias("k")
    keyed = nodes.select("fp", begins).select("fp", "k.chain", "k.key")
    sizes = stored(keyed.groupBy("chain", "key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "keys")
    shared = stored(keyed.join(sizes, ["chain", "key"]), "shared-keys")
    few = shared.filter(F.col("size") <= pair_limit)
    pairs = few.select("chain", "key", F.col("fp").alias("u")) \
        .join(few.select("chain", "key", F.col("fp").alias("v")), ["chain", "key"]).filter("u < v")
    differ = F.col("u").bitwiseXOR(F.col("v"))
    for l in range(equal, segments):
        mask = F.element_at(F.array(*[F.lit(_signed(masks[i][l])) for i in range(segments)]), F.col("chain") + 1)
        pairs = pairs.filter(F.bit_count(differ.bitwiseAND(mask)) <= budgets[l])
    reach = {1: 0, 2: 1}[max_bits]
    near = F.lit(None).cast("array<long>")
    for i in range(segments):
        free = [b for b in range(64) if not masks[i][equal - 1] >> b & 1]
        flips = [F.col("fp").bitwiseXOR(F.lit(_signed(1 << b))) for b in free]
        near = F.when(F.col("chain") == i, F.array(F.col("fp"), *flips)).otherwise(near)
    meets = shared.filter(F.col("size") > pair_limit).select("chain", "key", "fp", F.explode(near).alias("value"))
    if reach:
        stars = meets.groupBy("chain", "key", "value").agg(F.min("fp").alias("u"), F.collect_set("fp").alias("vs")) \
            .filter(F.size("vs") > 1).select("u", F.explode("vs").alias("v")).filter("u < v")
    else:
        stars = meets.select("chain", "key", F.col("fp").alias("u"), F.col("value").alias("v")) \
            .join(shared.select("chain", "key", F.col("fp").alias("v")), ["chain", "key", "v"], "left_semi") \
            .filter("u < v").select("u", "v")
    return stored(pairs.select("u", "v").union(stars).distinct(), "links")


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node of the edges; the root is the component's
    least node. Each round hooks every tree to the least tree a neighbour is
    in and halves the depth of the trees, so rounds grow with the logarithm
    of the diameter; nodes only meet in partial minima and skew-split joins."""
    both = stored(edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), "both-ways")
    state = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("f"))
                   .select(F.col("u").alias("node"), "f"), "parents")
    while True:
        grand = stored(state.join(state.select(F.col("node").alias("f"), F.col("f").alias("g")), "f")
                       .select("node", "f", "g"), "grandparents")
        seen = both.join(grand.select(F.col("node").alias("v"), F.col("g").alias("m")), "v") \
            .groupBy("u").agg(F.min("m").alias("m"))
        hooked = grand.join(seen.withColumnRenamed("u", "node"), "node", "left") \
            .select("node", "f", "g", F.least("g", F.coalesce("m", "g")).alias("m"))
        offers = hooked.select(F.explode(F.array(
            F.struct(F.col("node").alias("node"), F.col("m").alias("f")),
            F.struct(F.col("f").alias("node"), F.col("m").alias("f")))).alias("o")).select("o.node", "o.f")
        after = stored(offers.groupBy("node").agg(F.min("f").alias("f")), "parents")
        moved = after.agg(F.sum(F.col("f").cast("decimal(38,0)"))).first()[0] \
            != grand.agg(F.sum(F.col("f").cast("decimal(38,0)"))).first()[0]
        state = after
        if not moved:
            return state.select("node", F.col("f").alias("root"))


def near_duplicates(docs: DataFrame, size: int = SHINGLE, max_bits: int = MAX_BITS,
                    segments: int = SEGMENTS) -> DataFrame:
    """``doc_id, doc_no, doc_key, fp, component_id`` of every row."""
    prints = fingerprints(docs, size)
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(links(nodes.select("fp"), max_bits, segments))
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left") \
        .select("fp", "least", F.coalesce("root", "fp").alias("root"))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stored(rooted.join(names, "root").select("fp", "component_id"), "named")
    return prints.join(named, "fp").select("doc_id", "doc_no", "doc_key", "fp", "component_id")


def keep_one(docs: DataFrame, size: int = SHINGLE, max_bits: int = MAX_BITS, segments: int = SEGMENTS) -> DataFrame:
    """All columns of the rows that stay: of each group the row of the least
    ``doc_id``. Of rows with that id, or of a group without any id, one stays."""
    found = near_duplicates(docs.select("doc_id", "text"), size, max_bits, segments)
    named = found.filter(F.col("doc_id") == F.col("component_id")).groupBy("doc_no").agg(F.min("doc_key").alias("doc_key"))
    nameless = found.filter(F.col("component_id").isNull()).groupBy("fp") \
        .agg(F.min(F.struct("doc_no", "doc_key")).alias("k")).select("k.doc_no", "k.doc_key")
    winners = named.select("doc_no", "doc_key").union(nameless).distinct()
    one = Window.partitionBy("doc_no", "doc_key").orderBy(F.lit(0))
    return packed(docs).join(winners, ["doc_no", "doc_key"], "left_semi") \
        .withColumn("copy", F.row_number().over(one)).filter("copy = 1").select("doc.*")
