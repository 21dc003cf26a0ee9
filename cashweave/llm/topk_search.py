"""Exact top-k inner products by no-random-access aggregation.

The candidates are dealt into shards of about ``SHARD`` vectors. A shard keeps
one list per dimension, sorted by component; for a query, a dimension's list
is read from its high end where the query's component is positive, else from
its low end, so contributions to the score only fall. All lists are read in
step, a round at a time. What a candidate has shown so far plus the last
contributions read is an upper bound of its score, plus the lists' least
contributions a lower one. A query stops as soon as at most ``FEW`` candidates
can still reach its k-th best lower bound; their scores are then resolved.
Ties stay in the race, so none is lost. Shards and blocks of queries lie in
the shared folder; a task takes a block of queries through up to ``RUN`` shards
one after the other, reading each when its turn comes, and hands the k-th best
scores found so far on to the next shard's bounds. Neither side is copied,
shuffled or sent through the driver for the meetings. A final ranking merges
the tasks' results.

Nulls and ties: rows without ``vec_id``, null vectors and vectors with null or
non-finite components take no part. Missing components of shorter vectors
count as zero. Rows that carry the query's own ``vec_id`` are not its
candidates; of several such rows the least vector asks. Repeated rows are
candidates each. Equal scores rank by ``vec_id``.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cashweave.llm.common import list_files, scratch_dir, shared_fs

K = 10
SHARD = 4096
QUERY_BLOCK = 1024
RUN = 16                       # shards that a task takes its block of queries through
MOST_TASKS = 10_000
ROUNDS = (0.5, 0.7, 0.85)      # depths, as shares of the lists, at which bounds are compared
FEW = 64                       # candidates beyond k that are resolved rather than read on for
SCALE = 1024


def integer_vectors(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """``vec_id, v`` (long components) of the rows that take part."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    return rows.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(fine) \
        .select(F.col("vec_id").cast("long").alias("vec_id"),
                F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


def _matrix(vectors) -> np.ndarray:
    width = max((len(v) for v in vectors), default=0)
    out = np.zeros((len(vectors), width), np.int64)
    for row, v in zip(out, vectors):
        row[:len(v)] = v
    return out


def _block(pdf: pd.DataFrame, lists: bool) -> pd.DataFrame:
    v = _matrix(list(pdf["v"]))
    order = np.argsort(v, axis=0, kind="stable").astype(np.int32) if lists else np.empty(0, np.int32)
    return pd.DataFrame({"ids": [pdf["vec_id"].to_numpy(np.int64).tobytes()], "n": [len(v)], "values": [v.tobytes()],
                         "lists": [order.tobytes()]})


def shards_of(vectors: DataFrame, size: int, lists: bool) -> tuple[str, int]:
    """Folder and number of blocks of about ``size`` vectors, a row each below
    ``block=...``; with ``lists``, with its sorted lists."""
    blocks = max(1, -(-vectors.count() // size))
    dealt = vectors.withColumn("block", F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(blocks)).cast("int"))

    def build(key, pdf):
        return _block(pdf, lists).assign(block=key[0])[["block", "ids", "n", "values", "lists"]]

    folder = scratch_dir(vectors.sparkSession, "vector-blocks")
    dealt.groupBy("block").applyInPandas(build, "block int, ids binary, n int, values binary, lists binary") \
        .write.partitionBy("block").parquet(folder)
    return folder, blocks


def _read_block(folder: str, block: int):
    """(ids, values, lists or None) of a block; None if no vector was dealt to it."""
    import pyarrow.parquet as pq

    at = f"{folder}/block={block}"
    for file in list_files(at, ".parquet"):
        for r in pq.ParquetFile(shared_fs(at)[0].open_input_file(file)).read().to_pylist():
            v, order = np.frombuffer(r["values"], np.int64).reshape(r["n"], -1), np.frombuffer(r["lists"], np.int32)
            return np.frombuffer(r["ids"], np.int64), v, order.reshape(v.shape) if order.size == v.size else None
    return None


def nra(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, values: np.ndarray, order: np.ndarray,
        k: int = K, rounds=ROUNDS, few: int = FEW, known=None) -> list[tuple[int, int, int]]:
    """(query, candidate, score) of each query's k best among one shard; if
    ``known`` has a score for a query, only of those that reach it."""
    n, dims = values.shape
    largest = int(np.abs(queries).max(initial=0)) * int(np.abs(values).max(initial=0)) * max(1, dims)
    kind = np.float64 if largest < 1 << 52 else object       # sums stay exact
    rank = np.empty((n, dims), np.int32)
    np.put_along_axis(rank, order, np.arange(n, dtype=np.int32)[:, None], 0)
    v = values.astype(kind)
    up, down = np.maximum(queries, 0).astype(kind), np.minimum(queries, 0).astype(kind)
    ends = [np.take_along_axis(values, order[[at]], 0)[0].astype(kind) for at in (0, n - 1)]
    least = np.concatenate((up * ends[0], down * ends[1]), 1)           # contributions at the far ends
    active = np.arange(len(queries))
    out: list[tuple[int, int, int]] = []

    def settle(q: int, some: np.ndarray) -> None:
        score = [int(x) for x in v[some] @ queries[q].astype(kind)]
        least_score = None if known is None else known[q]
        best = sorted((-s, i) for s, i in zip(score, ids[some].tolist()) if least_score is None or s >= least_score)[:k]
        out.extend((int(query_ids[q]), i, -s) for s, i in best)

    for share in (*rounds, 1.0):
        if not len(active):
            break
        depth = min(n, int(np.ceil(share * n)))
        shown = np.concatenate((rank >= n - depth, rank < depth), 1)    # read from above, from below
        seen = np.where(shown, np.concatenate((v, v), 1), 0)
        hidden = (~shown).astype(kind)
        weights = np.concatenate((up[active], down[active]), 1)
        front = [np.take_along_axis(values, order[[at]], 0)[0].astype(kind) for at in (n - depth, depth - 1)]
        last = np.concatenate((up[active] * front[0], down[active] * front[1]), 1)
        base = weights @ seen.T
        lower, upper = base + least[active] @ hidden.T, base + last @ hidden.T
        rest = []
        for row, q in enumerate(active):
            own = ids == query_ids[q]
            low = np.where(own, -np.inf, lower[row].astype(np.float64)) if kind is np.float64 else lower[row]
            others = n - int(own.sum())
            if others <= k:
                settle(q, np.flatnonzero(~own))
                continue
            if kind is object:
                low = np.array([x for x, o in zip(lower[row], own) if not o], object)
                bar = sorted(low)[-k]
            else:
                bar = np.partition(low, n - k)[n - k]
            if known is not None and known[q] is not None:
                bar = max(bar, known[q])
            able = np.flatnonzero((upper[row] >= bar) & ~own)
            if share == 1.0 or len(able) <= k + few:
                settle(q, able)
            else:
                rest.append(q)
        active = np.array(rest, int)
    return out


def _search_run(shards: str, run: range, blocks: str, block: int, k: int) -> pd.DataFrame:
    """``query_id, vec_id, score`` of the k best in a run of shards for each
    query of a block."""
    columns = ["query_id", "vec_id", "score"]
    asked = _read_block(blocks, block)
    if asked is None:
        return pd.DataFrame(columns=columns).astype("int64")
    q_ids, q, _ = asked
    place = {i: at for at, i in enumerate(q_ids.tolist())}
    best: list[list[tuple[int, int]]] = [[] for _ in place]     # (score, -candidate), a heap of k
    for at in run:
        one = _read_block(shards, at)
        if one is None:
            continue
        ids, v, order = one
        width = min(v.shape[1], q.shape[1])             # beyond it one side is zero
        known = [b[0][0] if len(b) == k else None for b in best]
        for query, i, score in nra(q_ids, q[:, :width], ids, v[:, :width], order[:, :width], k, known=known):
            b = best[place[query]]
            (heapq.heappush if len(b) < k else heapq.heappushpop)(b, (score, -i))
    rows = [(query, -i, score) for query, b in zip(q_ids.tolist(), best) for score, i in b]
    return pd.DataFrame(rows, columns=columns).astype("int64")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, shard: int = SHARD,
          query_block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score`` for integer vectors (``vec_id, v``)."""
    spark = vectors.sparkSession
    shards, n_shards = shards_of(vectors, shard, True)
    blocks, n_blocks = shards_of(queries.groupBy("vec_id").agg(F.min("v").alias("v")), query_block, False)
    run = max(1, min(RUN, n_shards * n_blocks // (4 * spark.sparkContext.defaultParallelism)))
    runs = -(-n_shards // run)

    def search(frames):
        for pdf in frames:
            for at in pdf["id"]:
                yield _search_run(shards, range(at // n_blocks * run, min(n_shards, (at // n_blocks + 1) * run)), blocks, at % n_blocks, k)

    found = spark.range(0, runs * n_blocks, 1, min(runs * n_blocks, MOST_TASKS)) \
        .mapInPandas(search, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")
