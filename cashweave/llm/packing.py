"""Best-fit packing by linear grouping.

Whole documents (cut into full pieces only where longer than a sequence) are
packed into as few sequences as possible:

1. Spark counts the pieces of each length. Lengths are integers from 1 to the
   capacity, so this histogram has at most ``capacity`` rows whatever the
   corpus, and so has every table the plan below is made of.
2. Large lengths are split into groups of equal cardinality, each rounded up
   to the largest of its group; the few-size problem that results is solved
   as a configuration program (column generation, knapsack pricing).
3. The actual documents, longest first, take the places of the rounded ones;
   what is left over and the small ones go best-fit, longest first, into the
   space that is really free. Both steps work on runs ("the next 5,000 pieces
   of length 731 go to sequences 40,000.. at offset 1,820"), never on single
   pieces.
4. Spark ranks the pieces within their length and looks their run up.

Nulls and ties: null and empty text is an empty document (its end id only);
repeated rows are packed once each; rows with a null ``doc_id`` are packed
like any other. An empty table gives no rows.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cashweave.llm.common import arrow_records, stored
from cashweave.llm.token_ids import default_tokenizer, encoder

CAPACITY = 4096
END_ID = 1
GROUPS = 48              # groups of equal cardinality among the large lengths
LARGE_SHARE = 0.2        # a length above this share of the capacity is large
SLACK = 0.001            # share of a sequence that a substituted configuration may leave free
ARROW_ROWS = 500         # documents that a task is handed at a time
RANK_BLOCK = 512         # pieces of one length that one rank block holds, about

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY,
                 end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece of each document: ``doc_id, piece, start, length,
    ids_crc32`` and, if asked for, the ids."""
    path = tokenizer or default_tokenizer()

    def run(batches):
        for batch in batches:
            enc = encoder(path)
            cols: list[list] = [[], [], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.append(enc.encode(text).astype("<u4"), np.uint32(end_id))
                for k, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start:start + capacity]
                    row = (doc_id, k, start, len(part), zlib.crc32(part.tobytes()), part if with_ids else None)
                    for c, v in zip(cols, row):
                        c.append(v)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            arrays = [pa.array(c, k) for c, k in zip(cols, kinds)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays.append(pa.array(cols[5], pa.list_(pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = PIECE_SCHEMA + (", ids array<long>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .mapInArrow(run, schema)


# ---- the plan, over the histogram of lengths ---------------------------------

def linear_groups(lengths: list[tuple[int, int]], groups: int) -> list[tuple[int, list[list[int]]]]:
    """Split (length, count) pairs, longest first, into groups of equal
    cardinality: [(rounded size, [[length, count], ...])]."""
    total = sum(c for _, c in lengths)
    size = -(-total // groups) if total else 0
    out: list[tuple[int, list[list[int]]]] = []
    room = 0
    for length, count in lengths:
        while count:
            if not room:
                out.append((length, []))
                room = size
            take = min(room, count)
            out[-1][1].append([length, take])
            room -= take
            count -= take
    return out


def _best_pattern(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The configuration of greatest value: an unbounded knapsack by integer length."""
    best = np.zeros(capacity + 1)
    last = np.full(capacity + 1, -1)
    for j in np.argsort(-values / sizes):
        s, v = int(sizes[j]), values[j]
        if v <= 1e-12:
            continue
        for _ in range(capacity // s):
            shifted = best[:-s] + v
            better = shifted > best[s:] + 1e-12
            if not better.any():
                break
            best[s:][better] = shifted[better]
            last[s:][better] = j
    counts = np.zeros(len(sizes))
    room = int(np.argmax(best))
    while room > 0 and last[room] >= 0:
        counts[last[room]] += 1
        room -= int(sizes[last[room]])
    return float(counts @ values), counts


def configurations(sizes: list[int], demand: list[int], capacity: int,
                   max_rounds: int = 600) -> list[tuple[int, list[int]]]:
    """[(sequences, items of each size)] whose sequences, rounded down, solve
    the configuration program; any round's basis is a valid solution."""
    s, d = np.array(sizes), np.array(demand, float)
    basis = np.diag((capacity // s).astype(float))
    x = np.linalg.solve(basis, d)
    for _ in range(max_rounds):
        prices = np.linalg.solve(basis.T, np.ones(len(s)))
        value, pattern = _best_pattern(s, np.maximum(prices, 0), capacity)
        if value <= 1 + 1e-7:
            break
        step = np.linalg.solve(basis, pattern)
        ratios = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        leave = int(np.argmin(ratios))
        x = x - ratios[leave] * step
        x[leave] = ratios[leave]
        basis[:, leave] = pattern
        x = np.maximum(x, 0)
    return [(int(x[j] + 1e-9), [int(round(a)) for a in basis[:, j]]) for j in range(len(s)) if int(x[j] + 1e-9)]


class _Plan:
    """Sequences as runs [first sequence, sequences, tokens used]; places as
    rows (length, first rank, end rank, first sequence, offset)."""

    def __init__(self, histogram: dict[int, int], capacity: int):
        self.capacity = capacity
        self.rank = dict.fromkeys(histogram, 0)
        self.places: list[tuple[int, int, int, int, int]] = []
        self.open: dict[int, list[list[int]]] = {}     # free tokens -> runs
        self.free: list[int] = []                      # its keys, ascending
        self.sequences = 0

    def new_run(self, count: int) -> list[int]:
        self.sequences += count
        return [self.sequences - count, count, 0]

    def place(self, length: int, run: list[int]) -> None:
        """Put one piece of ``length`` into each sequence of ``run``."""
        first = self.rank[length]
        self.rank[length] = first + run[1]
        self.places.append((length, first, first + run[1], run[0], run[2]))
        run[2] += length

    def keep(self, run: list[int]) -> None:
        room = self.capacity - run[2]
        if room:
            if room not in self.open:
                self.open[room] = []
                bisect.insort(self.free, room)
            self.open[room].append(run)

    def fill(self, config: list[int], count: int, queues: list[list[list[int]]], slack: int,
             left: dict[int, int]) -> None:
        """``count`` sequences of a configuration, with actual lengths. Where
        these leave more than ``slack`` tokens free, the rounding has cost too
        much: such sequences are not opened, their pieces go to ``left``."""
        runs: list[tuple[int, list[int]]] = [(count, [])]
        for group, times in enumerate(config):
            for _ in range(times):
                after = []
                for number, lengths in runs:
                    while number and queues[group]:
                        part = queues[group][-1]
                        take = min(number, part[1])
                        after.append((take, [*lengths, part[0]]))
                        number -= take
                        part[1] -= take
                        if not part[1]:
                            queues[group].pop()
                    if number:
                        after.append((number, lengths))
                runs = after
        for number, lengths in runs:
            if self.capacity - sum(lengths) > slack:
                for length in lengths:
                    left[length] += number
            else:
                run = self.new_run(number)
                for length in lengths:
                    self.place(length, run)
                self.keep(run)

    def best_fit(self, length: int, count: int) -> None:
        while count:
            at = bisect.bisect_left(self.free, length)
            if at == len(self.free):
                per = self.capacity // length
                full, rest = divmod(count, per)
                for sequences, items in ((full, per), (1 if rest else 0, rest)):
                    if sequences:
                        run = self.new_run(sequences)
                        for _ in range(items):
                            self.place(length, run)
                        self.keep(run)
                return
            room = self.free[at]
            run = self.open[room].pop()
            if not self.open[room]:
                del self.open[room]
                self.free.pop(at)
            take = min(count, run[1])
            if take < run[1]:
                self.keep([run[0] + take, run[1] - take, run[2]])
                run = [run[0], take, run[2]]
            self.place(length, run)
            self.keep(run)
            count -= take


def plan_packing(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS,
                 large_share: float = LARGE_SHARE, slack: float = SLACK) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """(places, sequences) for a histogram {length: pieces}."""
    plan = _Plan(histogram, capacity)
    if histogram.get(capacity):
        plan.place(capacity, plan.new_run(histogram[capacity]))
    rest = sorted(((n, c) for n, c in histogram.items() if n < capacity and c), reverse=True)
    large = [(n, c) for n, c in rest if n > large_share * capacity]
    left: dict[int, int] = dict(rest)
    if large:
        grouped = linear_groups(large, groups)
        sizes = [size for size, _ in grouped]
        merged: dict[int, list[list[int]]] = {}
        for size, parts in grouped:          # groups of one rounded size are one size
            merged.setdefault(size, []).extend(parts)
        sizes = list(merged)
        demand = [sum(c for _, c in merged[s]) for s in sizes]
        queues = [merged[s][::-1] for s in sizes]      # longest at the end
        for n, _ in large:
            left[n] = 0
        for count, config in configurations(sizes, demand, capacity):
            plan.fill(config, count, queues, int(slack * capacity), left)
        for queue in queues:
            for n, c in queue:
                left[n] += c
    for n in sorted(left, reverse=True):
        plan.best_fit(n, left[n])
    return plan.places, plan.sequences


# ---- the assignment, over all pieces ----------------------------------------

PLACE_SCHEMA = T.StructType([T.StructField(n, T.LongType()) for n in
                             ("__len", "__lo", "__hi", "__seq", "__off")])


def assign(pieces: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a stored table of pieces.

    Ranks within a length are built in blocks: a length that a third of the
    pieces share is spread over as many blocks as its count asks for. The
    histogram and the places are bounded by the capacity, hence broadcast.
    """
    spark = pieces.sparkSession
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    places, _ = plan_packing(histogram, capacity, groups)
    blocks = spark.createDataFrame([(n, -(-c // RANK_BLOCK)) for n, c in histogram.items()], "__len long, __blocks long")
    spread = pieces.join(F.broadcast(blocks), F.col("length") == F.col("__len")).drop("__len") \
        .withColumn("__block", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("__blocks"))).drop("__blocks")
    before = spread.groupBy("length", "__block").agg(F.count(F.lit(1)).alias("__n")) \
        .withColumn("__before", F.sum("__n").over(
            Window.partitionBy("length").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1))) \
        .select(F.col("length").alias("__blen"), F.col("__block").alias("__bblock"),
                F.coalesce("__before", F.lit(0)).alias("__before"))
    within = Window.partitionBy("length", "__block").orderBy("doc_id", "piece", "ids_crc32")
    ranked = spread.withColumn("__row", F.row_number().over(within)) \
        .join(before, (F.col("length") == F.col("__blen")) & (F.col("__block") == F.col("__bblock"))) \
        .withColumn("__rank", F.col("__before") + F.col("__row") - 1)
    runs = spark.createDataFrame(places, PLACE_SCHEMA)
    found = ranked.join(F.broadcast(runs), (F.col("length") == F.col("__len")) & (F.col("__rank") >= F.col("__lo"))
                        & (F.col("__rank") < F.col("__hi")))
    return found.select(*pieces.columns, (F.col("__seq") + F.col("__rank") - F.col("__lo")).alias("sequence_id"),
                        F.col("__off").alias("offset"))


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID,
         with_ids: bool = False) -> DataFrame:
    """Tokenise and pack ``docs`` (``doc_id, text``): one row per piece."""
    with arrow_records(docs.sparkSession, ARROW_ROWS):
        pieces = stored(token_pieces(docs, tokenizer, capacity, end_id, with_ids), "pieces")
    return assign(pieces, capacity)
