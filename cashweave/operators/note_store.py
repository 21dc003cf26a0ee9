"""Note store on disk: append-only runs, newest wins, levelled compaction
(U2, U3, K3, S6, G18, O16).

A store is a folder of runs ``run=<first>-<last>``, each the notes of the
batches from ``first`` to ``last``, an id at most once. Adding a batch writes
that batch and nothing else; when ``fanout`` runs of equal length lie at the
end, they are merged into one, so a note is rewritten about
``log(batches) / log(fanout)`` times. There is no list of runs that could
disagree with the files: a run counts if it is complete (``_SUCCESS``), and of
complete runs that start at the same batch the longest counts. A half-written
batch or merge is not seen and is written again; merged runs stay readable
until ``vacuum``. One writer at a time.

Reading: an id in a later run hides it in all earlier ones. The first run, by
far the longest, is only anti-joined with the ids of the others; its texts
are not shuffled for that unless those ids are too many to broadcast.

Vectors are stored with the name of the model that made them. Notes made by
another model (another width, say) are embedded anew when read, the others are
not; the filter on the name skips whole row groups either way.

Defined cases: a missing or empty folder is an empty store; an empty batch is
an empty run; blank texts are refused by ``prepare_notes`` before; within a
batch the later note of an id wins, and positions must differ and be 0 or more.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cashweave.functions.embeddings import with_embedding
from cashweave.schema import DEFAULT_EMBED_DIM

FANOUT = 8
RUN_SCHEMA = ("id string, text string, metadata map<string,string>, sparse struct<idx:array<int>,cnt:array<bigint>,sumsq:bigint>, "
              "dense array<double>, model string, seq long")


class Run(NamedTuple):
    first: int
    last: int
    path: str

    @property
    def batches(self) -> int:
        return self.last - self.first + 1


def complete_runs(spark: SparkSession, path: str) -> list[Run]:
    """All complete runs of a store folder."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    runs = []
    for entry in fs.listStatus(p):
        at = entry.getPath()
        if at.getName().startswith("run=") and fs.exists(jvm.org.apache.hadoop.fs.Path(at, "_SUCCESS")):
            first, last = at.getName()[len("run="):].split("-")
            runs.append(Run(int(first), int(last), at.toString()))
    return sorted(runs)


def live_runs(runs: list[Run]) -> list[Run]:
    """The runs that make up the store, oldest first: from each batch on the
    longest, up to the first batch that is missing."""
    longest = {r.first: r for r in sorted(runs)}
    live: list[Run] = []
    while (at := live[-1].last + 1 if live else 0) in longest:
        live.append(longest[at])
    return live


class NoteStore:
    """Notes in the folder ``path``, embedded by ``embed`` (H2, dense vectors;
    ``model`` names it) or by the hashing embedder of width ``dim`` (H3). A
    given ``embed`` without a name has its vectors made anew at each read."""

    def __init__(self, spark: SparkSession, path: str, dim: int = DEFAULT_EMBED_DIM, embed=None, model: str | None = None,
                 fanout: int = FANOUT):
        if fanout < 2:
            raise ValueError("fanout must be 2 or more")
        self.spark, self.path, self.fanout = spark, path.rstrip("/"), fanout
        self.kind = "sparse" if embed is None else "dense"
        self.embed = embed or (lambda df, text, out: with_embedding(df, text, out, dim))
        self.model = model or ("" if embed else f"hashing/{dim}")

    def runs(self) -> list[Run]:
        return live_runs(complete_runs(self.spark, self.path))

    def add(self, batch: DataFrame) -> Run:
        """Append a batch of ``prepare_notes`` as a run, then merge what is due."""
        live = self.runs()
        number = live[-1].last + 1 if live else 0
        top = self._scan(live).agg((F.coalesce(F.max("seq"), F.lit(-1)) + 1).alias("_base"))
        at = F.when(F.col("pos") < 0, F.raise_error(F.lit("positions of notes start at 0"))).otherwise(F.col("pos"))
        rows = batch.join(F.broadcast(top)).withColumn("seq", F.col("_base") + at.cast("long"))
        held = {self.kind: F.col("embedding")}
        none = {f.name: F.lit(None).cast(f.dataType) for f in T.StructType.fromDDL(RUN_SCHEMA).fields if f.name in ("sparse", "dense")}
        rows = rows.select("id", "text", "metadata", *[held.get(c, none[c]).alias(c) for c in ("sparse", "dense")],
                           F.lit(self.model).alias("model"), "seq")
        last = Window.partitionBy("id").orderBy(F.col("seq").desc())
        added = self._write(rows.withColumn("_rk", F.row_number().over(last)).where("_rk = 1").drop("_rk"), number, number)
        self._compact()
        return added

    def rows(self) -> DataFrame:
        """The notes as stored: ``RUN_SCHEMA``, each id once, as last added."""
        return self._newest(self.runs())

    def read(self) -> DataFrame:
        """The notes as ``upsert_notes`` gives them: id, text, metadata, embedding, seq."""
        rows, out = self.rows(), ["id", "text", "metadata", "embedding", "seq"]
        if not self.model:
            return self.embed(rows, "text", "embedding").select(*out)
        kept = rows.where(F.col("model") == self.model).withColumnRenamed(self.kind, "embedding").select(*out)
        return kept.unionByName(self.embed(rows.where(F.col("model") != self.model), "text", "embedding").select(*out))

    def vacuum(self) -> int:
        """Delete runs that a longer one replaced; nobody may be reading them."""
        every, live = complete_runs(self.spark, self.path), set(self.runs())
        jvm = self.spark.sparkContext._jvm
        gone = [r for r in every if r not in live and any(k.first <= r.first and r.last <= k.last for k in live)]
        for r in gone:
            p = jvm.org.apache.hadoop.fs.Path(r.path)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        return len(gone)

    def _scan(self, runs: list[Run]) -> DataFrame:
        if not runs:
            return self.spark.createDataFrame([], RUN_SCHEMA)
        return self.spark.read.schema(RUN_SCHEMA).parquet(*[r.path for r in runs])

    def _newest(self, runs: list[Run]) -> DataFrame:
        if len(runs) < 2:
            return self._scan(runs)
        later = self._scan(runs[1:])
        last = Window.partitionBy("id").orderBy(F.col("seq").desc())
        shown = later if len(runs) == 2 else later.withColumn("_rk", F.row_number().over(last)).where("_rk = 1").drop("_rk")
        return self._scan(runs[:1]).join(later.select("id"), "id", "left_anti").unionByName(shown)

    def _write(self, rows: DataFrame, first: int, last: int) -> Run:
        path = f"{self.path}/run={first:010d}-{last:010d}"
        rows.write.mode("overwrite").parquet(path)      # over a half-written one
        return Run(first, last, path)

    def _compact(self) -> None:
        length = 1
        while True:
            tail = self.runs()[-self.fanout:]
            if len(tail) < self.fanout or any(r.batches != length for r in tail):
                return
            self._write(self._newest(tail), tail[0].first, tail[-1].last)
            length *= self.fanout
