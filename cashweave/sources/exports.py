"""Bank-export sources.

``read_exports`` takes a list of sources in priority order. Each entry is a
file, a folder (with its subfolders) or a glob. Every CSV file is read by its
own header: files with equal headers share one all-string scan (no type
inference: values are coerced explicitly by the normaliser), JSON documents
are read as VARIANTs without inference, and the scans are unioned, so the
number of plans grows with the number of layouts, not of files (``layouts``).

Every row carries its provenance and position, taken at the scan before any
shuffle: ``file_ord`` (entry position, then file path) and ``row_ord``, which
adds the place in the file, is unique over all sources, and is what the
keep-first de-duplication orders by.
"""

from __future__ import annotations

from functools import reduce
from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cashweave.operators.normalize import canonical, normalize_all
from cashweave.schema import CANONICAL_SCHEMA, NOTE_SCHEMA, IngestionError
from cashweave.sources.layouts import (
    VARIANT_BYTES, ExportFile, by_layout, catalogue, objects_of, problem, scan_csv, scan_json,
)

def _fs_exists(spark: SparkSession, path: str) -> bool:
    """Existence through the Hadoop file system, so cluster paths work."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(conf)
    if any(ch in path for ch in "*?["):
        found = fs.globStatus(p)
        return found is not None and len(found) > 0
    return fs.exists(p)


def _provenance(df: DataFrame, entry_ord: int, item: Column | None = None) -> DataFrame:
    """Add ``_file`` (name), ``file_ord`` and ``row_ord`` from the scan's metadata.

    ``row_ord`` is unique over all sources and compares in reading order:
    entry, file, split start, position in the split, item of a JSON document.
    """
    path = F.col("_metadata.file_path")
    return df.select(
        *[F.col(f"`{c}`") for c in df.columns if c != "_metadata"],
        F.col("_metadata.file_name").alias("_file"),
        F.struct(F.lit(entry_ord).alias("entry"), path.alias("path")).alias("file_ord"),
        F.struct(F.lit(entry_ord).alias("entry"), path.alias("path"), F.col("_metadata.file_block_start").alias("block"),
                 F.monotonically_increasing_id().alias("row"),
                 (F.lit(0) if item is None else item).cast("long").alias("item")).alias("row_ord"),
    )


def read_large_json(spark: SparkSession, path: str, entry_ord: int) -> DataFrame:
    """All-string rows of a JSON document that is too large for a VARIANT: its
    columns are inferred. An object, a list of objects, or an object whose
    ``transactions`` are such a list."""
    df = spark.read.option("multiLine", True).option("primitivesAsString", True).json(path)
    plain = [c for c in df.columns if c != "transactions"]
    if "transactions" not in df.columns:
        return _provenance(df, entry_ord)
    kind = df.schema["transactions"].dataType
    inner = kind.elementType.fieldNames() if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType) else []
    fields = list(dict.fromkeys([*inner, *plain]))
    wrapped = F.transform("transactions", lambda t: F.struct(*[
        (t[c] if c in inner else F.lit(None)).cast("string").alias(c) for c in fields]))
    alone = F.array(F.struct(*[(F.col(f"`{c}`") if c in plain else F.lit(None)).cast("string").alias(c) for c in fields]))
    empty = F.transform(F.array().cast("array<string>"), lambda _: F.struct(*[F.lit(None).cast("string").alias(c) for c in fields]))
    rows = F.when(F.col("transactions").isNull(), alone).otherwise(wrapped if inner else empty) if fields else F.array()
    if not fields:
        return spark.createDataFrame([], PROVENANCE_SCHEMA)
    base = _provenance(df, entry_ord)
    split = base.select("_file", "file_ord", F.col("row_ord").alias("_at"), F.posexplode(rows).alias("_pos", "_t"))
    return split.select("_t.*", "_file", "file_ord", F.struct(
        *[F.col("_at")[c].alias(c) for c in ("entry", "path", "block", "row")], F.col("_pos").cast("long").alias("item")).alias("row_ord"))


PROVENANCE_SCHEMA = ("_file string, file_ord struct<entry:int,path:string>, "
                     "row_ord struct<entry:int,path:string,block:bigint,row:bigint,item:bigint>")


def _scans(spark: SparkSession, files: list[ExportFile], entry_ord: int, multiline_csv: bool, others: Sequence[str],
           strict: bool) -> Iterable[tuple[list[ExportFile], DataFrame]]:
    """(files, raw rows with provenance) of each layout of an entry."""
    for header, alike in by_layout(files).items():
        yield alike, _provenance(scan_csv(spark, header, alike, multiline_csv), entry_ord)
    for kind in ("json", "lines"):
        small = [f for f in files if f.kind == kind and (kind == "lines" or f.length <= VARIANT_BYTES)]
        if small:
            docs = scan_json(spark, small)
            yield small, _provenance(objects_of(docs, others, check=strict, whole_files=kind == "json"), entry_ord, F.col("_pos")).drop("_pos")
    for f in files:
        if f.kind == "json" and f.length > VARIANT_BYTES:
            yield [f], read_large_json(spark, f.path, entry_ord)


def read_all(spark: SparkSession, sources: Sequence[str], source: str | None = None, date_formats: Sequence[str] | None = None,
             on_error: str = "fail", keep: Iterable[str] = (), multiline_csv: bool = True,
             account_col: str | None = None) -> DataFrame:
    """Every row of the exports, good and rejected (see ``normalize_all``).

    ``account_col`` names the column with the ledger's id; without it, a
    source is part of one ledger. Columns of ``keep`` that a layout has not
    are null there. ``on_error="skip"`` turns an entry, or a file, that can't
    be read into one rejected row with the reason; objects of a JSON document
    without a date, amount or description are rejected one by one.
    Quoted fields may hold line breaks; ``multiline_csv=False`` says that
    they don't, and lets many tasks read one large CSV file.
    """
    if not sources:
        raise IngestionError("There is nothing to ingest")
    others = (*keep, *([account_col] if account_col else []))
    keep = ("file_ord", "row_ord", *keep)
    strict = on_error != "skip"
    frames = []

    def not_read(entry: int, path: str, reason) -> None:
        if strict:
            raise reason if isinstance(reason, IngestionError) else IngestionError(str(reason))
        frames.append(spark.range(1).select(
            F.lit(path).alias("source"), F.lit(f"entry not read: {reason}").alias("reject_reason"),
            F.struct(F.lit(entry).alias("entry"), F.lit(path).alias("path")).alias("file_ord")))

    for i, path in enumerate(sources):
        if not _fs_exists(spark, path):
            not_read(i, path, f"There is no file {path}")
            continue
        files = catalogue(spark, path)
        if not files:
            not_read(i, path, f"There are no files in {path}")
        for f in files:
            if problem(f):
                not_read(i, f.path, problem(f))
        for alike, raw in _scans(spark, [f for f in files if not problem(f)], i, multiline_csv, others, strict):
            try:
                tag = F.lit(source) if source else F.regexp_replace(F.col("_file"), r"\.[^.]*$", "")
                if account_col:
                    if account_col not in raw.columns:
                        raise IngestionError(f"{alike[0].path} has no column {account_col} for the ledger")
                    raw = raw.withColumn("account_id", F.col(f"`{account_col}`"))
                raw = raw.withColumns({c: F.lit(None).cast("string") for c in keep if c not in raw.columns})
                frames.append(normalize_all(raw, tag, date_formats, (*keep, *(["account_id"] if account_col else []))))
            except IngestionError as e:
                for f in alike:
                    not_read(i, f.path, e)
    if all("amount" not in f.columns for f in frames):
        frames.append(normalize_all(spark.createDataFrame([], "amount string, " + PROVENANCE_SCHEMA), keep=("file_ord", "row_ord")))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_exports(spark: SparkSession, sources: Sequence[str], source: str | None = None,
                 date_formats: Sequence[str] | None = None, on_error: str = "fail",
                 keep: Iterable[str] = (), multiline_csv: bool = True, account_col: str | None = None) -> DataFrame:
    """Canonical transactions from bank exports.

    ``source`` tags every row (default: the file name without extension).
    ``on_error="fail"`` raises ``IngestionError`` on the first bad entry;
    ``"skip"`` goes on, and ``read_all`` tells which entries and rows were
    left out.
    """
    rows = read_all(spark, sources, source, date_formats, on_error, keep, multiline_csv, account_col)
    return canonical(rows, ("file_ord", "row_ord", *keep, *(["account_id"] if account_col else [])))


def read_transactions(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Re-read a written canonical table (S5) with its schema, no inference."""
    if fmt == "parquet":
        return spark.read.parquet(path)
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    df = reader.csv(path)
    typed = [F.col(f.name).cast(f.dataType).alias(f.name) for f in CANONICAL_SCHEMA.fields if f.name in df.columns]
    extra = [F.col(c) for c in df.columns if c not in CANONICAL_SCHEMA.fieldNames()]
    return df.select(*typed, *extra)


def newest_version(spark: SparkSession, base_path: str) -> str | None:
    """The newest complete ``v=...`` folder of a note store, if there is one."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(base_path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return None
    done = [st.getPath() for st in fs.listStatus(p) if st.isDirectory() and st.getPath().getName().startswith("v=")
            and fs.exists(jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS"))]
    return max((d.toString() for d in done), default=None)


def read_notes(spark: SparkSession, path: str, fmt: str = "parquet", dim: int = 256, embed=None) -> DataFrame:
    """Load a note store (S6): its runs (``NoteStore``), else the newest version
    of it if it has versions, else the one table.

    A missing store is an empty one, and so is the part of a JSON store that
    is no JSON; errors of the storage itself are raised. Embeddings are
    derived data: without stored vectors of this embedder they are recomputed
    from the text, so a store written with another width still scores (Q22).
    """
    from cashweave.functions.embeddings import with_embedding
    from cashweave.operators.note_store import NoteStore
    runs = NoteStore(spark, path, dim=dim, embed=embed)
    if runs.runs():
        return runs.read()
    embed = embed or (lambda df, text, out: with_embedding(df, text, out, dim))
    empty = spark.createDataFrame([], NOTE_SCHEMA).drop("embedding")
    if not _fs_exists(spark, path):
        return embed(empty, "text", "embedding")
    path = newest_version(spark, path) or path
    if fmt == "parquet":
        df = spark.read.parquet(path)
    else:
        schema = "id string, text string, metadata map<string,string>, seq long, _corrupt_record string"
        df = spark.read.schema(schema).option("mode", "PERMISSIVE").json(path) \
            .where(F.col("_corrupt_record").isNull()).drop("_corrupt_record")
    if "seq" not in df.columns:
        df = df.withColumn("seq", F.monotonically_increasing_id())
    base = df.select("id", "text", F.coalesce("metadata", F.create_map().cast("map<string,string>"))
                     .alias("metadata"), "seq")
    return embed(base, "text", "embedding").select("id", "text", "metadata", "embedding", "seq")
