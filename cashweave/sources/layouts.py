"""A catalogue of export files: what they are, and by which header each is read.

A folder of exports holds files of many banks: columns in differing order,
headers repeated, JSON beside CSV. ``catalogue`` lists the files below an
entry and reads the first record of every CSV file in one distributed pass
that stops after it; files with equal headers form a layout and share one
scan. JSON files need no layout: each document becomes a VARIANT, without an
inference pass or a common schema, and its objects are mapped by their own
names.
"""

from __future__ import annotations

import csv
from dataclasses import dataclass, replace
from typing import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cashweave.functions.text import py_strip
from cashweave.schema import COLUMN_ALIASES, REQUIRED_COLUMNS

CSV_SUFFIXES = (".csv",)
LINE_SUFFIXES = (".jsonl", ".ndjson")
JSON_SUFFIXES = (".json", *LINE_SUFFIXES)
EXCEL_SUFFIXES = (".xlsx", ".xls")
HEADER_LINES = 64            # lines that are sent to Python at a time, of which the first record is needed
VARIANT_BYTES = 64 << 20     # a larger JSON document is read with inference: a VARIANT can't hold it


@dataclass(frozen=True)
class ExportFile:
    path: str                             # as readers take it, before glob signs are escaped
    uri: str                              # as a scan's _metadata names it
    length: int
    kind: str | None                      # csv, json, lines; None if it is no export
    header: tuple[str, ...] | None = None


def kind_of(path: str) -> str | None:
    low = path.lower().rstrip("/")
    if low.endswith(CSV_SUFFIXES):
        return "csv"
    if low.endswith(LINE_SUFFIXES):
        return "lines"
    return "json" if low.endswith(JSON_SUFFIXES) else None


def unreadable(path: str) -> str:
    name = path.lower().rstrip("/").rpartition("/")[2]
    suffix = name[name.rfind("."):] if "." in name else name
    return f"This type of file can't be read: {suffix}" + (
        " (spreadsheets: save as CSV first)" if suffix in EXCEL_SUFFIXES else "")


def list_files(spark: SparkSession, path: str) -> list[ExportFile]:
    """The files of an entry (a file, a folder with its subfolders, or a glob)
    by Spark's own listing, in order; hidden ones are left out."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path) \
        .select("path", F.col("_metadata.file_path").alias("uri"), "length").orderBy("path").collect()
    return [ExportFile(r.path, r.uri, r.length, kind_of(r.path)) for r in found]


def first_records(spark: SparkSession, paths: list[str]) -> dict[str, tuple[str, ...]]:
    """The first record of each CSV file that can be read, by one task a file
    which reads no further than that record."""
    if not paths:
        return {}

    def first(batches):
        def lines():
            for b in batches:
                where.append(b.column(0)[0].as_py())
                yield from (v + "\n" for v in b.column(1).to_pylist())

        where: list[str] = []
        record = next((r for r in csv.reader(lines()) if r), None)
        if record is not None:
            record[0] = record[0].removeprefix("\ufeff")
            yield pa.RecordBatch.from_arrays([pa.array([where[0]]), pa.array([record], pa.list_(pa.string()))], ["path", "header"])

    # A session of its own, so that the settings hold for this pass only: one
    # file a task, a few lines at a time, and unreadable files give no record.
    own = spark.newSession()
    for key, value in (("spark.sql.files.maxPartitionBytes", str(1 << 60)), ("spark.sql.files.openCostInBytes", str(1 << 60)),
                       ("spark.sql.files.ignoreCorruptFiles", "true"), ("spark.sql.execution.arrow.maxRecordsPerBatch", str(HEADER_LINES))):
        own.conf.set(key, value)
    lines = own.read.text(paths).select(F.col("_metadata.file_path").alias("path"), "value")
    return {r.path: tuple(c or "" for c in r.header) for r in lines.mapInArrow(first, "path string, header array<string>").collect()}


def catalogue(spark: SparkSession, path: str) -> list[ExportFile]:
    """The files of an entry with their headers (CSV; empty files have none)."""
    files = list_files(spark, path)
    headers = first_records(spark, [_as_given(f.path) for f in files if f.kind == "csv" and f.length])
    return [replace(f, header=headers.get(f.uri)) for f in files]


def _as_given(path: str) -> str:
    """A listed path for a reader: its glob signs are meant as they stand."""
    return "".join("\\" + c if c in "*?[]{}\\" else c for c in path)


def by_layout(files: Iterable[ExportFile]) -> dict[tuple[str, ...], list[ExportFile]]:
    """CSV files by header, layouts in the order of their first file."""
    out: dict[tuple[str, ...], list[ExportFile]] = {}
    for f in files:
        if f.kind == "csv" and f.header is not None:
            out.setdefault(f.header, []).append(f)
    return out


def unique_names(header: Iterable[str]) -> list[str]:
    """Column names for a header: of equal ones the first keeps its name and the
    others get a number, so that they can't be mixed up."""
    seen: dict[str, int] = {}
    out = []
    for k, name in enumerate(header):
        seen[name.lower()] = seen.get(name.lower(), 0) + 1
        out.append((name or f"_c{k}") if seen[name.lower()] == 1 else f"{name} ({seen[name.lower()]})")
    return out


def scan_csv(spark: SparkSession, header: tuple[str, ...], files: list[ExportFile], multiline: bool = True) -> DataFrame:
    """All-string rows of the files of one layout, by one scan. Their headers
    were compared before, so columns go by position."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in unique_names(header)])
    return spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("multiLine", multiline) \
        .option("escape", '"').csv([_as_given(f.path) for f in files])


def scan_json(spark: SparkSession, files: list[ExportFile]) -> DataFrame:
    """One row per JSON document (a file, or a line of a file of lines) with
    ``items``, an array<variant> of its objects: those of a list, those of an
    object's ``transactions``, or the object itself. A text that is no JSON has
    no items and ``bad`` set; a blank one has no items."""
    lines = files[0].kind == "lines"
    text = spark.read.text([_as_given(f.path) for f in files], wholetext=not lines)
    # In brackets a text is one value, or none if it is blank, or no JSON at all.
    held = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), F.regexp_replace("value", "^\ufeff", ""), F.lit("]"))), "$", "array<variant>")
    rows = text.select("_metadata", held.alias("_held")) \
        .select("_metadata", (F.col("_held").isNull() | (F.size("_held") > 1)).alias("bad"),
                F.when(F.size("_held") == 1, F.try_element_at("_held", F.lit(1))).alias("_doc"))
    listed = F.try_variant_get("_doc", "$", "array<variant>")
    inner = F.try_variant_get("_doc", "$.transactions", "array<variant>")
    none = F.filter(F.array("_doc"), lambda _: F.lit(False))
    kind = F.schema_of_variant("_doc")
    items = F.when(listed.isNotNull(), listed).when(inner.isNotNull(), inner) \
        .when(F.coalesce(kind.startswith("OBJECT<"), F.lit(False)), F.array("_doc")).otherwise(none)
    return rows.select("_metadata", items.alias("items"), "bad")


def fields_of(item: Column, names: Iterable[str], others: Iterable[str] = ()) -> dict[str, Column]:
    """Texts of an object's canonical fields, and of ``others`` by their exact
    names. Where several keys have one meaning, the first in alphabetical order
    counts (a VARIANT keeps no other order)."""
    entries = F.map_entries(F.try_variant_get(item, "$", "map<string,string>"))
    out = {}
    for name in names:
        aliases = [a for a, target in COLUMN_ALIASES.items() if target == name]
        found = F.filter(entries, lambda e: F.lower(py_strip(e["key"])).isin(name, *aliases))
        out[name] = F.try_element_at(found, F.lit(1))["value"]
    for name in others:
        out[name] = F.try_element_at(F.filter(entries, lambda e: e["key"] == name), F.lit(1))["value"]
    return out


def objects_of(docs: DataFrame, others: Iterable[str] = (), check: bool = True, whole_files: bool = True) -> DataFrame:
    """One row per object of ``scan_json``, with its texts under canonical
    names, ``_split`` (its document has debit or credit columns, which then
    make up the amount) and ``_pos``. With ``check``, a document that is no
    JSON fails the job, and so does one whose objects have no key for a
    required column, if documents are whole files."""
    keys = F.array_distinct(F.flatten(F.transform("items", lambda i: F.transform(
        F.map_keys(F.coalesce(F.try_variant_get(i, "$", "map<string,string>"), F.create_map().cast("map<string,string>"))),
        lambda k: F.lower(py_strip(k))))))
    staged = docs.withColumn("_keys", keys)

    def has(*targets):
        return F.arrays_overlap("_keys", F.array(*[F.lit(a) for a, t in COLUMN_ALIASES.items() if t in targets], *map(F.lit, targets)))

    staged = staged.withColumn("_split", F.coalesce(has("_debit", "_credit"), F.lit(False)))
    if check:
        lacks = [F.when(~has(c, *(("_debit", "_credit") if c == "amount" else ())), F.lit(c)) for c in REQUIRED_COLUMNS]
        absent = F.array_compact(F.array(*lacks))
        text = F.concat(F.lit("This export has no column for: "), F.array_join(absent, ", "), F.lit(". File: "), F.col("_metadata.file_path"))
        staged = staged.withColumn("items", F.when(F.col("bad"), F.raise_error(F.concat(
            F.lit("This file is no JSON: "), F.col("_metadata.file_path")))).when(
            F.lit(whole_files) & (F.size("items") > 0) & (F.size(absent) > 0), F.raise_error(text)).otherwise(F.col("items")))
    each = staged.select("_metadata", "_split", F.posexplode("items").alias("_pos", "_item"))
    fields = fields_of(F.col("_item"), ("transaction_date", "description", "amount", "_debit", "_credit"), others)
    return each.select("_metadata", "_split", "_pos", *[c.alias(n) for n, c in fields.items()])


def problem(f: ExportFile) -> str | None:
    """Why a file can't be read, if so."""
    if f.kind is None:
        return unreadable(f.path)
    if f.kind == "csv" and f.length and f.header is None:
        return f"{f.path} can't be read"
    return None
