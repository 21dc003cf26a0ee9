"""Session helpers.

Library code never builds its own session: it uses the one the caller passes
(or the active one). ``local_session`` exists for tests, the bench and the
driver smoke run.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app_name: str = "cashweave") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Whole-stage functions above HotSpot's 8000-bytecode JIT limit run
        # interpreted; let Spark fall back to per-operator codegen for them
        # (the keyword categorizer's fused stage is one such function).
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the operator of the cluster sets it to a shared folder and we
    only read it; without it we refuse to go on, since the driver's own disk
    is not seen by executors. Only under a local master (tests) do we point it
    at a fresh scratch folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    existing = spark.sparkContext.getCheckpointDir()
    if existing:
        return existing
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    path = tempfile.mkdtemp(prefix="cashweave-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.sparkContext.setCheckpointDir(path)
    return path


def shared_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder, which on a cluster must be named; nothing is made up."""
    if not (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return ensure_checkpoint_dir(spark)


def scratch_dir(spark: SparkSession, tag: str) -> str:
    """A fresh folder name below the shared folder named by ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage: a lost executor costs the tasks of the current
    stage, never the work that led to the table.
    """
    path = scratch_dir(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_fs(uri: str):
    """(filesystem, path) of a URI, usable from tasks; plain paths are local."""
    from pyarrow import fs

    if "://" in uri or uri.startswith("file:"):
        return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri[len("file:"):])
    return fs.LocalFileSystem(), os.path.abspath(uri)


def list_files(uri: str, suffix: str = "") -> list[str]:
    """Sorted paths (within their filesystem) of the files below ``uri``."""
    from pyarrow import fs

    system, path = shared_fs(uri)
    infos = system.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
    return sorted(i.path for i in infos if i.is_file and i.path.endswith(suffix))


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, once per application: operators with
    Python functions then run wherever the workers were started."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="cashweave-package-"), "cashweave.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("cashweave", os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)
