"""Session settings and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# Runtime settings every query relies on.  Shuffle partition counts are left to the cluster.
RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a skewed join partition even if that costs one more exchange behind the join
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # rows hold whole texts: a Python worker is given few of them at a time
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    # keyed state lives on disk with incremental checkpoints, not on the executor's heap
    "spark.sql.streaming.stateStore.providerClass": STATE_STORE,
}


def build_session(app: str = "weir", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app).config("spark.ui.enabled", "false")
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME, **conf}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def configure(spark: SparkSession) -> SparkSession:
    """Give a session made elsewhere the runtime settings it lacks, once, and its Python workers
    this package.  What its owner sets later stays."""
    if not getattr(spark, "_weir_configured", False):
        for key, value in RUNTIME.items():
            if spark.conf.get(key, None) != value:
                spark.conf.set(key, value)
        _ship_package(spark.sparkContext)
        spark._weir_configured = True
    return spark


def _ship_package(sc) -> None:
    """Once per application: executors import this package from a zip sent with the job."""
    if getattr(sc, "_weir_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="weir-"), "weir.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    path = os.path.join(folder, f)
                    z.write(path, os.path.join("weir", os.path.relpath(path, root)))
    sc.addPyFile(archive)
    sc._weir_shipped = True


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder that every executor can see.

    The cluster names the parent in ``spark.checkpoint.dir``.  Only a local session
    may fall back to a folder of this machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        base = os.path.join(tempfile.gettempdir(), "weir-local")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{_own_folder(spark, base.rstrip('/'))}/{name}-{uuid.uuid4().hex}"


def _path(spark: SparkSession, folder: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _own_folder(spark: SparkSession, base: str) -> str:
    """The application's part of the shared folder.  It goes when the application ends, so no
    intermediate table outlives its readers."""
    sc = spark.sparkContext
    folder = f"{base}/weir/{sc.applicationId}"
    made = getattr(sc, "_weir_folders", set())
    if folder not in made:
        path, store = _path(spark, folder)
        store.mkdirs(path)
        store.deleteOnExit(path)
        sc._weir_folders = made | {folder}
    return folder


def folder_exists(spark: SparkSession, folder: str) -> bool:
    path, store = _path(spark, folder)
    return store.exists(path)


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete an intermediate folder that has no reader left."""
    path, store = _path(spark, folder)
    store.delete(path, True)


def pinned(df, name: str = "pinned"):
    """Write ``df`` to the shared folder and read it back.

    Later uses see one fixed result, also after an executor is lost, and the file
    sizes let the planner check whether the table is small enough to broadcast.
    """
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
