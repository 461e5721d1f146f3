"""Spark session and shared-folder helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app: str = "streamfactor") -> SparkSession:
    """Session for local runs and tests. On a cluster, use the cluster's session."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(master or f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or int(cpus)))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.python.worker.reuse", "true")
        .config("spark.ui.showConsoleProgress", "false")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster's setting always wins. Only a local-mode session without one
    (tests) gets a fresh scratch folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="sf-ckpt-"))
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for written tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/streamfactor/{name}-{uuid.uuid4().hex[:12]}"


def _file_system(spark: SparkSession, path: str):
    sc = spark.sparkContext
    hadoop_path = sc._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(sc._jsc.hadoopConfiguration()), hadoop_path


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` exists in its (possibly remote) file system; a failing file system raises."""
    fs, p = _file_system(spark, path)
    return fs.exists(p)


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, p = _file_system(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def list_folder(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; a missing one has none."""
    fs, p = _file_system(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []


def glob_paths(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a glob pattern, in one call to their file system."""
    fs, p = _file_system(spark, pattern)
    return [f.getPath().toString() for f in fs.globStatus(p) or ()]


def folder_bytes(spark: SparkSession, path: str) -> int:
    fs, p = _file_system(spark, path)
    return fs.getContentSummary(p).getLength()


def remove_path(spark: SparkSession, path: str) -> None:
    """Remove a table that this engine wrote and no longer needs."""
    fs, p = _file_system(spark, path)
    fs.delete(p, True)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``streamfactor`` importable in Python workers, once per SparkContext.

    Kernels and pandas/arrow functions are pickled by reference, so executors
    need the package. The zip is built on the driver; when the shared
    checkpoint folder is not on the local file system it is copied there
    (Hadoop FileSystem API) and added from the shared copy."""
    import shutil

    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    out_dir = tempfile.mkdtemp(prefix="sf-pkg-")
    archive = shutil.make_archive(os.path.join(out_dir, "streamfactor"), "zip",
                                  root_dir=os.path.dirname(pkg_dir), base_dir="streamfactor")
    target = archive
    shared = ensure_checkpoint_dir(spark)
    if not (shared.startswith("file:") or shared.startswith("/")):
        jvm = sc._jvm
        dst = jvm.org.apache.hadoop.fs.Path(f"{scratch_path(spark, 'pkg')}/streamfactor.zip")
        fs = dst.getFileSystem(sc._jsc.hadoopConfiguration())
        fs.copyFromLocalFile(False, True, jvm.org.apache.hadoop.fs.Path(archive), dst)
        target = dst.toString()
    sc.addPyFile(target)
    _SHIPPED.add(app)
