"""Session defaults and durable intermediate tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", app: str = "tapeweave", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and single-machine runs; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir`` of the session.

    Only a local master may go without it; there a private folder is made and removed
    at exit. On a cluster a machine-local folder would be lost with its executor.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="tapeweave-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


_staged: list[str] = []

_SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock = threading.Lock()
_writers: list[str] = []


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Writes begun inside remove their shuffle files when they end, not when the driver next collects garbage.

    Several threads may be inside at once; the session's own setting is back when the last has left.
    """
    with _lock:
        _writers.append(_writers[0] if _writers else spark.conf.get(_SHUFFLE_CLEANUP, "false"))
        spark.conf.set(_SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        with _lock:
            before = _writers.pop()
            if not _writers:
                spark.conf.set(_SHUFFLE_CLEANUP, before)


def stage(df: DataFrame) -> tuple[DataFrame, str]:
    """Write ``df`` once to the shared folder; returns the stored frame and its path."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    with _shuffles_dropped(spark):
        df.write.parquet(path)
    _staged.append(path)
    return spark.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame) -> DataFrame:
    """The stored form of ``df``, for frames that several later steps read.

    The written table keeps column pruning and size statistics, cuts the lineage, and does not
    depend on any executor staying alive. ``drop_staged`` removes it when it is no longer needed.
    """
    return stage(df)[0]


def materialize_all(frames: dict) -> dict:
    """``materialize`` of several independent frames at once, so that one's last tasks don't hold up the next."""
    with ThreadPoolExecutor(max_workers=max(1, len(frames))) as pool:
        return dict(zip(frames, pool.map(materialize, frames.values())))


def require_rows(df: DataFrame, why: str = "no series gave a labelled sample") -> DataFrame:
    """``df``, a stored frame, if it has a row; raises otherwise."""
    if df.isEmpty():
        raise ValueError(why)
    return df


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a table folder through the file system that owns it."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def drop_staged(spark: SparkSession) -> None:
    """Remove all intermediate tables this process has written."""
    while _staged:
        drop_path(spark, _staged.pop())


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def child_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it does not exist."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in files.listStatus(target)] if files.exists(target) else []


def touch_path(spark: SparkSession, path: str) -> None:
    """An empty file."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True).close()
