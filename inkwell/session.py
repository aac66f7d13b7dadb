"""Session building, table loading and durable intermediate tables."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "inkwell", master: str | None = None, **conf: str) -> SparkSession:
    """A UTC session with adaptive execution on; further settings override the defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, however its columns are called."""
    taken = {c.lower() for c in df.columns}
    found = f"__{name}"
    while found.lower() in taken:
        found = "_" + found
    return found


@contextlib.contextmanager
def _settings(spark: SparkSession, wanted: dict[str, str]):
    before = {key: spark.conf.get(key) for key in wanted}
    try:
        for key, value in wanted.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def small_batches(spark: SparkSession, rows: int = 1000, size: str = "8m"):
    """Plans that run inside send at most ``rows`` rows and about ``size`` at a time to Python: what workers and the JVM hold of long values
    shrinks with it."""
    return _settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": size})


def tidy(spark: SparkSession):
    """Plans that run inside delete their shuffle files as they end; else these stay until the driver happens to collect its garbage, and the
    steps of a query add up on disk."""
    return _settings(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"})


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset and everything runs on one
    machine, as in tests, a temporary folder that is then set as the checkpoint folder. On a cluster it has to be set."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="inkwell-checkpoints-")
        context.setCheckpointDir(found)
    elif not context.getCheckpointDir():
        context.setCheckpointDir(found)
    return found


_OWNED: list[tuple[SparkSession, str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the application ends."""
    root = f"{shared_dir(spark).rstrip('/')}/inkwell-{spark.sparkContext.applicationId}"
    path = f"{root}/{name}-{uuid.uuid4().hex[:12]}"
    if not _OWNED:
        atexit.register(_remove_all)
    _OWNED.append((spark, path))
    return path


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a path through Hadoop's file systems, so that any scheme that Spark knows works."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release(df: DataFrame) -> None:
    """Delete the files of a table that ``materialize`` wrote, once nothing reads it any more; other tables stay."""
    files = df.inputFiles()
    for spark, path in [x for x in _OWNED if any(f"/inkwell-{x[1].rpartition('/inkwell-')[2]}/" in f for f in files)]:
        remove_path(spark, path)
        _OWNED.remove((spark, path))


def _remove_all() -> None:
    for spark, path in _OWNED:
        try:
            remove_path(spark, path)
        except Exception:  # the session may have ended before
            return


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder as Parquet and return a scan of it.

    The files survive the loss of any executor, keep column statistics for the planner, and are
    deleted when the application ends. The shuffle files behind them go at once.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with tidy(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def local_path(url: str) -> str | None:
    """The path of a file: URL or a plain path; None for other schemes."""
    if url.startswith("file:"):
        return "/" + url[5:].lstrip("/")
    return url if "://" not in url and os.path.isabs(url) else None
