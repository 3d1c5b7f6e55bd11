"""Session settings and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on; all can be changed on a running session.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot key of a join even when the split costs one more shuffle afterwards.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Above this size the JVM does not compile a generated method; split code runs faster then.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Streaming state on disk with changelogs, so that it may outgrow executor memory.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


# Bytes of rows that Spark hands to a Python worker at a time, see ``short_batches``.
BATCH_BYTES, BATCH_KEY = 1 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session; static ones stay as they are."""
    for key, value in RUNTIME_SETTINGS.items():
        if spark.conf.get(key, None) != value and spark.conf.isModifiable(key):
            spark.conf.set(key, value)
    return spark


def local_session(cores: str | int = "*", app: str = "herdwatch", **settings: str) -> SparkSession:
    """A local session for tests and the bench."""
    n = os.cpu_count() if cores == "*" else int(cores)
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(n))
        # No call-site bookkeeping for every column expression (a static setting).
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in {**RUNTIME_SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir`` of the session.

    Only a local session without that setting falls back to a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="herdwatch-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_folder(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that no other run uses."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def short_batches(spark: SparkSession) -> None:
    """Rows go to Python in Arrow batches of about ``BATCH_BYTES``, unless the session has a bound of its own.

    Spark ends a batch after 10,000 rows otherwise. Of long texts or lists these are tens of MB, which an executor holds
    outside its heap while the buffers grow, and its C library keeps for each thread when they are freed.
    """
    if spark.conf.get(BATCH_KEY, None) is None:
        spark.conf.set(BATCH_KEY, str(BATCH_BYTES))


# Folders that the running piece of work keeps for itself; None outside ``dropped_afterwards``.
_own: ContextVar[list[str] | None] = ContextVar("own", default=None)


def write_and_read(df: DataFrame, label: str) -> DataFrame:
    """Store a result as a Parquet table in the shared folder and read it back."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.parquet(path)
    if _own.get() is not None:
        _own.get().append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def dropped_afterwards(spark: SparkSession) -> Iterator[None]:
    """Tables that are stored inside are dropped at the end, so what is returned must have been stored by ``result_of``."""
    token = _own.set([])
    try:
        yield
    finally:
        folders = _own.get()
        _own.reset(token)
        from .sources.commits import files_of

        files = files_of(spark, shared_folder(spark))
        for folder in folders:
            files.delete(folder.rsplit("/", 1)[1])


def result_of(df: DataFrame, label: str = "result") -> DataFrame:
    """Stores a table that outlives ``dropped_afterwards``."""
    token = _own.set(None)
    try:
        return write_and_read(df, label)
    finally:
        _own.reset(token)


def materialize(df: DataFrame) -> DataFrame:
    """Compute a result that several later steps use, and keep it in the shared folder.

    Meant for results much smaller than their input (aggregates, clusters). Stored as a table
    rather than by ``checkpoint()``, which computes its last stage twice. A lost executor
    costs nothing: the rows are read back from the folder.
    """
    return write_and_read(df, "kept")
