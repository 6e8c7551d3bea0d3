"""Session helpers: local sessions for tests, and the folder for written intermediates."""

from __future__ import annotations

import atexit
import functools
import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", name: str = "ledgerloom") -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@functools.cache
def _local_base() -> str:
    """One temporary folder for this process, removed when it ends."""
    folder = tempfile.TemporaryDirectory(prefix="ledgerloom-", ignore_cleanup_errors=True)
    atexit.register(folder.cleanup)
    return folder.name


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder under the shared checkpoint folder the session names.

    The folder comes from ``spark.checkpoint.dir``. Where that is unset, as in
    local tests, a temporary folder is used; a cluster has to set it, because a
    machine-local folder is not visible to the other executors.
    """
    base = spark.conf.get(CHECKPOINT_DIR, None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder all executors can reach")
        base = _local_base()
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def lineage_cut(df, purpose: str = "stage"):
    """Write ``df`` to the shared folder and read it back.

    Unlike an executor-local checkpoint this survives the loss of executors.
    """
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.parquet(path)
