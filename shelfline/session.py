"""Session helpers: local test sessions and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: str = "8", app: str = "shelfline") -> SparkSession:
    """A session for tests and benchmarks.  Clusters bring their own session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can see, as named by ``spark.checkpoint.dir``.

    Only a local-mode session may fall back to a folder on this machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    made = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; never reused, never overwritten."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df, label: str):
    """Write ``df`` once to the shared folder and return a scan of it.

    Used where several jobs read the same derived table: lineage is cut by a
    replicated table rather than by executor-local blocks, so losing an executor
    costs nothing but the tasks it was running.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_PUBLISHED: dict[tuple, str] = {}


def _hadoop_path(spark: SparkSession, path: str):
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def source_identity(spark: SparkSession, paths: list[str]) -> tuple:
    """Path, modification time and bytes of each source: changes when a source does."""
    out = []
    for path in paths:
        found, fs = _hadoop_path(spark, path)
        out.append((path, fs.getFileStatus(found).getModificationTime(), fs.getContentSummary(found).getLength()))
    return tuple(out)


def published(spark: SparkSession, name: str, sources: list[str], build):
    """A derived table that several jobs of one application read, written once.

    The first caller writes it below the shared folder; later callers open the
    same files, or write again if a source changed or the folder was cleared.
    """
    key = (spark.sparkContext.applicationId, name, source_identity(spark, sources))
    path = _PUBLISHED.get(key)
    if path is not None:
        marker, fs = _hadoop_path(spark, f"{path}/_SUCCESS")
        if fs.exists(marker):
            return spark.read.parquet(path)
    df = build()
    path = scratch_path(spark, "published")
    df.write.mode("errorifexists").parquet(path)
    _PUBLISHED[key] = path
    return spark.read.schema(df.schema).parquet(path)
