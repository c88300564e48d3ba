"""Session helpers: build a session for tests/bench, read driver tables, and
resolve the shared checkpoint folder from the session configuration."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "kbspark") -> SparkSession:
    """Local session for tests and the bench. On a cluster the session comes
    from the platform; nothing here assumes local mode."""
    builder = (
        SparkSession.builder.master(master).appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("KBSPARK_DRIVER_MEMORY", "16g"))
    )
    if SparkSession.getActiveSession() is None:  # a static setting: named before the session starts
        builder = builder.config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="kbspark-ckpt-"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder (``spark.checkpoint.dir``).

    Only when a local session names none (tests, bench) do we set a fresh
    scratch folder of our own; a configured folder is never replaced, and a
    cluster session without one is an error.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        current = spark.sparkContext.getCheckpointDir()
    if not current:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that all executors share")
        current = tempfile.mkdtemp(prefix="kbspark-ckpt-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(current)
    return current


def intermediate_folder(spark: SparkSession) -> str:
    """Where this application keeps its intermediate tables."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/kbspark-{spark.sparkContext.applicationId}"


def intermediate_path(spark: SparkSession, what: str) -> str:
    """A new folder name for one intermediate table, in the shared folder."""
    return f"{intermediate_folder(spark)}/{what}-{uuid.uuid4().hex}"


# Tables and folders derived from a table folder once per application:
# (application, state of the table folder, name) -> what was built.
_DERIVED: dict[tuple, object] = {}


def folder_state(spark: SparkSession, folder: str) -> tuple:
    """Names, sizes and change times of what a folder holds: differs once a
    table in it has been changed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    entries = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return (folder, *sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in entries))


def derived_once(spark: SparkSession, folder: str, name: str, build):
    """``build()``, kept for this application as long as the tables in
    ``folder`` stay as they are and the intermediates are not cleared."""
    key = (spark.sparkContext.applicationId, folder_state(spark, folder), name)
    if key not in _DERIVED:
        _DERIVED[key] = build()
    return _DERIVED[key]


def clear_intermediates(spark: SparkSession) -> None:
    """Delete this application's intermediate tables; frames that read them are
    of no use afterwards, and what was derived once is built anew."""
    for key in [k for k in _DERIVED if k[0] == spark.sparkContext.applicationId]:
        del _DERIVED[key]
    path = spark._jvm.org.apache.hadoop.fs.Path(intermediate_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


# Sessions that read small test tables (one row group, which one task would
# have to work through alone) name a partition count here; unset, a table keeps
# the scan's own splits.
READ_PARTITIONS = "spark.kbspark.read.partitions"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    parts = spark.conf.get(READ_PARTITIONS, None)
    return df.repartition(int(parts)) if parts else df
