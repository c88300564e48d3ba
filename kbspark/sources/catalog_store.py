"""The stored catalogue (C4-C6): versioned Parquet folders behind a manifest.

Parquet has no DELETE or UPDATE.  A change writes the next rows of the folders
(``filepath``) it touches under a new version, and a manifest that names the
version of every folder; folders it does not touch keep their files.  Readers
follow the file ``CURRENT`` to one manifest.  It is replaced by a single rename
when all else is written, so a reader sees the old catalogue or the new one,
and a job that fails before leaves the old one in place.

    root/data/version=V/filepath=F/   rows of one folder, written once
    root/manifest/version=V/          (filepath, at): the version that holds each folder
    root/CURRENT                      the version that readers follow
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kbspark.operators.joins import materialize, maybe_broadcast, measure

COLUMNS = ("image_row", "filename", "content_type", "title", "description", "assistant_id", "filepath")
# Folders of a manifest up to which a reader holds their names itself.
LOCAL_FOLDERS = 10_000


def _path(spark: SparkSession, *parts: str):
    path = spark._jvm.org.apache.hadoop.fs.Path("/".join(p.rstrip("/") for p in parts))
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def current_version(spark: SparkSession, root: str) -> int:
    path, fs = _path(spark, root, "CURRENT")
    stream = fs.open(path)
    try:
        return int(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def switch(spark: SparkSession, root: str, version: int) -> None:
    """Make readers follow ``version``: one rename over ``CURRENT``."""
    fresh, fs = _path(spark, root, f".CURRENT-{uuid.uuid4().hex}")
    out = fs.create(fresh, False)
    out.write(bytearray(str(version).encode()))
    out.close()
    path, _ = _path(spark, root, "CURRENT")
    options = spark._jvm.org.apache.hadoop.fs.Options.Rename
    over = spark._sc._gateway.new_array(options, 1)
    over[0] = options.OVERWRITE
    spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), spark._jsc.hadoopConfiguration()).rename(fresh, path, over)


def _write_version(rows: DataFrame, kept: DataFrame | None, root: str, version: int) -> None:
    """Rows of some folders as ``version``, and its manifest with the folders
    ``kept(filepath, at)`` beside them.  Large folders take several tasks."""
    data = f"{root}/data/version={version}"
    rows.select(*COLUMNS).hint("rebalance", "filepath").write.mode("errorifexists").option("compression", "zstd").partitionBy("filepath").parquet(data)
    stored = rows.sparkSession.read.schema(rows.select(*COLUMNS).schema).parquet(data)
    manifest = stored.select("filepath").distinct().select("filepath", F.lit(version).cast("long").alias("at"))
    if kept is not None:
        manifest = kept.unionByName(manifest)
    manifest.write.mode("errorifexists").parquet(f"{root}/manifest/version={version}")


def save_catalog(catalog: DataFrame, root: str) -> None:
    """Write a whole catalogue to a new store, as version 0."""
    _write_version(catalog, None, root, 0)
    switch(catalog.sparkSession, root, 0)


def _manifest(spark: SparkSession, root: str, schema, version: int) -> DataFrame:
    kind = T.StructType([T.StructField("filepath", schema["filepath"].dataType), T.StructField("at", T.LongType())])
    return spark.read.schema(kind).parquet(f"{root}/manifest/version={version}")


def load_catalog(spark: SparkSession, root: str, schema, version: int | None = None) -> DataFrame:
    """The stored catalogue, current or of one version; ``schema`` types its
    columns (folder names would otherwise be read as numbers where they look
    like some)."""
    manifest = _manifest(spark, root, schema, current_version(spark, root) if version is None else version)
    chosen = manifest.select(F.col("filepath").alias("__kb_folder"), F.col("at").alias("__kb_at"))
    size = measure(chosen)
    if size.rows <= LOCAL_FOLDERS:  # a local table leaves the data files the only source: input_file_name() works
        chosen = F.broadcast(spark.createDataFrame(chosen.collect(), chosen.schema))
    else:
        chosen, _ = maybe_broadcast(chosen, size)
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("version", T.LongType())])).parquet(f"{root}/data")
    return (rows.join(chosen, (F.col("version") == F.col("__kb_at")) & F.col("filepath").eqNullSafe(F.col("__kb_folder")))
            .select(*[f.name for f in schema.fields]))


def replace_folders(spark: SparkSession, root: str, schema, touched: DataFrame, change, publish: bool = True) -> int:
    """Rewrite the folders named by ``touched(filepath)``: ``change`` maps the
    whole current catalogue to its next version, of which only rows in touched
    folders are written.  Returns the new version; readers follow it unless
    ``publish`` is false (a branch beside the current one)."""
    folders = materialize(touched.select("filepath").distinct())
    few, _ = maybe_broadcast(folders)
    base = current_version(spark, root)
    after = change(load_catalog(spark, root, schema, base)).select(*COLUMNS).join(few, "filepath", "left_semi")
    kept = _manifest(spark, root, schema, base).join(few, "filepath", "left_anti")
    version = next_version(spark, root)
    _write_version(after, kept, root, version)
    if publish:
        if current_version(spark, root) != base:
            raise RuntimeError(f"another change was published since version {base}; version {version} is left unpublished")
        switch(spark, root, version)
    return version


def next_version(spark: SparkSession, root: str) -> int:
    """One more than any version begun, finished or not."""
    path, fs = _path(spark, root, "data")
    return 1 + max(int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(path) if s.getPath().getName().startswith("version="))


def remove_unused(spark: SparkSession, root: str, schema) -> list[int]:
    """Delete the versions that no folder of the current manifest uses (failed
    jobs, branches, changes since replaced); no reader may be at an older one."""
    version = current_version(spark, root)
    used = {version, *(r["at"] for r in _manifest(spark, root, schema, version).select("at").distinct().collect())}
    gone = []
    for s in _path(spark, root, "data")[1].listStatus(_path(spark, root, "data")[0]):
        name = s.getPath().getName()
        if name.startswith("version=") and int(name.split("=")[1]) not in used:
            gone.append(int(name.split("=")[1]))
    for v in gone:
        for part in ("data", "manifest"):
            path, fs = _path(spark, root, part, f"version={v}")
            fs.delete(path, True)
    return sorted(gone)
