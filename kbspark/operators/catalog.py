"""Catalogue maintenance (C2-C11): insert-or-ignore, id lookup, append,
scoped delete, re-ingest plans, delete worklist, integrity audit, first-row
lookups with defaults, caption worklist.

Parquet has no DELETE/UPDATE: every operator returns the next version of a
table as a DataFrame; persisting it is a dynamic partition overwrite by
``filepath`` (see ``kbspark.sources.catalog_store``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kbspark.operators.joins import materialize, maybe_broadcast

# Bytes of captions up to which they are broadcast.
CAPTION_BYTES = 16 * 1024 * 1024
# Fixed values of the reference: lookup defaults.
DEFAULT_TITLE = "sem titulo"
DEFAULT_DESCRIPTION = "sem descricao"
DEFAULT_FILENAME = ""


def sequential_ids(df: DataFrame, order_col, start: int, out: str = "id") -> DataFrame:
    """Consecutive ids ``start+1, start+2, …`` in ``order_col`` order (a name
    or list of names) without a single-partition window over the data:
    range-partition by the order, number rows inside each partition, add the
    row count of all earlier partitions (a frame of one row per partition).

    The partitioned frame is written before counts and rows are taken from it:
    planned twice, its sampled bounds and coalesced partitions would differ."""
    order = [order_col] if isinstance(order_col, str) else list(order_col)
    parts = materialize(df.repartitionByRange(*order).withColumn("_pid", F.spark_partition_id()))
    parts = parts.withColumn("_rn", F.row_number().over(Window.partitionBy("_pid").orderBy(*order)))
    counts = parts.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    # one row per partition: the running total is a window over a tiny frame
    offsets = counts.select("_pid", (F.sum("_n").over(Window.orderBy("_pid")) - F.col("_n")).alias("_off"))
    return (parts.join(F.broadcast(offsets), "_pid")
                 .withColumn(out, F.lit(start) + F.col("_off") + F.col("_rn"))
                 .drop("_pid", "_rn", "_off"))


def _scalar(df: DataFrame, expr) -> object:
    return df.select(expr.alias("v")).first()["v"]


def insert_or_ignore_assistants(existing: DataFrame, batch: DataFrame, order_col: str) -> DataFrame:
    """``INSERT OR IGNORE`` on the unique key: existing rows stay, the
    first batch row per new key is inserted with the next AUTOINCREMENT ids."""
    firsts = (batch.groupBy("assistant_key")
                   .agg(F.min_by("name", order_col).alias("name"), F.min(order_col).alias("_ord")))
    new = firsts.join(existing.select("assistant_key"), "assistant_key", "left_anti")
    start = _scalar(existing, F.coalesce(F.max("id"), F.lit(0)))
    ins = sequential_ids(new, "_ord", int(start)).select("id", "name", "assistant_key")
    return existing.select("id", "name", "assistant_key").unionByName(ins)


def resolve_assistant_ids(rows: DataFrame, assistants: DataFrame, key_col: str = "assistant_key",
                          out: str = "assistant_id") -> DataFrame:
    """Surrogate id by unique key (NULL when absent)."""
    a, _ = maybe_broadcast(assistants.select(F.col("assistant_key").alias(key_col), F.col("id").alias(out)))
    return rows.join(a, key_col, "left")


def append_images(catalog: DataFrame, new_images: DataFrame, assistants: DataFrame,
                  captions: DataFrame | None = None, order=("doc_id", "img_idx")) -> DataFrame:
    """C4: append extracted images.  ``new_images``: (filepath, filename,
    content_type, title, assistant_key, order columns); the stored filename gets the
    ``{filepath}_`` prefix; description comes from ``captions`` (filename,
    description) when supplied, else NULL."""
    rows = new_images.withColumn("filename", F.concat(F.col("filepath"), F.lit("_"), F.col("filename")))
    if captions is not None:
        # captions grow with the images: only a small set passes through the driver
        cap, _ = maybe_broadcast(captions.select("filename", F.col("description").alias("_cap")), max_bytes=CAPTION_BYTES)
        rows = rows.join(cap, "filename", "left").withColumn("description", F.col("_cap")).drop("_cap")
    else:
        rows = rows.withColumn("description", F.lit(None).cast("string"))
    rows = resolve_assistant_ids(rows, assistants)
    start = _scalar(catalog, F.coalesce(F.max("image_row"), F.lit(0)))
    rows = sequential_ids(rows, list(order), int(start), out="image_row")
    cols = ["image_row", "filepath", "filename", "content_type", "title", "description", "assistant_id"]
    return catalog.select(*cols).unionByName(rows.select(*cols))


def delete_images(catalog: DataFrame, requests: DataFrame, assistants: DataFrame, by_filepath: bool = True) -> DataFrame:
    """Drop the images of (assistant key, filepath) requests — both must
    match the row (v2); v1 drops all of an assistant's images.  Unknown keys
    delete nothing."""
    req = requests.join(assistants.select(F.col("assistant_key"), F.col("id").alias("assistant_id")), "assistant_key")
    keys = ["assistant_id", "filepath"] if by_filepath else ["assistant_id"]
    req, _ = maybe_broadcast(req.select(*keys).distinct())
    return catalog.join(req, keys, "left_anti")


def reingest(catalog: DataFrame, new_images: DataFrame, assistants: DataFrame, requests: DataFrame,
             cleanup: bool, captions: DataFrame | None, order=("doc_id", "img_idx")) -> DataFrame:
    """(cleanup, captions) -> untouched / delete+insert without captions /
    append with captions (duplicates) / delete+insert with captions."""
    if not cleanup and captions is None:
        return catalog
    base = delete_images(catalog, requests, assistants) if cleanup else catalog
    return append_images(base, new_images, assistants, captions, order)


def delete_worklist(catalog: DataFrame, assistants: DataFrame, keys: DataFrame, stored_paths: DataFrame) -> DataFrame:
    """Filenames of the requested assistants' images (inner equi-join),
    kept only where a stored file exists (semi-join)."""
    k, _ = maybe_broadcast(keys.select("assistant_key").distinct())
    a = assistants.join(k, "assistant_key").select(F.col("id").alias("assistant_id"), "assistant_key")
    a, _ = maybe_broadcast(a)
    rows = catalog.join(a, "assistant_id").select("assistant_key", "filename")
    return rows.join(stored_paths.select("filename"), "filename", "left_semi")


def integrity_audit(images: DataFrame, assistants: DataFrame) -> DataFrame:
    """Violations of the tables' constraints as rows (check, subject, n)."""
    def nn(df, table, col):
        return (df.where(F.col(col).isNull()).agg(F.count(F.lit(1)).alias("n"))
                  .where(F.col("n") > 0)
                  .select(F.lit(f"not_null:{table}.{col}").alias("check"), F.lit(None).cast("string").alias("subject"), "n"))
    parts = [nn(images, "images", c) for c in ("filepath", "filename", "content_type")]
    parts += [nn(assistants, "assistant", c) for c in ("name", "assistant_key")]
    parts.append(assistants.groupBy("assistant_key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
                 .select(F.lit("unique:assistant.assistant_key").alias("check"), F.col("assistant_key").alias("subject"), "n"))
    parts.append(assistants.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
                 .select(F.lit("unique:assistant.id").alias("check"), F.col("id").cast("string").alias("subject"), "n"))
    fk = (images.where(F.col("assistant_id").isNotNull())
                .join(assistants.select(F.col("id").alias("assistant_id")).distinct(), "assistant_id", "left_anti")
                .groupBy("assistant_id").agg(F.count(F.lit(1)).alias("n"))
                .select(F.lit("fk:images.assistant_id").alias("check"), F.col("assistant_id").cast("string").alias("subject"), "n"))
    parts.append(fk)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def first_by(catalog: DataFrame, key: str, cols: list[str], order_col: str = "image_row") -> DataFrame:
    """First row per key in catalogue order (the reference's ``fetchone``),
    as one partial aggregate (no window, no sort of the catalogue)."""
    s = F.min_by(F.struct(*[F.col(c) for c in cols]), F.col(order_col)).alias("_first")
    return catalog.groupBy(key).agg(s).select(key, *[F.col(f"_first.{c}").alias(c) for c in cols])


def lookup_description(requests: DataFrame, catalog: DataFrame, req_col: str = "filename") -> DataFrame:
    """(title, description) of the first row with that filename; the
    default pair only when no row exists (a NULL found stays NULL)."""
    first = first_by(catalog, "filename", ["title", "description"]).withColumn("_hit", F.lit(True))
    j = requests.join(first.withColumnRenamed("filename", req_col), req_col, "left")
    return (j.withColumn("title", F.when(F.col("_hit"), F.col("title")).otherwise(F.lit(DEFAULT_TITLE)))
             .withColumn("description", F.when(F.col("_hit"), F.col("description")).otherwise(F.lit(DEFAULT_DESCRIPTION)))
             .drop("_hit"))


def lookup_filename_by_title(requests: DataFrame, catalog: DataFrame, req_col: str = "title") -> DataFrame:
    """Filename of the first row with exactly that title, else ''."""
    first = first_by(catalog.where(F.col("title").isNotNull()), "title", ["filename"]).withColumn("_hit", F.lit(True))
    j = requests.join(first.withColumnRenamed("title", req_col), req_col, "left")
    return (j.withColumn("filename", F.when(F.col("_hit"), F.col("filename")).otherwise(F.lit(DEFAULT_FILENAME)))
             .drop("_hit"))


def caption_worklist(catalog: DataFrame, captions: DataFrame | None = None) -> DataFrame:
    """C11: catalogue rows still without description and without a supplied caption."""
    todo = catalog.where(F.col("description").isNull())
    if captions is not None:
        todo = todo.join(captions.select("filename").distinct(), "filename", "left_anti")
    return todo
