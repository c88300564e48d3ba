"""Images and rewritten manuals on shared storage.

Every folder here must be on storage all executors see (the session's
``spark.checkpoint.dir`` family on a cluster).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.session import intermediate_path


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under the session's shared folder."""
    return intermediate_path(spark, name)


def store_images(images: DataFrame, root: str, order: tuple[str, ...] = ("doc_id", "img_idx")) -> DataFrame:
    """Image bytes under ``{filepath}/{filepath}_{filename}``, kept as
    Parquet rows (path, content) partitioned by ``filepath``; re-ingesting a
    folder overwrites only its partitions (dynamic partition overwrite).  An
    image replaces an earlier one (in ``order``) of the same path."""
    path = F.concat(F.col("filepath"), F.lit("/"), F.col("filepath"), F.lit("_"), F.col("filename")).alias("path")
    rows = (images.select("filepath", path, "content", F.struct(*order).alias("_order"))
            .groupBy("filepath", "path").agg(F.max_by("content", "_order").alias("content")))
    # by folder, so that a task writes few folders; a large one takes several tasks
    (rows.hint("rebalance", "filepath").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("filepath").parquet(root))
    return rows.sparkSession.read.parquet(root)


def write_rewritten(paragraphs: DataFrame, names: DataFrame, root: str) -> DataFrame:
    """The rewritten manuals as one table of paragraphs ``(out_name,
    para_idx, text)``, all of a manual's in one file and in order; returns each
    manual read back whole."""
    rows = (paragraphs.join(names, "doc_id").select("out_name", "para_idx", "text")
                      .repartition("out_name").sortWithinPartitions("out_name", "para_idx"))
    rows.write.mode("overwrite").option("compression", "zstd").parquet(root)
    lines = F.array_sort(F.collect_list(F.struct("para_idx", "text")))
    return (rows.sparkSession.read.schema(rows.schema).parquet(root).groupBy("out_name")
            .agg(F.array_join(F.transform(lines, lambda x: x["text"]), "\n").alias("text")))


def output_name(path_col) -> F.Column:
    """``{stem}_data``: the input file name without its extension, plus ``_data``."""
    base = F.regexp_extract(path_col, r"([^/]+)$", 1)
    return F.concat(F.regexp_replace(base, r"\.[^./]+$", ""), F.lit("_data"))
