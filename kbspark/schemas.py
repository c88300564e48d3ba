"""Explicit schemas of the knowledge-base tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ASSISTANTS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("assistant_key", T.StringType(), False),
])

IMAGES = T.StructType([
    T.StructField("image_row", T.LongType(), False),
    T.StructField("filepath", T.StringType(), False),
    T.StructField("filename", T.StringType(), False),
    T.StructField("content_type", T.StringType(), False),
    T.StructField("title", T.StringType(), True),
    T.StructField("description", T.StringType(), True),
    T.StructField("assistant_id", T.LongType(), True),
])

DOC_RUNS = T.StructType([
    T.StructField("doc_id", T.StringType(), False),
    T.StructField("para_idx", T.IntegerType(), False),
    T.StructField("run_idx", T.IntegerType(), False),
    T.StructField("kind", T.StringType(), False),
    T.StructField("text", T.StringType(), True),
    T.StructField("embed_id", T.StringType(), True),
    T.StructField("n_drawings", T.IntegerType(), False),
])

DOC_IMAGES = T.StructType([
    T.StructField("doc_id", T.StringType(), False),
    T.StructField("img_idx", T.IntegerType(), False),
    T.StructField("para_idx", T.IntegerType(), True),
    T.StructField("run_idx", T.IntegerType(), True),
    T.StructField("descr", T.StringType(), True),
    T.StructField("name", T.StringType(), True),
    T.StructField("embed_id", T.StringType(), True),
    T.StructField("ext", T.StringType(), True),
    T.StructField("content_type", T.StringType(), True),
    T.StructField("content", T.BinaryType(), True),
])

MESSAGES = T.StructType([
    T.StructField("thread_id", T.LongType(), True),
    T.StructField("seq", T.LongType(), True),
    T.StructField("id", T.StringType(), True),
    T.StructField("role", T.StringType(), True),
    T.StructField("content", T.ArrayType(T.StructType([
        T.StructField("text", T.StructType([T.StructField("value", T.StringType(), True)]), True)])), True),
    T.StructField("created_at", T.TimestampType(), True),
])

CHUNKS = T.StructType([
    T.StructField("response_id", T.LongType(), True),
    T.StructField("seq", T.IntegerType(), True),
    T.StructField("delta", T.StringType(), True),
    T.StructField("done", T.BooleanType(), True),
    T.StructField("ts", T.TimestampType(), True),
])


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """An empty table with the explicit schema (first load)."""
    return spark.createDataFrame([], schema)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project and cast a frame onto a table schema (missing nullable
    columns become NULL)."""
    cols = []
    for f in schema.fields:
        c = F.col(f.name) if f.name in df.columns else F.lit(None)
        cols.append(c.cast(f.dataType).alias(f.name))
    return df.select(*cols)
