"""Shared pieces of the training-data operators: written intermediates in the
cluster's shared folder, and connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.session import intermediate_path

#: White space of the text contracts: space, tab, line feed, VT, FF, CR.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the
    lineage, survives lost executors, and gives the planner true sizes."""
    path = intermediate_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has one edge at most to a smaller one, which has none."""
    ends = edges.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    several = ends.where("n > 1").select("a")
    chained = edges.select(F.col("b").alias("a")).join(edges.select("a"), "a", "left_semi")
    return several.unionByName(chained).isEmpty()


def connected_components(edges: DataFrame, what: str = "cc") -> DataFrame:
    """``edges(a, b)`` (longs, any direction, repeats and loops allowed) ->
    ``(node, component)`` with the smallest node of each connected component.

    Alternates large-star and small-star rounds until the edges are stars around
    the smallest nodes; a round writes at most one row per edge, so the table
    never grows.  A hub's edges meet in one key only in a minimum (combined on the
    map side) and in joins against a written table, which Spark may split.
    Null ends are ignored; no edges give no rows.
    """
    cur = written(edges.where("a is not null and b is not null and a <> b")
                  .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), what)
    while not _are_stars(cur):
        # large star: every larger neighbour of u moves to the least of u's neighbourhood
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.first("a")).alias("m")), what)
        large = (both.join(least, both["a"] == least["u"]).where("b > u")
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        cur = written(large, what)
        # small star: u and its smaller neighbours move to the least of these
        least = written(cur.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")), what)
        small = (cur.join(least, cur["a"] == least["u"])
                 .select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                                           F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("e"))
                 .select("e.a", "e.b").where("a <> b").distinct())
        cur = written(small, what)
    return (cur.select(F.col("a").alias("node"), F.col("b").alias("component"))
            .unionByName(cur.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()))
