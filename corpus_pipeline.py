"""A training corpus from ``documents``: toxic documents go, then exact copies,
then near copies, and what stays is packed into training sequences.

Each stage takes ``(spark, docs, sf_dir)``; all but the last return the kept
rows with the columns of ``docs``.  Every stage's result is written to the
shared folder and read again, so a lost executor costs no earlier stage.

Null texts count as empty and are clean; equal texts, empty ones among them,
leave one row (the smallest id; a null id counts as larger than any), rows with
a null id are no near copies, and every row that is left is packed, with the end
id alone where its text is empty.  Of near copies with equal smallest ids one
stays.  Texts of any length are read whole, rows that repeat are judged each,
extra columns are kept up to the last stage, and an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.llm import exact_dedup, jaccard_join, packing, toxicity
from kbspark.llm.common import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised classifier rejects go."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return jaccard_join.drop_near_copies(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of the kept documents lies in the training sequences."""
    return packing.pack_documents(docs).select(
        F.col("id").alias("doc_id"), "piece", "start", "length", F.col("crc").alias("ids_crc32"), "sequence_id", "offset")


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_exact_copies), ("ngram_jaccard", drop_near_copies), ("best_fit_packing", pack)]

#: SQL cannot express the classifier or the tokenizer; tests hold the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the whole ``documents`` table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
