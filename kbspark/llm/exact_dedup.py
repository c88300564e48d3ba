"""Exact deduplication by a tree merge of sorted digest runs.

Every row is reduced to a digest of its normalised text.  Rows are dealt to
``runs`` by a hash of their id, and each run is sorted by digest with one row
per digest.  Rounds then follow the binomial exchange pattern: in each round
the runs whose low bits are set hand their rows to the run with these bits
cleared, which merges ``FAN_IN`` runs and keeps the smallest id of each digest.
A merged run is spread over the cluster by digest, so no task holds a run, and
no key ever meets more than ``FAN_IN`` rows: a group of copies that holds a
third of all rows is already one row per run before anything meets.  The
answers travel down the same tree, so that a hot digest is joined in as many
parts as there are runs.

Only DataFrame functions; no Python on the executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.llm.common import SPACE, written

BITS = 3
FAN_IN = 1 << BITS
#: Rows that one first-level run holds, about; the number of runs grows with the rows.
RUN_ROWS = 1 << 16
LEAST_RUNS_LOG = 2 * BITS
KEY = ("sha", "len", "check")


def normalised(text):
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def digests(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, sha, len, check)``: SHA-256 of the normalised text, and its byte
    length and a second hash that verify it: rows merge only if all agree."""
    norm = df.select(F.col(id_col).cast("long").alias("id"), normalised(F.col(text_col)).alias("norm"))
    return norm.select("id", F.unhex(F.sha2("norm", 256)).alias("sha"),
                       F.octet_length("norm").alias("len"), F.xxhash64("norm").alias("check"))


def tree_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: ``id, sha, keep_id, group_size, kept, copies``.

    Texts are equal when identical after every run of white space becomes one
    space; null text counts as empty.  ``keep_id`` is the smallest id of the
    group.  A null id sorts after all others: it is kept only where the whole
    group has none.  Rows that repeat both id and text tie; ``copies`` counts
    them, and each says ``kept`` if its id is the group's.  An empty table
    gives no rows.  Other columns of ``df`` are not read.
    """
    rows = written(digests(df, id_col, text_col), "digests")
    levels, n = LEAST_RUNS_LOG // BITS, rows.count()
    while (RUN_ROWS << (levels * BITS)) < n:
        levels += 1
    runs = 1 << (levels * BITS)
    rows = rows.withColumn("run", F.pmod(F.xxhash64("id", "len"), F.lit(runs)).cast("int"))
    own = rows.groupBy("run", *KEY).agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"))
    tree = [written(own.sortWithinPartitions("run", *KEY), "run")]
    for level in range(1, levels + 1):
        low = (1 << (level * BITS)) - 1
        merged = (tree[-1].withColumn("run", F.col("run").bitwiseAND(F.lit(~low)))
                  .groupBy("run", *KEY).agg(F.min("least").alias("least"), F.sum("n").alias("n")))
        tree.append(written(merged.sortWithinPartitions("run", *KEY), "run"))
    answer = tree[-1].select("run", *KEY, F.col("least").alias("keep_id"), F.col("n").alias("group_size"))
    for level in range(levels, 0, -1):
        low = (1 << (level * BITS)) - 1
        below = tree[level - 1].select(F.col("run").alias("sub"), F.col("run").bitwiseAND(F.lit(~low)).alias("run"), *KEY)
        answer = written(below.join(answer, ["run", *KEY])
                         .select(F.col("sub").alias("run"), *KEY, "keep_id", "group_size"), "answer")
    return (rows.join(answer, ["run", *KEY])
            .select("id", "sha", "len", "check", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept")))


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with one row of each group of equal texts, all columns as they
    are.  Of rows that repeat both the kept id and the text, any one stays."""
    columns = df.columns
    keep = written(tree_dedup(df, id_col, text_col).where("kept").groupBy("id", *KEY).agg(F.count(F.lit(1)).alias("copies")), "keep")
    keep = keep.select(F.col("id").alias("__kb_id"), F.col("sha").alias("__kb_sha"), F.col("copies").alias("__kb_copies"))
    keyed = df.withColumn("__kb_key", F.unhex(F.sha2(normalised(F.col(text_col)), 256)))

    def of(side: DataFrame) -> DataFrame:
        return keyed.join(side, keyed[id_col].cast("long").eqNullSafe(side["__kb_id"]) & (keyed["__kb_key"] == side["__kb_sha"]), "left_semi")

    out = of(keep.where("__kb_copies = 1")).select(*[F.col(f"`{c}`") for c in columns])
    repeated = keep.where("__kb_copies > 1")
    if not repeated.isEmpty():
        out = out.unionByName(of(repeated).dropDuplicates([id_col, "__kb_key"]).select(*[F.col(f"`{c}`") for c in columns]))
    return out
