r"""Chat formatting of reply trees.

Messages form trees by ``parent``.  Iterative self-joins by doubling distance
(1, 2, 4, ... steps up) list, for each leaf, all messages on its path to the
root, so a thread of n turns takes about log2(n) joins.  Branches of a tree
are ranked by the sum of their messages' scores, and each chosen path becomes
one text in the template

    <|im_start|>ROLE<|im_sep|>TEXT<|im_end|>\n

Control strings inside roles and texts are escaped reversibly: backslashes are
doubled, and a backslash is put after the first character of every control
string, so that none remains.  The loss mask lists the spans (code points) of
the assistant texts.

Only DataFrame functions; no Python on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kbspark.llm.common import written

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
# Openings of control strings of common chat templates.
CONTROL = r"<(?=\||/?s>|/?SYS>>)|\[(?=/?INST\])"


def escaped(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, CONTROL, r"$0\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def root_paths(messages: DataFrame) -> DataFrame:
    """``(tree, leaf, node, up)``: the messages on each leaf's way to its root,
    ``up`` steps above the leaf.  ``messages(tree, node, parent)``: a message
    whose parent is null or missing in its tree is a root; a cycle has no leaf
    and gives no path.
    """
    nodes = messages.select("tree", "node", "parent")
    up = written(nodes.alias("c").join(nodes.alias("p"), (F.col("c.tree") == F.col("p.tree")) & (F.col("c.parent") == F.col("p.node")))
                 .select(F.col("c.tree").alias("tree"), F.col("c.node").alias("low"), F.col("p.node").alias("high")), "up")
    inner = up.select("tree", F.col("high").alias("node")).distinct()
    paths = written(nodes.join(inner, ["tree", "node"], "left_anti")
                    .select("tree", F.col("node").alias("leaf"), "node", F.lit(0).alias("up")), "paths")
    step = 1
    while True:
        more = written(paths.join(up.withColumnRenamed("low", "node"), ["tree", "node"])
                       .select("tree", "leaf", F.col("high").alias("node"), (F.col("up") + step).alias("up")), "paths")
        if more.isEmpty():
            return paths
        paths = paths.unionByName(more)
        low = up.select("tree", F.col("low"), F.col("high").alias("mid"))
        high = up.select("tree", F.col("low").alias("mid"), "high")
        up = written(low.join(high, ["tree", "mid"]).select("tree", "low", "high"), "up")
        step *= 2


def format_trees(messages: DataFrame, branches: int | None = None) -> DataFrame:
    """One row per chosen path: ``tree, leaf, rank, score, n_turns, formatted,
    loss_spans`` (start and length of each assistant text in ``formatted``).

    ``messages(tree, node, parent, role, text, score)``.  Null roles and texts
    are empty and null scores 0.  Paths of a tree are ranked by the sum of
    scores, ties by the smaller leaf; ``branches`` keeps that many per tree
    (all if None).  ``tree`` and ``node`` are not null and ``node`` is unique
    in its tree; an empty table gives no rows.
    """
    paths = root_paths(messages)
    scored = paths.join(messages.select("tree", "node", F.coalesce(F.col("score"), F.lit(0.0)).alias("s")), ["tree", "node"])
    ranked = (scored.groupBy("tree", "leaf").agg(F.sum("s").alias("score"))
              .withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "leaf"))))
    if branches is not None:
        ranked = ranked.where(F.col("rank") <= branches)
    turn = messages.select("tree", "node", F.coalesce("role", F.lit("")).alias("role"), escaped(F.coalesce("text", F.lit(""))).alias("said"))
    turn = turn.select("tree", "node", "role", "said", F.concat(F.lit(START), escaped(F.col("role")), F.lit(SEP)).alias("head"))
    lines = (paths.join(turn, ["tree", "node"]).join(ranked, ["tree", "leaf"])
             .groupBy("tree", "leaf", "rank", "score")
             .agg(F.sort_array(F.collect_list(F.struct((-F.col("up")).alias("at"), "role", "head", "said"))).alias("turns")))
    full = F.transform("turns", lambda t: F.concat(t["head"], t["said"], F.lit(END)))
    spans = F.aggregate("turns", F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,length:int>>)").alias("spans")),
                        lambda acc, t: F.struct((acc["at"] + F.length(t["head"]) + F.length(t["said"]) + len(END)).alias("at"),
                                                F.when(t["role"] == "assistant",
                                                       F.concat(acc["spans"], F.array(F.struct((acc["at"] + F.length(t["head"])).alias("start"), F.length(t["said"]).alias("length")))))
                                                .otherwise(acc["spans"]).alias("spans")))
    return lines.select("tree", "leaf", "rank", "score", F.size("turns").cast("long").alias("n_turns"),
                        F.array_join(full, "").alias("formatted"), spans["spans"].alias("loss_spans"))


def parse_turns(formatted: Column) -> Column:
    """The ``(role, text)`` turns read back from a formatted conversation."""
    pieces = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda p: p != "")
    return F.transform(pieces, lambda p: F.struct(
        unescaped(F.substring_index(F.substring(p, len(START) + 1, 1 << 30), SEP, 1)).alias("role"),
        unescaped(F.substring(p, F.instr(p, SEP) + len(SEP), F.length(p))).alias("text")))


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substring(formatted, s["start"] + 1, s["length"]))), "")
