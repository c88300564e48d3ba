"""Spelling variants: words that differ from a more frequent word by one
inserted, deleted or replaced code point.

Two words at one error agree in the first or in the last half of either.  So
each word is sent, under its first and under its last half as a word of its
length or one more or less would cut it, to a block; words that share a half
meet in one.  A block's words make a bidirectional FM-index over the delimited
vocabulary, and its queries run one search of the scheme: their half is matched
exactly, then extended over the other half allowing one error.  The second
search leaves out what the first one finds, so every pair is found once.
Blocks hold a bounded number of words; a half with more is split, and its
queries visit each part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbspark.llm.common import written
from kbspark.llm.fm_index import Vocabulary, one_error

RUN = r"[A-Za-zÀ-ÿ]+"
LEAST_CHARS = 5
LEAST_COUNT = 3
#: A word's form is at least so many times as frequent.
RATIO = 2
#: Rows of one block, about (a word has three rows for each half).
BLOCK_ROWS = 40_000
#: Symbols of the queries searched at a time.
CHUNK = 1 << 17


def letter_runs(text: Column) -> Column:
    """Maximal runs of letters, A-Z lower-cased."""
    runs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(RUN), F.lit(0))
    return F.transform(runs, lambda r: F.translate(r, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def count_words(words: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT) -> DataFrame:
    """``(word, n)`` of the words (one row per occurrence, column ``word``) that
    are long and frequent enough.  Null words are none."""
    return (words.where(F.length("word") >= least_chars).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count))


def _dealt(words: DataFrame, block_rows: int) -> DataFrame:
    """``(block, part, side, key, word, n, indexed, asked)``: words in the
    blocks of their halves.  ``key`` stands for the half, ``side`` is where the
    error may lie."""
    halves = F.explode(F.expr("""flatten(transform(sequence(length(word) - 1, length(word) + 1), t -> array(
        struct(1 as side, t as chars, left(word, t div 2) as half),
        struct(0 as side, t as chars, right(word, t - t div 2) as half))))""")).alias("h")
    rows = words.select("word", "n", halves).select(
        F.col("h.side").alias("side"), F.xxhash64("h.side", "h.chars", "h.half").alias("key"), "word", "n",
        (F.col("h.chars") == F.length("word")).alias("asked"))
    blocks = max(1, -(-3 * words.count() // block_rows))
    rows = rows.withColumn("block", F.expr(f"int(pmod(xxhash64(key), {blocks}) * 2 + side)"))
    large = written(rows.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / F.lit(2 * block_rows)).cast("int").alias("parts")).where("parts > 1"), "large")
    if large.isEmpty():
        return rows.withColumn("part", F.lit(0)).withColumn("indexed", F.lit(True))
    own = F.expr("pmod(hash(word), coalesce(parts, 1))")
    return (rows.join(large, "block", "left").withColumn("own", own)
            .withColumn("part", F.explode(F.when(F.col("asked"), F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).otherwise(F.array("own"))))
            .withColumn("indexed", F.col("part") == F.col("own")).drop("own", "parts"))


def _points(words: list[str]) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)


def search_block(words: list[str], counts: np.ndarray, keys: np.ndarray, indexed: np.ndarray, asked: np.ndarray, side: int) -> tuple[list[str], list[str], np.ndarray]:
    """``(word, near word, its count)`` of one block's queries."""
    _, place, held = np.unique(keys, return_inverse=True, return_counts=True)
    met = np.flatnonzero(held[place] > 1)  # a half of one word alone has no pair
    count_of = {words[i]: counts[i] for i in met[indexed[met]]}
    known = sorted(count_of)
    queries = {words[i] for i in met[asked[met]]}
    if not known or not queries:
        return [], [], np.empty(0, dtype=np.int64)
    lengths = np.fromiter(map(len, known), dtype=np.int64, count=len(known))
    points = _points(known)
    starts = np.cumsum(lengths) - lengths
    index = Vocabulary(points, lengths)
    inside = queries <= count_of.keys()
    by_length: dict[int, list[str]] = {}
    for w in sorted(queries):
        by_length.setdefault(len(w), []).append(w)
    found, near = [], []
    for length, group in by_length.items():
        half = length // 2
        exact = half if side == Vocabulary.RIGHT else length - half
        for at in range(0, len(group), max(1, CHUNK // length)):
            chunk = group[at:at + max(1, CHUNK // length)]
            asked_points = _points(chunk).reshape(len(chunk), length)
            q, w = one_error(index, index.encode(asked_points), exact, side, inside)
            if side == Vocabulary.LEFT:  # the other search finds words that begin alike
                alike = np.ones(len(q), dtype=bool)
                for j in range(half):
                    alike &= points[starts[w] + j] == asked_points[q, j]
                q, w = q[~alike], w[~alike]
            found += [chunk[i] for i in q.tolist()]
            near.append(w)
    near_words = np.concatenate(near).tolist() if near else []
    every = np.fromiter((count_of[w] for w in known), dtype=np.int64, count=len(known))
    return found, [known[i] for i in near_words], every[near_words]


def near_words(words: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(word, near, near_n)``: all ordered pairs of distinct words of
    ``words(word, n)`` that differ by one inserted, deleted or replaced code
    point, each once.  Words have two code points or more."""

    def search(rows: pa.Table) -> pa.Table:
        column = {name: rows.column(name).to_numpy(zero_copy_only=False) for name in ("n", "key", "indexed", "asked")}
        found, near, n = search_block(rows.column("word").to_pylist(), column["n"], column["key"], column["indexed"], column["asked"],
                                      rows.column("side")[0].as_py())
        return pa.table({"word": pa.array(found, pa.string()), "near": pa.array(near, pa.string()), "near_n": pa.array(n, pa.int64())})

    dealt = _dealt(words, block_rows).select("block", "part", "side", "key", "word", F.col("n").cast("long").alias("n"), "indexed", "asked")
    return dealt.groupBy("block", "part").applyInArrow(search, "word string, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` of every row of ``forms(word, form)``: forms followed to
    the last.  Pointers double each round; forms must not run in circles."""
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = written(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        now = joined.select("word", "root")
        if joined.where("moved").isEmpty():
            return now


def group_variants(words: DataFrame, ratio: int = RATIO, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per row of ``words(word, n)``, whose words are distinct: ``word,
    form, root, n, n_near, form_n``.

    ``n_near`` counts the words at one error.  ``form`` is the most frequent of
    them (ties: the smallest in code-point order) if it is at least ``ratio``
    (above 1) times as frequent, else null, as is ``form_n``; ``root`` is the last form
    reached from the word, the word itself without one.  Words may be of any
    length from two code points on; an empty table gives no rows.
    """
    if ratio <= 1:
        raise ValueError("forms must be more frequent than their words")
    words = written(words.select("word", F.col("n").cast("long").alias("n")), "words")
    best = (near_words(words, block_rows).groupBy("word")
            .agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best")))
    named = words.join(best, "word", "left")
    is_form = -F.col("best.minus") >= ratio * F.col("n")
    named = written(named.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best.near")).alias("form"),
                                 F.when(is_form, -F.col("best.minus")).alias("form_n")), "forms")
    root = roots(named.where("form is not null"))
    return named.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def group_texts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``group_variants`` of the letter runs of whole texts.  Null and empty
    texts have none; texts and runs may be of any length; repeated rows count
    again; other columns are not read."""
    return group_variants(count_words(df.select(F.explode(letter_runs(F.col(text_col))).alias("word"))))
