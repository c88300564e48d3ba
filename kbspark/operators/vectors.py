"""Vector and TF-IDF similarity (M6-M9).

Vector search (M7, M8, E2, E3) is exact.  The measured question set is cut into
bounded chunks; a few chunks are sent to the tasks, which read the catalogue in
place, once per chunk, skip cells that cannot hold a better row, and send on
their winners only (``vector_scan.py``).  More chunks are cogrouped with
hash-split blocks of the catalogue instead.  Rows near the best are scored again
in a fixed summation order, so equal vectors tie exactly however the data is
split.  No pair list is ever materialised or shuffled: the shuffle carries k
rows per question per task, then a partial aggregate / group-limited window
merges them.

TF-IDF (M9) scores in full only documents that an upper bound lets through.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kbspark.functions.text import explode_computed
from kbspark.operators import tfidf_scan, vector_scan
from kbspark.operators.joins import materialize, maybe_broadcast, measure
from kbspark.operators.match import COSINE_THRESHOLD, MAX_RESULTS


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a, b) -> Column:
    """Dot product in double, a left fold in index order."""
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0).cast("double"), lambda acc, v: acc + v)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a, b, na=None, nb=None) -> Column:
    """M6: cosine of two vectors (norms may be passed in precomputed);
    0 when either norm is 0, NULL when either vector is NULL."""
    na = norm(a) if na is None else _col(na)
    nb = norm(b) if nb is None else _col(nb)
    return F.when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(dot(a, b) / (na * nb))


# Catalogue rows per cogroup block (bounds the table of one task).
BLOCK_ROWS = 65536
# Bytes of one score matrix.
MATRIX_BYTES = vector_scan.MATRIX_BYTES
# A question chunk is copied into every catalogue block, so it is kept no
# larger than a block; more questions make more chunks of the same plan.
QUESTION_CHUNK_BYTES = 32 * 1024 * 1024
# Chunks for which the catalogue is read in place; each goes through the driver.
SCAN_CHUNKS = 8


def question_chunks(q: DataFrame, q_id: str) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """Ids and vectors of ``q(q_id, _qv)`` in bounded chunks, or ``None`` if
    there are more than ``SCAN_CHUNKS``.  A missing vector is a zero vector."""
    n = max(1, math.ceil(measure(q).bytes / QUESTION_CHUNK_BYTES))
    if n > SCAN_CHUNKS:
        return None
    return [_ids_and_vectors(q.where(F.pmod(F.xxhash64(q_id), F.lit(n)) == k).toArrow(), q_id) for k in range(n)]


def _ids_and_vectors(rows: pa.Table, q_id: str) -> tuple[np.ndarray, np.ndarray]:
    column = rows.column("_qv").combine_chunks()
    vectors = vector_scan.vectors_of(column, pc.max(column.value_lengths()).as_py() or 1)
    vectors = np.where(np.isnan(vectors), 0.0, vectors)
    # single precision is sent as such
    return rows.column(q_id).to_numpy(), vectors.astype(np.float32) if column.type.value_type == pa.float32() else vectors


def catalog_grid(q: DataFrame, c: DataFrame, n_rows: int, q_id: str, c_id: str, task, schema: str) -> DataFrame:
    """``task(ids, vectors)`` of every chunk of ``q(q_id, _qv)`` over every
    block of the catalogue ``c``, cogrouped in one plan.  There are as many
    blocks as bound their rows and keep all cores busy, not more: each copies
    the questions once, each chunk the catalogue."""
    n_chunks = max(1, math.ceil(measure(q).bytes / QUESTION_CHUNK_BYTES))
    n_blocks = max(1, math.ceil(n_rows / BLOCK_ROWS), math.ceil(2 * c.sparkSession.sparkContext.defaultParallelism / n_chunks))
    cb = (c.withColumn("_blk", F.pmod(F.xxhash64(F.col(c_id)), F.lit(n_blocks)))
           .withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1)))))
    qb = (q.withColumn("_chunk", F.pmod(F.xxhash64(F.col(q_id)), F.lit(n_chunks)).cast("int"))
           .withColumn("_blk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long")))))

    def meet(rows: pa.Table, asked: pa.Table) -> pa.Table:
        ids, vectors = _ids_and_vectors(asked, q_id)
        return pa.Table.from_batches(task(ids, vectors)(iter(rows.select([c_id, "_tv", "_dv"]).combine_chunks().to_batches())))

    return cb.groupBy("_blk", "_chunk").cogroup(qb.groupBy("_blk", "_chunk")).applyInArrow(meet, schema)


def visited_cells(questions: DataFrame, catalog: DataFrame, *, q_id: str = "question_id", q_vec: str = "q_vec", c_id: str = "image_row",
                  title_vec: str = "title_vec", desc_vec: str = "desc_vec", k: int = MAX_RESULTS, threshold: float = COSINE_THRESHOLD) -> DataFrame:
    """``(cells, visited)`` of an exact search: pairs of a question and a
    catalogue cell, and those that the cells' bounds could not skip."""
    q = materialize(questions.select(F.col(q_id).cast("long").alias(q_id), F.col(q_vec).alias("_qv")))
    c = catalog.select(F.col(c_id).cast("long").alias(c_id), F.col(title_vec).alias("_tv"), F.col(desc_vec).alias("_dv"))
    chunks = question_chunks(q, q_id)
    if chunks is None:
        raise ValueError("cells are counted for question sets of a few chunks only")
    return vector_scan.scan(chunks, c, k, threshold, [q_id, c_id, "score"], count=True).agg(F.sum("cells").alias("cells"), F.sum("visited").alias("visited"))


def _blocked(questions: DataFrame, catalog: DataFrame, *, q_id: str, q_vec: str, c_id: str,
             title_vec: str, desc_vec: str, k: int, threshold: float) -> DataFrame:
    """Exact question x catalogue scoring by numpy blocks.  A question set of
    few chunks is sent to the catalogue's tasks, of a larger one every chunk is
    cogrouped with every catalogue block.  Only each task's per-question winners
    leave it."""
    q = materialize(questions.select(F.col(q_id).cast("long").alias(q_id), F.col(q_vec).alias("_qv")))
    c = catalog.select(F.col(c_id).cast("long").alias(c_id), F.col(title_vec).alias("_tv"), F.col(desc_vec).alias("_dv"))
    chunks = question_chunks(q, q_id)
    if chunks is not None:
        return vector_scan.scan(chunks, c, k, threshold, [q_id, c_id, "score"], matrix_bytes=MATRIX_BYTES)
    schema = f"{q_id} long, {c_id} long, score double"
    return catalog_grid(q, c, c.select(c_id).count(), q_id, c_id, lambda ids, vectors: vector_scan.task(ids, vectors, k, threshold, [q_id, c_id, "score"], matrix_bytes=MATRIX_BYTES), schema)


_VEC_COLS = dict(q_vec="q_vec", title_vec="title_vec", desc_vec="desc_vec")


def best_match(questions: DataFrame, catalog: DataFrame, *, q_id: str = "question_id", c_id: str = "image_row",
               threshold: float = COSINE_THRESHOLD, **cols) -> DataFrame:
    """M7: per question the first catalogue row of maximal score, kept only
    when the score is above the threshold (strict); NULL otherwise."""
    v = {**_VEC_COLS, **cols}
    wins = _blocked(questions, catalog, q_id=q_id, c_id=c_id, k=1, threshold=threshold, **v)
    best = (wins.groupBy(q_id)
                .agg(F.max_by(F.struct(F.col(c_id), F.col("score")), F.struct(F.col("score"), -F.col(c_id))).alias("_b"))
                .select(q_id, F.col(f"_b.{c_id}").alias(c_id), F.col("_b.score").alias("score")))
    return questions.select(q_id).join(best, q_id, "left")


def nearest(questions: DataFrame, catalog: DataFrame, *, q_id: str = "question_id", c_id: str = "image_row",
            k: int = MAX_RESULTS, threshold: float = COSINE_THRESHOLD, **cols) -> DataFrame:
    """M8: the k best catalogue rows per question above the threshold (score
    desc, ties in catalogue order): per-block top k, then ``row_number() <= k``
    (planned with a partial per-partition limit before its shuffle)."""
    v = {**_VEC_COLS, **cols}
    pairs = _blocked(questions, catalog, q_id=q_id, c_id=c_id, k=k, threshold=threshold, **v)
    w = Window.partitionBy(q_id).orderBy(F.col("score").desc(), F.col(c_id).asc())
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def best_scores(questions: DataFrame, catalog: DataFrame, *, q_id: str = "question_id", c_id: str = "image_row",
                **cols) -> DataFrame:
    """(q_id, best): each question's highest score over the whole catalogue."""
    v = {**_VEC_COLS, **cols}
    m = _blocked(questions, catalog, q_id=q_id, c_id=c_id, k=1, threshold=-math.inf, **v)
    return m.groupBy(q_id).agg(F.max("score").alias("best"))


# ---------------------------------------------------------------- M9: TF-IDF
# Sums differ in their last bits with their order; scores are rounded before
# they are ranked, so that equal documents tie.
SCORE_DIGITS = 9


def term_counts(docs: DataFrame, doc_id: str, tokens: str) -> DataFrame:
    """Long form (doc_id, token, tf)."""
    return (docs.select(doc_id, explode_computed(tokens).alias("token")).where(F.col("token") != "")
                .groupBy(doc_id, "token").agg(F.count(F.lit(1)).alias("tf")))


def tfidf(tf: DataFrame, doc_id: str, idf: DataFrame) -> DataFrame:
    """Long form (doc_id, token, w) with L2-normalised tf*idf weights from
    ``tf(doc_id, token, tf)`` and ``idf(token, idf)``."""
    w = tf.join(idf, "token").withColumn("w", F.col("tf") * F.col("idf"))
    # the norm as a window over the document (one row per distinct token of
    # it), not a self-join that would tokenise the documents twice
    n = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(doc_id)))
    return w.select(doc_id, "token", (F.col("w") / n).alias("w"))


def tfidf_best_match(questions: DataFrame, corpus: DataFrame, *, q_id: str, q_tokens: str, d_id: str, d_tokens: str,
                     threshold: float = COSINE_THRESHOLD) -> DataFrame:
    """M9: TF-IDF cosine best match per question (> threshold), exact.

    idf = ln((1+N)/(1+df)) + 1 over the corpus, tf = raw count, vectors
    L2-normalised.  A bounded question set goes to the corpus' tasks, which
    pass on the documents whose upper bound can reach a question's best score
    so far (``tfidf_scan.py``).  Beyond that bound candidates come from the
    question's prefix tokens: its highest-weight tokens up to the point where
    the remaining weights' norm drops below the threshold; a document sharing
    none of them cannot exceed the threshold (Cauchy-Schwarz).  Candidates are
    scored exactly in either case.  The threshold must be positive."""
    n_docs = corpus.select(F.count(F.lit(1)).cast("double")).scalar()
    # distinct tokens of each document, counted on the map side first: the
    # shuffle and the written table grow with the vocabulary
    dtok = corpus.select(d_id, explode_computed(F.array_distinct(d_tokens)).alias("token")).where(F.col("token") != "")
    df = materialize(dtok.groupBy("token").agg(F.count(F.lit(1)).alias("df")))

    def idf(c: Column) -> Column:
        return F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + F.coalesce(c, F.lit(0)))) + F.lit(1.0)

    qtf = term_counts(questions, q_id, q_tokens)
    q_idf = materialize(qtf.select("token").distinct().join(df, "token", "left").select("token", idf(F.col("df")).alias("idf")))
    qw = materialize(tfidf(qtf, q_id, maybe_broadcast(q_idf)[0]))
    qw_side, small = maybe_broadcast(qw)
    cand = None
    if small:
        size = qw.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(q_id).alias("q")).first()
        if size["n"] <= tfidf_scan.MAX_WEIGHTS and size["q"] <= tfidf_scan.MAX_QUESTIONS:
            top = df.orderBy(F.col("df").desc(), "token").limit(tfidf_scan.FREQUENT).select("token", "df", idf(F.col("df")).alias("idf")).toArrow()
            frequent = dict(zip(top.column("token").to_pylist(), top.column("idf").to_pylist()))
            # the next token's df is at most the least one in the table
            rare = max(frequent.values(), default=1.0)
            passed = materialize(tfidf_scan.candidates(qw.join(maybe_broadcast(q_idf)[0], "token"), frequent, rare, corpus, q_id, d_id, d_tokens, threshold))
            cand, found = passed.select(q_id, d_id).distinct(), passed.select(d_id, d_tokens).dropDuplicates([d_id])
    if cand is None:
        # prefix: by weight desc; token i stays while the norm of (w_i, w_i+1, ...) >= threshold
        w = Window.partitionBy(q_id).orderBy(F.col("w").desc(), F.col("token"))
        tail = F.sqrt(F.sum(F.col("w") * F.col("w")).over(w.rowsBetween(0, Window.unboundedFollowing)))
        prefix = qw.withColumn("_tail", tail).where(F.col("_tail") >= F.lit(threshold)).select(q_id, "token")
        cand = materialize(dtok.join(maybe_broadcast(prefix)[0], "token").select(q_id, d_id).distinct())
        cand_docs, _ = maybe_broadcast(cand.select(d_id).distinct())
        found = corpus.join(cand_docs, d_id, "left_semi")
    # exact dot product of the candidates over all shared tokens
    dtf = term_counts(found, d_id, d_tokens)
    dw = tfidf(dtf, d_id, df.select("token", idf(F.col("df")).alias("idf")))
    scores = (cand.join(qw_side, q_id)
                  .join(dw.withColumnRenamed("w", "_dw"), [d_id, "token"])
                  .groupBy(q_id, d_id).agg(F.round(F.sum(F.col("w") * F.col("_dw")), SCORE_DIGITS).alias("score"))
                  .where(F.col("score") > F.lit(threshold)))
    best = (scores.groupBy(q_id)
                  .agg(F.max_by(F.struct(F.col(d_id), F.col("score")), F.struct(F.col("score"), -F.col(d_id))).alias("_b"))
                  .select(q_id, F.col(f"_b.{d_id}").alias(d_id), F.col("_b.score").alias("score")))
    return questions.select(q_id).join(best, q_id, "left")
