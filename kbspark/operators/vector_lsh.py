"""Approximate vector search (M8): candidates by locality-sensitive hashing,
the exact scorer behind it.

Hyperplanes through the origin cut the space; the sides on which a vector lies
are its bits.  Two vectors at angle a agree in one bit with chance 1 - a/pi.
``bits`` of them make one table's key, so few strangers share it, and there
are as many tables as make a pair at the threshold share a key with chance
``recall``; nearer pairs share one more often.  The keys are not shuffled: they
would be many rows per vector.  A bounded chunk of questions meets a bounded
buffer of catalogue rows inside a task.  Table by table both are sorted by key;
the questions and vectors of one key meet in one matrix product, which names the
pairs that can reach a place among the best.  These are scored exactly, each
once however many tables it meets in, and a task sends on its winners only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kbspark.operators.joins import materialize
from kbspark.operators.match import COSINE_THRESHOLD, MAX_RESULTS
from kbspark.operators.vector_scan import NEAR, Best, fixed_cos, unit, units, vectors_of
from kbspark.operators.vectors import catalog_grid, question_chunks

RECALL = 0.95
# Catalogue rows whose keys a task holds, and vectors that are hashed at a time.
BUFFER_ROWS = 32768
ASKED_ROWS = 1024
# A key is met by a product of all its questions and vectors of the buffer, so a
# bit more saves less than the tables it asks for from here on.
MAX_BITS = 8
# Pairs of one matrix product, pairs that met and wait for their exact score, and
# pairs scored exactly at a time.
PAIRS = 1 << 18
WAITING = 1 << 19
SCORED = 1 << 13


def table_count(bits: int, threshold: float, recall: float = RECALL) -> int:
    """Tables of ``bits`` bits in which a pair of cosine ``threshold`` shares a
    key with chance ``recall``."""
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return max(1, math.ceil(math.log(1 - recall) / math.log1p(-agree)))


def _keys(u: np.ndarray, planes: np.ndarray, bits: int) -> np.ndarray:
    """Key of every table (rows) for every unit vector (columns)."""
    out = np.empty((planes.shape[1] // bits, len(u)), dtype=np.uint16 if bits <= 16 else np.int32)
    weight = (1 << np.arange(bits)).astype(np.float32)  # sums below 2^24 are exact
    for a in range(0, len(u), ASKED_ROWS):
        sides = (u[a:a + ASKED_ROWS] @ planes > 0).astype(np.float32)
        out[:, a:a + ASKED_ROWS] = (sides.reshape(-1, bits) @ weight).reshape(len(sides), -1).T
    return out


def _groups(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First of each group of equal rows, and the group of every row."""
    m = np.ascontiguousarray(m)
    _, first, group = np.unique(m.view(np.dtype((np.void, m.dtype.itemsize * m.shape[1]))).ravel(), return_index=True, return_inverse=True)
    return first, group


def _first_of_equal(m: np.ndarray, row: np.ndarray, k: int) -> np.ndarray:
    """Which vectors to look up: of equal ones the ``k`` with the smallest ids,
    as the others tie with them and come later."""
    _, group = _groups(m)
    order = np.lexsort((row, group))
    group = group[order]
    return np.sort(order[np.arange(len(group)) - np.searchsorted(group, group, side="left") < k])


class _Hits:
    """The best rows of each question among the pairs that met in one buffer.
    A pair may meet in many tables; it is scored once and counts once."""

    def __init__(self, questions: np.ndarray, row: np.ndarray, sides: list[np.ndarray], best: Best, threshold: float):
        self.questions, self.row, self.sides, self.best, self.threshold, self.limit = questions, row, sides, best, threshold, best.limit.copy()
        self.code, self.score = np.empty(0, dtype=np.int64), np.empty(0)
        self.waiting: list[np.ndarray] = []
        self.n = 0

    def add(self, question: np.ndarray, at: np.ndarray) -> None:
        self.waiting.append(question * len(self.row) + at)
        self.n += len(at)
        if self.n >= WAITING:
            self.settle()

    def settle(self) -> None:
        if not self.n:
            return
        code = np.setdiff1d(np.concatenate(self.waiting), self.code)
        self.waiting, self.n = [], 0
        q, r = np.divmod(code, len(self.row))
        score = [np.maximum(*(fixed_cos(m[r[a:a + SCORED]], self.questions[q[a:a + SCORED]].astype(np.float64)) for m in self.sides))
                 for a in range(0, len(q), SCORED)]
        code, score = np.concatenate([self.code, code]), np.concatenate([self.score, *score])
        q, r = np.divmod(code, len(self.row))
        # a row that is no better than the k-th best is never needed again
        keep = np.flatnonzero((score >= self.limit[q]) & (score > self.threshold))
        keep = keep[np.lexsort((r[keep], self.row[r[keep]], -score[keep], q[keep]))]
        q = q[keep]
        place = np.arange(len(q)) - np.searchsorted(q, q, side="left")
        last = place == self.best.k - 1
        self.limit[q[last]] = np.maximum(self.limit[q[last]], score[keep][last])
        keep = keep[place < self.best.k]
        self.code, self.score = code[keep], score[keep]

    def close(self) -> None:
        self.settle()
        q, r = np.divmod(self.code, len(self.row))
        self.best.add(q, self.row[r], self.score)


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order by key, the keys, and where each begins in the order (and the end)."""
    by = np.argsort(key, kind="stable")
    key = key[by]
    begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, dtype=np.int64)
    return by, key[begins], np.append(begins, len(key))


def _meet(asked: np.ndarray, asked_keys: np.ndarray, known: np.ndarray, known_keys: np.ndarray, owner: np.ndarray, hits: _Hits) -> None:
    """Adds the pairs of questions and buffer rows (``owner`` of a known vector)
    that share a key and can reach a place among the best.  The questions and
    vectors of one key meet in matrix products of bounded size."""
    k, wide = hits.best.k, max(1, math.isqrt(PAIRS))
    for of_q, of_v in zip(asked_keys, known_keys):
        (by_q, key_q, q_lo), (by_v, key_v, v_lo) = _runs(of_q), _runs(of_v)
        _, in_q, in_v = np.intersect1d(key_q, key_v, assume_unique=True, return_indices=True)
        for q_at, q_to, v_at, v_to in zip(q_lo[in_q].tolist(), q_lo[in_q + 1].tolist(), v_lo[in_v].tolist(), v_lo[in_v + 1].tolist()):
            rows = max(wide, PAIRS // (v_to - v_at))
            for a in range(q_at, q_to, rows):
                qs = by_q[a:min(a + rows, q_to)]
                some = asked[qs]
                columns = max(1, PAIRS // len(qs))
                for b in range(v_at, v_to, columns):
                    vs = by_v[b:min(b + columns, v_to)]
                    s = some @ known[vs].T
                    least = (hits.limit[qs] - NEAR).astype(np.float32)
                    met = s >= least[:, None]
                    n = np.count_nonzero(met)
                    if not n:
                        continue
                    if n > 2 * k * len(qs) and len(vs) > 2 * k:  # 2k vectors are those of k rows at least
                        own = np.partition(s, len(vs) - 2 * k, axis=1)[:, len(vs) - 2 * k]
                        met &= s >= (own - 2 * NEAR)[:, None]
                    x, y = np.divmod(np.flatnonzero(met), len(vs))
                    hits.add(qs[x], owner[vs[y]])


def _hash_scan(ids: np.ndarray, questions: np.ndarray, k: int, threshold: float, names: list[str], bits: int, tables: int, seed: int):
    """Task function over ``(id, title vector, description vector)``: per
    question the ``k`` best of the rows that share a key with it."""
    dim = questions.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # equal questions have equal answers
        first, group = _groups(questions)
        unlike = questions[first]
        asked, directed = units(unlike)
        able = np.flatnonzero(directed)
        asked, unlike = asked[able], unlike[able]
        planes = np.random.default_rng(seed).standard_normal((dim, tables * bits)).astype(np.float32)
        asked_keys = _keys(asked, planes, bits)
        best = Best(len(able), k, threshold)

        def search(held: list[pa.RecordBatch]) -> None:
            row = np.concatenate([b.column(0).to_numpy(zero_copy_only=False) for b in held])
            sides = [np.concatenate([vectors_of(b.column(c), dim) for b in held]) for c in (1, 2)]
            known, owner = [], []
            for m in sides:
                u, good = unit(m)
                good = np.flatnonzero(good)
                if len(good):
                    good = good[_first_of_equal(m[good], row[good], k)]
                known.append(u[good])
                owner.append(good)
            known, owner = np.concatenate(known), np.concatenate(owner)
            hits = _Hits(unlike, row, sides, best, threshold)
            _meet(asked, asked_keys, known, _keys(known, planes, bits), owner, hits)
            hits.close()

        held, n = [], 0
        for whole in batches:
            for at in range(0, whole.num_rows, BUFFER_ROWS):
                held.append(whole.slice(at, BUFFER_ROWS))
                n += held[-1].num_rows
                if n >= BUFFER_ROWS:
                    search(held)
                    held, n = [], 0
        if n:
            search(held)
        place = np.full(len(first), -1)
        place[able] = np.arange(len(able))
        q = np.flatnonzero(place[group] >= 0)
        at = place[group[q]]
        x, y = np.nonzero(best.score[at] > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(ids[q[x]], pa.int64()), pa.array(best.row[at[x], y], pa.int64()), pa.array(best.score[at[x], y], pa.float64())], names)

    return run


def nearest_lsh(questions: DataFrame, catalog: DataFrame, *, q_id: str = "question_id", q_vec: str = "q_vec", c_id: str = "image_row",
                title_vec: str = "title_vec", desc_vec: str = "desc_vec", k: int = MAX_RESULTS, threshold: float = COSINE_THRESHOLD,
                bits: int | None = None, recall: float = RECALL, seed: int = 11) -> DataFrame:
    """M8 with candidates by hashing: the ``k`` best of the rows that share a
    key with the question, as ``nearest`` ranks them.  ``bits`` grows with the
    catalogue (default: its base-2 logarithm) up to ``MAX_BITS``.  Rows found
    have their exact scores; a row above the threshold may be missed with chance
    ``1 - recall`` at most.  The threshold must be positive.  What is shuffled
    are the ``k`` best rows per question and task."""
    if threshold <= 0:
        raise ValueError("hashing needs a positive threshold")
    c = catalog.select(F.col(c_id).cast("long").alias(c_id), F.col(title_vec).alias("_tv"), F.col(desc_vec).alias("_dv")).where(F.col(c_id).isNotNull())
    q = materialize(questions.select(F.col(q_id).cast("long").alias(q_id), F.col(q_vec).alias("_qv")).where(F.col(q_id).isNotNull()))
    n = c.count()
    bits = bits or max(4, min(MAX_BITS, math.ceil(math.log2(max(2, n)))))
    names, tables = [q_id, c_id, "score"], table_count(bits, threshold, recall)
    schema = f"{q_id} long, {c_id} long, score double"
    chunks = question_chunks(q, q_id)
    if chunks is None:
        pairs = catalog_grid(q, c, n, q_id, c_id, lambda ids, vectors: _hash_scan(ids, vectors, k, threshold, names, bits, tables, seed), schema)
    else:
        pairs = None
        for ids, vectors in chunks:
            part = c.mapInArrow(_hash_scan(ids, vectors, k, threshold, names, bits, tables, seed), schema)
            pairs = part if pairs is None else pairs.unionByName(part)
    w = Window.partitionBy(q_id).orderBy(F.col("score").desc(), F.col(c_id).asc())
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
