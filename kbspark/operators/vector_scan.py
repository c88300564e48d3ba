"""Exact vector search in one pass over the catalogue, with cells skipped by
their radius bounds.

The measured, bounded question chunk goes to every task; the catalogue stays
where it is and is read in slices.  A slice is a cell: its centre and radius
(the largest angle to the centre) bound the cosine that any of its rows can
reach with a question.  A question meets the rows of a cell only if that bound
can reach its k-th best score so far, which starts at the threshold.  In a
catalogue stored by ``pivot_cells`` the rows of one slice lie around one pivot,
so the bounds are tight; in any other order the result is the same and fewer
cells are skipped.

Matrix products run in single precision on unit vectors.  Rows near a
question's best are scored again in double precision and a fixed order before
they are compared, so the bits of a score depend on its two vectors only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Rows of one cell, and bytes of one matrix of scores (questions by the rows of
# a cell): it stays near the processor.
CELL_ROWS = 1024
MATRIX_BYTES = 4 << 20
# Products in single precision are this near the exact cosine.
NEAR = 1e-4
# Catalogue vectors that pivots are drawn from, at most, and rows of a pivot.
PIVOT_SAMPLE = 20_000
PIVOT_ROWS = 4 * CELL_ROWS


def fixed_dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise dot products summed from left to right."""
    return np.add.accumulate(a * b, axis=1)[:, -1]


def fixed_cos(m: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosines of paired rows: 0 with a zero norm, -inf with a missing ``m``."""
    missing = np.isnan(m).any(axis=1)
    mm = np.where(missing[:, None], 0.0, m)
    den = np.sqrt(fixed_dot(mm, mm)) * np.sqrt(fixed_dot(q, q))
    with np.errstate(divide="ignore", invalid="ignore"):
        s = np.where(den == 0, 0.0, fixed_dot(mm, q) / den)
    s[missing] = -np.inf
    return s


def vectors_of(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors as rows; null vectors and those of another length are NaN."""
    sizes = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    out = np.full((len(column), dim), np.nan)
    good = sizes == dim
    if good.any():
        values = column.filter(pa.array(good)).flatten().to_numpy(zero_copy_only=False)
        out[good] = np.asarray(values, dtype=np.float64).reshape(-1, dim)
    return out


def unit(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of length 1 in single precision (zero rows for missing and zero
    vectors), and which rows are neither."""
    with np.errstate(divide="ignore", invalid="ignore"):
        length = np.sqrt((m * m).sum(axis=1))
        good = np.isfinite(length) & (length > 0)
        return np.where(good[:, None], m / length[:, None], 0.0).astype(np.float32), good


class Best:
    """The k best rows of each question so far; scores are above -inf."""

    def __init__(self, n: int, k: int, threshold: float):
        self.k, self.limit = k, np.full(n, threshold)
        self.row, self.score = np.zeros((n, k), dtype=np.int64), np.full((n, k), -np.inf)

    def add(self, question: np.ndarray, row: np.ndarray, score: np.ndarray) -> None:
        """Sorts the rows of the questions named, no others."""
        if not len(question):
            return
        named, at = np.unique(question, return_inverse=True)
        had = np.flatnonzero(self.score[named].ravel() > -np.inf)
        q = np.concatenate([had // self.k, at])
        r, s = np.concatenate([self.row[named].ravel()[had], row]), np.concatenate([self.score[named].ravel()[had], score])
        order = np.lexsort((r, -s, q))
        q, r, s = q[order], r[order], s[order]
        place = np.arange(len(q)) - np.searchsorted(q, q, side="left")
        keep = place < self.k
        q, r, s, place = named[q[keep]], r[keep], s[keep], place[keep]
        self.row[q, place], self.score[q, place] = r, s
        last = place == self.k - 1
        self.limit[q[last]] = np.maximum(self.limit[q[last]], s[last])

    @property
    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, place = np.nonzero(self.score > -np.inf)
        return q, self.row[q, place], self.score[q, place]


def units(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``unit`` of many rows, a slice at a time."""
    parts = [unit(m[a:a + CELL_ROWS].astype(np.float64)) for a in range(0, max(1, len(m)), CELL_ROWS)]
    return np.concatenate([u for u, _ in parts]), np.concatenate([g for _, g in parts])


def task(ids: np.ndarray, questions: np.ndarray, k: int, threshold: float, names: list[str], count: bool = False, matrix_bytes: int = MATRIX_BYTES):
    """Task function over ``(id, title vector, description vector)``."""
    dim = questions.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, directed = units(questions)
        step = max(1, matrix_bytes // (4 * CELL_ROWS))
        best = Best(len(ids), k, threshold)
        # scores are written to the same place for every cell
        room = np.empty((2, min(step, max(1, len(ids))) * CELL_ROWS), dtype=np.float32)
        seen = met = 0
        for whole in batches:
            for at in range(0, whole.num_rows, CELL_ROWS):
                batch = whole.slice(at, CELL_ROWS)
                row = batch.column(0).to_numpy(zero_copy_only=False)
                sides = [vectors_of(batch.column(c), dim) for c in (1, 2)]
                sided, good = zip(*(unit(m) for m in sides))
                present = [~np.isnan(m).any(axis=1) for m in sides]
                known = np.concatenate([u[g] for u, g in zip(sided, good)])
                reach = np.full(len(ids), -np.inf)
                if len(known):
                    centre = known.mean(axis=0, dtype=np.float64)
                    length = np.sqrt(centre @ centre)
                    centre = centre / length if length > 0 else known[0].astype(np.float64)
                    radius = math.acos(float(np.clip((known @ centre).min() - NEAR, -1, 1)))
                    angle = np.arccos(np.clip(asked @ centre + NEAR, -1, 1))
                    reach = np.cos(np.maximum(0.0, angle - radius))
                if any((p & ~g).any() for p, g in zip(present, good)):
                    reach = np.maximum(reach, 0.0)  # zero vectors score 0
                reach[~directed] = 0.0 if any(p.any() for p in present) else -np.inf  # so do zero questions
                visit = np.flatnonzero(reach + NEAR >= best.limit)
                seen += len(ids)
                met += len(visit)
                if not len(visit):
                    continue
                for lo in range(0, len(visit), step):
                    some = visit[lo:lo + step]
                    s, product = (r[:len(some) * len(row)].reshape(len(some), len(row)) for r in room)
                    if present[0].all():
                        np.matmul(asked[some], sided[0].T, out=s)
                    else:
                        s[:] = -np.inf
                    for u, p in zip(sided, present):
                        if not p.all():
                            s[:, p] = np.maximum(s[:, p], asked[some] @ u[p].T)
                        elif u is not sided[0]:
                            np.maximum(s, np.matmul(asked[some], u.T, out=product), out=s)
                    least = best.limit[some] - NEAR
                    # a pair counts if it can reach the k-th best so far and of this cell
                    c, r = np.divmod(np.flatnonzero(s >= least.astype(np.float32)[:, None]), len(row))
                    if len(c) > k and len(row) > k:
                        many = np.flatnonzero(np.bincount(c, minlength=len(some)) > k)
                        if len(many):
                            own = np.partition(s[many], len(row) - k, axis=1)[:, len(row) - k]
                            least[many] = np.maximum(least[many], own - 2 * NEAR)
                            reached = s[c, r] >= least.astype(np.float32)[c]
                            c, r = c[reached], r[reached]
                    if least.min() == -np.inf:
                        reached = s[c, r] > -np.inf
                        c, r = c[reached], r[reached]
                    question = some[c]
                    score = np.maximum(*(fixed_cos(m[r], questions[question].astype(np.float64)) for m in sides))
                    keep = score > threshold
                    best.add(question[keep], row[r[keep]], score[keep])
        if count:
            yield pa.RecordBatch.from_arrays([pa.array([seen], pa.int64()), pa.array([met], pa.int64())], ["cells", "visited"])
        else:
            q, r, s = best.rows
            yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(r), pa.array(s)], names)

    return run


def scan(questions: list[tuple[np.ndarray, np.ndarray]], catalog: DataFrame, k: int, threshold: float, names: list[str], count: bool = False,
         matrix_bytes: int = MATRIX_BYTES) -> DataFrame:
    """Per task and question the ``k`` best rows above the threshold (score
    descending, id ascending), as ``(question id, row id, score)``; with
    ``count`` instead how many cells there were for questions to visit and how
    many they visited.  ``questions`` are chunks of ids and vectors, each of
    bounded size; ``catalog`` has the row id and two vector columns."""
    schema = T.StructType([T.StructField("cells", T.LongType()), T.StructField("visited", T.LongType())] if count else
                          [T.StructField(names[0], T.LongType()), T.StructField(names[1], T.LongType()), T.StructField(names[2], T.DoubleType())])
    out = None
    for ids, vectors in questions:
        part = catalog.mapInArrow(task(ids, vectors, k, threshold, names, count, matrix_bytes), schema)
        out = part if out is None else out.unionByName(part)
    return out


def pivot_cells(catalog: DataFrame, row_id: str, vector: str, seed: int = 5) -> DataFrame:
    """``catalog`` laid out by cells: rows are sorted by the pivot nearest to
    ``vector``, so that slices read one after another lie close together.  Write
    it once per catalogue version.  Pivots are vectors of a bounded sample; a
    cell with very many rows is spread over several partitions."""
    sample = catalog.select(vector).where(F.col(vector).isNotNull())
    n = sample.count()
    if n > PIVOT_SAMPLE:
        sample = sample.orderBy(F.rand(seed)).limit(PIVOT_SAMPLE)
    drawn = [r[0] for r in sample.limit(PIVOT_SAMPLE).collect()]
    wanted = max(1, min(len(drawn), -(-n // PIVOT_ROWS)))
    if not drawn:
        return catalog
    dim = len(drawn[0])
    pivots, good = unit(np.array([v if len(v) == dim else [np.nan] * dim for v in drawn], dtype=np.float64))
    pivots = pivots[good]
    # farthest first: each pivot is the sample vector least like those before it
    chosen = [0] if len(pivots) else []
    like = pivots @ pivots[0] if len(pivots) else np.empty(0)
    while chosen and len(chosen) < min(wanted, len(pivots)):
        chosen.append(int(like.argmin()))
        like = np.maximum(like, pivots @ pivots[chosen[-1]])
    pivots = pivots[chosen]
    names = catalog.columns
    at = names.index(vector)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, _ = unit(vectors_of(batch.column(at), dim))
            cell = (u @ pivots.T).argmax(axis=1) if len(pivots) else np.zeros(len(u), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32())], [*names, "__kb_cell"])

    schema = T.StructType([*catalog.schema.fields, T.StructField("__kb_cell", T.IntegerType())])
    return (catalog.mapInArrow(place, schema).repartitionByRange("__kb_cell", F.xxhash64(row_id))
            .sortWithinPartitions("__kb_cell", row_id).drop("__kb_cell"))
