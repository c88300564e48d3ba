"""Candidates of the TF-IDF best match by upper bounds, in one pass.

A document's cosine with a question is the sum over their shared tokens,
divided by the document's norm.  The sum needs the weights of the questions'
own tokens only.  The norm needs the idf of all of the document's tokens; that
of frequent ones stands in a table of bounded size, and a token outside of it
is rarer than any inside, so its idf is at least the table's largest.  That
bounds the norm from below and the cosine from above.  A document is passed on
for exact scoring only to the questions whose best score so far its bound can
reach; where all of its tokens stand in the table its score is exact and may
become that best.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Bounds of what goes to every task: questions, their weights, frequent tokens.
MAX_QUESTIONS = 50_000
MAX_WEIGHTS = 2_000_000
FREQUENT = 200_000
# Bytes of the questions' weights as a matrix; larger sets are kept as lists.
MATRIX_BYTES = 64 * 1024 * 1024
# Scores are rounded before they are compared; bounds may miss by this much.
SLACK = 1e-8
# Documents read from Arrow at a time.
SLICE = 256


class Weights:
    """The questions' weights times idf by token."""

    def __init__(self, n: int, entries: dict[str, tuple[list, list]]):
        self.n, self.place = n, {t: i for i, t in enumerate(entries)}
        self.lists, self.matrix = [(np.array(who, dtype=np.int64), np.array(value)) for who, value in entries.values()], None
        if 8 * n * len(entries) <= MATRIX_BYTES:
            self.matrix = np.zeros((len(entries), n))
            for row, (who, value) in zip(self.matrix, self.lists):
                row[who] = value
            self.lists = []

    def sums(self, counts: dict, known: list) -> np.ndarray:
        """Every question's sum over the known tokens of a document."""
        at = [self.place[t] for t in known]
        n = np.fromiter((counts[t] for t in known), dtype=np.float64, count=len(known))
        if self.matrix is not None:
            return n @ self.matrix[at]
        who = np.concatenate([self.lists[i][0] for i in at])
        return np.bincount(who, np.concatenate([c * self.lists[i][1] for c, i in zip(n, at)]), minlength=self.n)


def _bounds(ids: pa.Array, weights: Weights, frequent: dict, rare_idf: float, threshold: float, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full(len(ids), threshold)
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                documents, questions = [], []
                for i, tokens in enumerate(batch.column(1)):
                    counts = Counter(tokens.as_py() or ())
                    counts.pop("", None)
                    counts.pop(None, None)
                    known = [t for t in counts if t in weights.place]
                    if not known:
                        continue
                    square, outside = 0.0, 0
                    for token, n in counts.items():
                        idf = frequent.get(token)
                        if idf is None:
                            outside += 1
                            idf = rare_idf
                        square += (n * idf) ** 2
                    bound = weights.sums(counts, known) / math.sqrt(square)
                    reach = np.flatnonzero(bound >= best - SLACK)
                    if not outside:
                        best[reach] = np.maximum(best[reach], bound[reach])
                    documents.append(np.full(len(reach), i))
                    questions.append(reach)
                d = np.concatenate(documents) if documents else np.empty(0, dtype=np.int64)
                q = np.concatenate(questions) if questions else np.empty(0, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(q)), *(c.take(pa.array(d)) for c in batch.columns)], names)
    return run


def candidates(weights: DataFrame, frequent: dict[str, float], rare_idf: float, corpus: DataFrame, q_id: str, d_id: str, d_tokens: str,
               threshold: float) -> DataFrame:
    """``(q_id, d_id, d_tokens)`` pairs among which is every question's best
    document above the threshold.  ``weights(q_id, token, w, idf)`` are the questions'
    normalised weights and is of bounded size; ``frequent`` maps tokens to their
    idf, and ``rare_idf`` is no more than that of any other token."""
    rows = weights.toArrow()
    ids = rows.column(q_id).unique()
    place = {v: i for i, v in enumerate(ids.to_pylist())}
    gathered: dict[str, tuple[list, list]] = {}
    for q, token, w, idf in zip(*(rows.column(c).to_pylist() for c in (q_id, "token", "w", "idf"))):
        who, value = gathered.setdefault(token, ([], []))
        who.append(place[q])
        value.append(w * idf)
    docs = corpus.select(d_id, d_tokens)
    schema = T.StructType([T.StructField(q_id, weights.schema[q_id].dataType), *(T.StructField(f.name, f.dataType) for f in docs.schema)])
    return docs.mapInArrow(_bounds(ids, Weights(len(ids), gathered), frequent, rare_idf, threshold, schema.names), schema)
