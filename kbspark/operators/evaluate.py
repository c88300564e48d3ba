"""Quality measurement (E1-E3): answer accuracy, knowledge gaps, threshold sweep."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kbspark.operators.vectors import best_scores

# Fixed value of the reference's written procedure: the accuracy goal.
ACCURACY_GOAL = 0.90


def accuracy(checklist: DataFrame, group: str = "assistant_name", correct: str = "correct") -> DataFrame:
    """Accuracy per group and overall (the rollup's NULL-group row), against the goal."""
    acc = F.avg(F.col(correct).cast("double"))
    return (checklist.rollup(group)
                     .agg(F.count(F.lit(1)).alias("n"), F.round(acc, 6).alias("accuracy"),
                          (acc >= F.lit(ACCURACY_GOAL)).alias("meets_goal")))


def knowledge_gaps(questions: DataFrame, catalog: DataFrame, threshold: float, q_id: str = "question_id",
                   **cols) -> DataFrame:
    """Questions whose best score is not above the threshold, with that
    best score; like the reference's running best it starts at 0."""
    best = best_scores(questions, catalog, q_id=q_id, **cols)
    return (questions.select(q_id).join(best, q_id, "left")
                     .select(q_id, F.greatest(F.coalesce(F.col("best"), F.lit(0.0)), F.lit(0.0)).alias("best_score"))
                     .where(F.col("best_score") <= F.lit(threshold)))


def threshold_sweep(best: DataFrame, thresholds: list[float], q_id: str = "question_id",
                    expected: str = "expected", got: str = "got", score: str = "score") -> DataFrame:
    """Per threshold, questions answered (best score above it), answered
    correctly (best row = expected row) and accuracy over all questions.
    ``best`` holds one row per question (its best match, NULL when none).

    Each score is placed once among the sorted thresholds; sums from the
    highest place down answer all of them, however many there are."""
    steps = sorted(set(map(float, thresholds)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, right = np.zeros(len(steps) + 1, dtype=np.int64), np.zeros(len(steps) + 1, dtype=np.int64)
        for batch in batches:
            above = np.searchsorted(steps, batch.column(0).fill_null(-np.inf).to_numpy(zero_copy_only=False), side="left")
            n += np.bincount(above, minlength=len(n))
            right += np.bincount(above[batch.column(1).to_numpy(zero_copy_only=False)], minlength=len(n))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n))), pa.array(n), pa.array(right)], ["above", "n", "right"])

    scored = best.select(F.col(score).cast("double").alias("score"), F.coalesce(F.col(got) == F.col(expected), F.lit(False)).alias("hit"))
    counts = scored.mapInArrow(place, "above long, n long, right long").groupBy("above").agg(F.sum("n").alias("n"), F.sum("right").alias("right"))
    # one row per threshold from here on
    down = Window.orderBy(F.col("above").desc())
    sums = counts.select("above", F.sum("n").over(down).alias("n_answered"), F.sum("right").over(down).alias("n_correct"),
                         F.sum("n").over(Window.orderBy(F.lit(1))).alias("n_questions")).where("above > 0 and n_questions > 0")
    at = F.element_at(F.array(*[F.lit(t) for t in steps]), F.col("above").cast("int"))
    return sums.select(at.alias("threshold"), "n_questions", "n_answered", "n_correct", F.round(F.col("n_correct") / F.col("n_questions"), 6).alias("accuracy"))
