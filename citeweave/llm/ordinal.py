"""Document quality by ordinal (cumulative-link) regression on graded ratings.

One weight per hashed text slot is shared by all grades; grades are told apart by
ordered thresholds: P(grade >= j) = sigmoid(w.x - t_j) with t_1 < t_2 < ...
A text gets its expected grade and the tail probability of the selection grade.

The model is fitted on at most ``SAMPLE`` rated documents (those of least hash of
doc_id); every document is scored on its whole text.

Rows: a null text has no features and gets the probabilities of the thresholds
alone; null ratings are left out; without ratings every document has the lowest
grade.  Repeated rows are scored each; an empty table gives no rows.  Other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeweave.llm.hashed_text import SLOTS, Rows, descend, labelled_sample, scored, sigmoid

SAMPLE = 12_000
RIDGE = 1e-4
SELECT_GRADE = 1
SELECT_TAIL = 0.5


class Ordinal:
    """Cumulative-link model of grades 0 to ``len(thresholds)``."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    @classmethod
    def fit(cls, x: Rows, grade: np.ndarray, top: int) -> "Ordinal":
        n = len(grade)
        if not n:
            return cls(np.zeros(SLOTS), np.full(top, 40.0))
        x = x.related(grade)
        grade = grade.astype(np.int64)

        def bounds(w):
            return np.cumsum(np.concatenate([w[SLOTS:SLOTS + 1], np.exp(np.clip(w[SLOTS + 1:], -20, 20))]))

        def gradient(w):
            t = np.concatenate([[-np.inf], bounds(w), [np.inf]])
            eta = x.dot(w[:SLOTS])
            # the grade's probability is a - b, of the tails at its two thresholds
            a = np.where(grade > 0, sigmoid(eta - np.where(grade > 0, t[grade], 0)), 1.0)
            b = np.where(grade < top, sigmoid(eta - np.where(grade < top, t[grade + 1], 0)), 0.0)
            p = np.maximum(a - b, 1e-12)
            da, db = a * (1 - a) / p / n, b * (1 - b) / p / n
            slope = np.concatenate([np.bincount(grade, weights=da, minlength=top + 1)[1:]
                                    - np.bincount(grade, weights=db, minlength=top + 1)[:-1]])
            steps = np.cumsum(slope[::-1])[::-1].copy()  # a step moves all thresholds above
            steps[1:] *= np.exp(np.clip(w[SLOTS + 1:], -20, 20))
            return np.concatenate([x.back(db - da) + RIDGE * w[:SLOTS], steps])
        tails = np.array([np.mean(grade >= j) for j in range(1, top + 1)]).clip(1e-3, 1 - 1e-3)
        first = -np.log(tails / (1 - tails))
        first = np.maximum.accumulate(first + 1e-3 * np.arange(top))
        start = np.concatenate([np.zeros(SLOTS), first[:1], np.log(np.maximum(np.diff(first), 1e-3))])
        w = descend(gradient, start)
        return cls(w[:SLOTS], bounds(w))

    def tails(self, x: Rows) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2), ... by column."""
        return sigmoid(x.dot(self.weights)[:, None] - self.thresholds[None, :])


def rated(labels: DataFrame) -> DataFrame:
    """Grades 0 (low quality), 1 (good but toxic), 2 (good)."""
    return labels.select("doc_id", F.when(F.col("quality") == 0, 0)
                         .when((F.col("quality") == 1) & (F.col("toxic") == 1), 1)
                         .when((F.col("quality") == 1) & (F.col("toxic") == 0), 2).alias("grade"))


def quality(documents: DataFrame, ratings: DataFrame, top: int = 2, sample: int = SAMPLE) -> DataFrame:
    """doc_id, expected_grade, p_grade_1 .. p_grade_top (tail probabilities), kept."""
    x, y, _, _ = labelled_sample(documents, ratings, ["grade"], sample)
    usable = np.flatnonzero(~np.isnan(y[:, 0]))
    model = Ordinal.fit(x.take(usable), y[usable, 0], top)
    shared = documents.sparkSession.sparkContext.broadcast(model)  # SLOTS numbers
    names = [f"p_grade_{j}" for j in range(1, top + 1)]

    def score(rows: Rows) -> dict[str, np.ndarray]:
        t = shared.value.tails(rows)
        return {"expected_grade": t.sum(axis=1), **{n: t[:, i].copy() for i, n in enumerate(names)}}
    out = scored(documents, score, ["expected_grade", *names], ["doc_id"])
    return out.withColumn("kept", F.col(f"p_grade_{SELECT_GRADE}") >= SELECT_TAIL)
