"""Toxicity by a classifier chain of linear models.

Categories are predicted one after the other; each later model sees the text's
features and the probabilities of the earlier categories.  In training those
are out-of-fold: a row's earlier probabilities come from models that did not see the
row, so later models learn from predictions as good as those met in use.

The models are fitted on at most ``SAMPLE`` labelled documents (those of least hash
of doc_id), and on the slots related to a label, which Spark finds; every document is scored on its whole text.

Rows: a null text has no features and gets the models' base rates; rows with a
null label are left out for that category only; without any usable label a
category has probability 0.  Repeated rows are scored each; an empty table
gives no rows.  Other columns are ignored, and kept by ``without_toxic``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from citeweave.llm.hashed_text import SLOTS, Rows, descend, labelled_sample, scored, sigmoid

SAMPLE = 12_000
FOLDS = 3
RIDGE = 1e-4
CHAIN = ("low_quality", "toxic")
THRESHOLD = 0.5


class Linear:
    """Logistic regression on hashed text and on earlier probabilities."""

    def __init__(self, weights: np.ndarray, earlier: np.ndarray, bias: float):
        self.weights, self.earlier, self.bias = weights, earlier, bias

    @classmethod
    def fit(cls, x: Rows, before: np.ndarray, y: np.ndarray) -> "Linear":
        k = before.shape[1]
        if not len(y) or y.min() == y.max():  # nothing to tell apart
            return cls(np.zeros(SLOTS), np.zeros(k), -40.0 if not len(y) or y[0] == 0 else 40.0)
        n, x = len(y), x.related(y)

        def gradient(w):
            error = (sigmoid(x.dot(w[:SLOTS]) + before @ w[SLOTS:-1] + w[-1]) - y) / n
            g = np.concatenate([x.back(error), before.T @ error, [error.sum()]])
            g[:-1] += RIDGE * w[:-1]
            return g
        start = np.zeros(SLOTS + k + 1)
        start[-1] = np.log(y.mean() / (1 - y.mean()))
        w = descend(gradient, start)
        return cls(w[:SLOTS], w[SLOTS:-1], float(w[-1]))

    def predict(self, x: Rows, before: np.ndarray) -> np.ndarray:
        return sigmoid(x.dot(self.weights) + before @ self.earlier + self.bias)


def fit_chain(x: Rows, labels: np.ndarray, fold: np.ndarray,
              folds: int = FOLDS) -> tuple[list[Linear], np.ndarray]:
    """The chain's models and the out-of-fold probabilities, one column per
    category.  ``fold`` has every row's fold, 0 to ``folds`` - 1."""
    n, k = labels.shape
    out, models = np.zeros((n, k)), []
    for c in range(k):
        usable = ~np.isnan(labels[:, c])
        for f in range(folds):
            train, test = np.flatnonzero(usable & (fold != f)), np.flatnonzero(fold == f)
            m = Linear.fit(x.take(train), out[train, :c], labels[train, c])
            out[test, c] = m.predict(x.take(test), out[test, :c])
        train = np.flatnonzero(usable)
        models.append(Linear.fit(x.take(train), out[train, :c], labels[train, c]))
    return models, out


def chain_probabilities(models: list[Linear], x: Rows) -> np.ndarray:
    out = np.zeros((x.n, len(models)))
    for c, m in enumerate(models):
        out[:, c] = m.predict(x, out[:, :c])
    return out


def trained(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[Linear]:
    """The chain of ``CHAIN`` from labels (doc_id, quality, toxic)."""
    graded = labels.selectExpr("doc_id", "1 - quality AS low_quality", "toxic")
    x, y, _, fold = labelled_sample(documents, graded, list(CHAIN), sample, FOLDS)
    return fit_chain(x, y, fold)[0]


def _scorer(documents: DataFrame, models: list[Linear]):
    shared = documents.sparkSession.sparkContext.broadcast(models)  # SLOTS numbers a category

    def score(x: Rows) -> dict[str, np.ndarray]:
        p = chain_probabilities(shared.value, x)
        return {f"p_{name}": p[:, i] for i, name in enumerate(CHAIN)}
    return score


def toxicity(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id and the probability of each category, for every row."""
    score = _scorer(documents, trained(documents, labels, sample))
    return scored(documents, score, [f"p_{c}" for c in CHAIN], ["doc_id"])


def without_toxic(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD,
                  sample: int = SAMPLE) -> DataFrame:
    """``documents`` without the rows of toxic probability ``threshold`` or more."""
    score = _scorer(documents, trained(documents, labels, sample))
    return scored(documents, score, [], documents.columns, keep=lambda p: p["p_toxic"] < threshold)
