"""Bounded samples of labelled documents, and the logistic calibrator fitted on them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train, per_class: int, max_bytes: int) -> DataFrame:
    """(doc_id, text, label) of at most ``per_class`` labelled training documents of each class.

    ``train``: condition on doc_id that selects the rows a label may be learned
    from. Rows are chosen from the labels alone, in the order of a hash of
    doc_id, so the ids (at most ``2 * per_class``) can be broadcast; the texts
    of other documents are not moved. Texts over ``max_bytes`` are left out, and
    of rows that share a doc_id the least text is taken, combined before the
    shuffle: the sample has at most ``2 * per_class`` rows and
    ``2 * per_class * max_bytes`` bytes, however often a document repeats.
    """
    known = (labels.select(F.col("doc_id").alias("doc_id"), F.col(label).cast("int").alias("label"))
             .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & train(F.col("doc_id")))
             .groupBy("doc_id").agg(F.max("label").alias("label")))
    chosen = None
    for value in (0, 1):
        part = known.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionAll(part)
    return (docs.select("doc_id", "text").where(F.octet_length("text") <= max_bytes)
            .join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")))


def class_counts(labels: DataFrame, label: str, train) -> list[int]:
    """Training rows of class 0 and of class 1."""
    rows = (labels.where(F.col(label).isin(0, 1) & train(F.col("doc_id")))
            .groupBy(F.col(label).cast("int").alias("v")).count().collect())
    found = {r["v"]: r["count"] for r in rows}
    return [found.get(0, 0), found.get(1, 0)]


class Logistic:
    """Logistic regression by Newton steps on standardised features, with a small ridge."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0):
        weight = np.ones(len(y)) if weight is None else weight
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-9
        a = self._design(x)
        penalty = ridge * np.eye(a.shape[1])
        penalty[0, 0] = 1e-6
        self.w = np.zeros(a.shape[1])
        for _ in range(50):
            p = self._squash(a @ self.w)
            hessian = (a * (weight * p * (1 - p))[:, None]).T @ a + penalty
            step = np.linalg.solve(hessian, a.T @ (weight * (y - p)) - penalty @ self.w)
            self.w += step
            if np.abs(step).max() < 1e-9:
                break

    def _design(self, x):
        return np.column_stack([np.ones(len(x)), (x - self.mean) / self.scale])

    @staticmethod
    def _squash(z):
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self._squash(self._design(x) @ self.w)
