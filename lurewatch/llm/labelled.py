"""Bounded samples of labelled documents for fitting classifiers, and the logistic fit that calibrates them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; NULL for a NULL id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, most: int, longest: int,
           describe: Callable[[str], np.ndarray] | None = None) -> tuple[list, np.ndarray, float]:
    """``(texts, labels, share of label 1)`` of at most ``most`` labelled rows of each label.

    With ``describe`` its numbers come to the driver in place of the texts.

    ``learn`` says by ``doc_id`` which rows may be learned from.  The rows are those
    whose ids have the least hashes, and no text is longer than ``longest``
    characters, so what comes to the driver is bounded.  The share counts all labelled
    rows.  Ids are chosen before the join: the texts are not shuffled.
    """
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("_y"))
             .filter(F.col("doc_id").isNotNull() & F.col("_y").isin(0, 1) & F.coalesce(learn, F.lit(False)))
             .groupBy("doc_id").agg(F.max("_y").alias("_y")))
    ones, rows = known.agg(F.sum("_y"), F.count(F.lit(1))).first()
    order = F.xxhash64("doc_id")
    chosen = None
    for y in (1, 0):
        own = known.filter(F.col("_y") == y).orderBy(order, "doc_id").limit(most)
        chosen = own if chosen is None else chosen.union(own)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(
        F.col("text").isNotNull() & (F.length("text") <= longest))
    found = (texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "_y", order.alias("_o"))
             .groupBy("doc_id").agg(F.min(F.struct("_o", "text", "_y")).alias("_r"))  # one text for each id
             .select("_r.*"))
    if describe is not None:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                made = [describe(t.as_py()).tolist() for t in batch.column("text")]
                yield pa.RecordBatch.from_arrays([batch.column("_o"), pa.array(made, pa.list_(pa.float64())), batch.column("_y")],
                                                 ["_o", "text", "_y"])

        found = found.mapInArrow(run, "_o long, text array<double>, _y int")
    found = found.orderBy("_o", "text").collect()
    return [r["text"] for r in found], np.array([r["_y"] for r in found], float), (ones or 0) / max(rows, 1)


class Logistic:
    """Ridge logistic regression; ``share`` is the share of label 1 that the scores assume."""

    def __init__(self, x: np.ndarray, y: np.ndarray, share: float, ridge: float = 1e-3, steps: int = 50):
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        z = self._design(x)
        penalty = np.r_[np.full(x.shape[1], ridge * len(y)), 1e-6]
        self.weights = np.zeros(z.shape[1])
        for _ in range(steps):
            p = self._squash(z @ self.weights)
            slope = z.T @ (p - y) + penalty * self.weights
            self.weights -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), slope)
        own = min(max(y.mean(), 1e-6), 1 - 1e-6)
        share = min(max(share, 1e-6), 1 - 1e-6)
        self.weights[-1] += np.log(share / (1 - share)) - np.log(own / (1 - own))

    @staticmethod
    def _squash(t: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(t, -35, 35)))

    def _design(self, x: np.ndarray) -> np.ndarray:
        return np.c_[(x - self.mean) / self.scale, np.ones(len(x))]

    def score(self, x: np.ndarray) -> np.ndarray:
        return self._squash(self._design(x) @ self.weights)
