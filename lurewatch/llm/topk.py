"""Exact top-k search by MaxScore over signed integer vectors.

A vector is a document with two kinds of terms for each dimension, one for
positive and one for negative components, so that a posting is (row, weight > 0).
A query component meets the term of its own sign; its score bound in a shard is
the product with the largest weight there.  The other sign can only lower a
score.  Query terms are split by these bounds: as long as the bounds of the
non-essential ones together stay below the k-th best score, a row that occurs
in no essential posting list cannot be a result.  The essential lists are
traversed term at a time; the surviving rows are probed in the remaining
dimensions, largest bound first, and leave as soon as what is known plus what
may still come falls below the k-th best score.  Shards are merged at the end.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from . import vectors

#: Rows of a shard and queries of a block: the most that a task holds.
SHARD, BLOCK = 8192, 2048


class Shard:
    """Posting lists and a forward index of the vectors of one shard."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.columns = ids, np.ascontiguousarray(rows.T)
        self.top, self.low = rows.max(axis=0), rows.min(axis=0)
        self.size = int(np.abs(rows).max())
        self.postings: dict[tuple[int, bool], np.ndarray] = {}
        self.heads: dict[tuple[int, bool], np.ndarray] = {}

    def posting(self, d: int, positive: bool) -> np.ndarray:
        """Rows with a component of this sign in dimension ``d``."""
        if (d, positive) not in self.postings:
            column = self.columns[d]
            self.postings[d, positive] = np.flatnonzero(column > 0 if positive else column < 0)
        return self.postings[d, positive]

    def head(self, d: int, positive: bool, n: int) -> np.ndarray:
        """The ``n`` rows of largest weight in a posting list."""
        if (d, positive) not in self.heads:
            rows = self.posting(d, positive)
            weights = self.columns[d][rows] if positive else -self.columns[d][rows]
            self.heads[d, positive] = rows[np.argpartition(-weights, n - 1)[:n]] if len(rows) > n else rows
        return self.heads[d, positive]

    def exact(self, query: np.ndarray, rows: np.ndarray, dims: np.ndarray) -> np.ndarray:
        """Inner products over some dimensions; doubles are exact for whole numbers below 2^53."""
        part = self.columns[dims] if len(rows) == len(self.ids) else self.columns[np.ix_(dims, rows)]
        if self.size * int(np.abs(query).max()) * len(query) < 1 << 53:
            return (query[dims].astype(float) @ part.astype(float)).astype(np.int64)
        return query[dims] @ part

    def search(self, query: np.ndarray, own: int | None, k: int) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, scores)`` of at least the ``k`` best rows of the shard but ``own``."""
        bound = np.where(query > 0, query * np.maximum(self.top, 0), query * np.minimum(self.low, 0))
        dims = np.argsort(-bound, kind="stable")
        dims = dims[query[dims] != 0]
        every = np.arange(len(query))
        # A first threshold: exact scores of the heads of the strongest lists.
        seeds = [self.head(d, bool(query[d] > 0), 4 * k) for d in dims[:4]]
        seeds = np.unique(np.concatenate(seeds)) if seeds else np.empty(0, np.int64)
        seeds = seeds[self.ids[seeds] != own] if own is not None else seeds
        scores = self.exact(query, seeds, every)
        least = np.partition(scores, -k)[-k] if len(scores) >= k else None
        if least is None or least <= 0:
            # Rows that occur in none of the query's lists may still be results.
            rows, known, start = np.arange(len(self.ids)), np.zeros(len(self.ids), np.int64), 0
        else:
            after = np.concatenate((np.cumsum(bound[dims][::-1])[::-1], [0]))
            start = int(np.searchsorted(-after, -least, side="right"))  # the fewest whose rest stays below
            touched = np.zeros(len(self.ids), bool)
            for d in dims[:start]:
                touched[self.posting(d, bool(query[d] > 0))] = True
            rows = np.flatnonzero(touched)
            known = np.zeros(len(rows), np.int64)
            start = 0
        if own is not None:
            keep = self.ids[rows] != own
            rows, known = rows[keep], known[keep]
        rest = int(bound[dims].sum())
        while start < len(dims):
            step = dims[start:start + 8]
            known += self.exact(query, rows, step)
            rest -= int(bound[step].sum())
            start += len(step)
            if least is not None:
                keep = known + rest >= least
                if not keep.all():
                    rows, known = rows[keep], known[keep]
            if len(rows) > k:  # what is left to come may be negative: a lower bound of the k-th best
                fall = int(self.fall(query, dims[start:]))
                floor = int(np.partition(known, -k)[-k]) - fall
                least = floor if least is None else max(least, floor)
        return self.ids[rows], known

    def fall(self, query: np.ndarray, dims: np.ndarray) -> int:
        """The most that a score can still lose in ``dims``."""
        worst = np.where(query > 0, query * self.low, query * self.top)[dims]
        return -int(np.minimum(worst, 0).sum())


def top_k(rows: DataFrame, asked: Column, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding",
          scale: int = 1024, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row where ``asked`` holds, the ``k`` best others.

    The score is the inner product of floor(``scale`` * component), in 64-bit
    integers (components must be small enough for it not to overflow).  Ties go
    to smaller ids.  With fewer candidates than ``k`` all are returned.  Vectors
    that are NULL, empty or hold NULL or non-finite components, and NULL ids, take
    no part, and only vectors of one length are compared.  A repeated id is left
    out of its own query's candidates altogether; repeated vectors are rows of
    their own; an empty table gives no rows; other columns are ignored.
    """
    value = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * F.lit(float(scale))))
    kept = rows.filter(vectors.usable(F.col(vector)) & F.col(vec_id).isNotNull()).select(
        F.col(vec_id).cast("long").alias("vec_id"), value.alias("vector"), asked.alias("_asked"))

    def search(queries: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        out = []
        lengths = part["vector"].map(len).to_numpy() if len(part) else np.empty(0)
        shards = {n: Shard(part["vec_id"].to_numpy()[lengths == n], np.stack(part["vector"].to_numpy()[lengths == n]))
                  for n in set(lengths.tolist())}
        for q, v in zip(queries["vec_id"].tolist(), queries["vector"]):
            if len(v) in shards:
                ids, scores = shards[len(v)].search(np.asarray(v, np.int64), q, k)
                first = np.lexsort((ids, -scores))[:k]
                out.append((np.full(len(first), q), ids[first], scores[first]))
        columns = [np.concatenate(x) for x in zip(*out)] if out else [np.empty(0, np.int64)] * 3
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), columns)))

    found = vectors.blocked(kept, kept.filter(F.col("_asked")), search,
                            "query_id long, vec_id long, score long", shard, block)
    return vectors.best(found, k)
