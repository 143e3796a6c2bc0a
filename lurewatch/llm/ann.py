"""Approximate nearest neighbours through low-dimensional stable projections.

The largest inner product becomes the smallest Euclidean distance when each
vector x gets one more component sqrt(M^2 - |x|^2), M being the largest norm of
its band, and queries get 0 there.  Vectors are projected on 8 Gaussian
directions (a 2-stable law): squared projected distances then are the squared
distance times a chi-square variable with 8 degrees of freedom.  The projections
are indexed by a kd-tree.  A query takes the leaves in the order of their
distance to its projection, and verifies their vectors by true inner product.  A
vector, and at last all leaves left, are passed over once the chi-square test
holds: with r the projected distance and d the true distance of the k-th best so
far, a nearer vector would lie beyond r with a probability below ``miss``.

Every vector is indexed, none is sampled.  Trees are built for each shard in
bands of norms (powers of two), so that one long vector does not spoil M.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from . import vectors

#: Dimensions of the projection; even, so that the chi-square law has a closed form.
DIMS = 8
#: Chance to miss a nearer vector at which a query stops.
MISS = 0.05
#: Vectors of a leaf, rows of a shard, queries of a block.
LEAF, SHARD, BLOCK = 32, 16384, 512


def chi_square_tail(x: np.ndarray, dims: int = DIMS) -> np.ndarray:
    """P(chi-square with an even number of degrees of freedom > x)."""
    half = np.asarray(x, float) / 2
    term = total = np.ones_like(half)
    for i in range(1, dims // 2):
        term = term * half / i
        total = total + term
    return np.exp(-half) * total


def chi_square_bound(tail: float, dims: int = DIMS) -> float:
    low, high = 0.0, 4.0 * dims + 100
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_tail(mid, dims) > tail else (low, mid)
    return high


class Tree:
    """A kd-tree over projected points, kept as its leaves' members and boxes."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.members: list[np.ndarray] = []
        todo = [np.arange(len(points))]
        while todo:
            own = todo.pop()
            spread = np.ptp(points[own], axis=0)
            d = int(spread.argmax())
            if len(own) <= leaf or spread[d] == 0:
                self.members.append(own)
                continue
            half = len(own) // 2
            order = np.argpartition(points[own, d], half)
            todo += [own[order[half:]], own[order[:half]]]
        self.low = np.array([points[m].min(axis=0) for m in self.members])
        self.high = np.array([points[m].max(axis=0) for m in self.members])

    def distances(self, point: np.ndarray) -> np.ndarray:
        """Squared distances of the leaves' boxes from a point."""
        gap = np.maximum(self.low - point, 0) + np.maximum(point - self.high, 0)
        return (gap * gap).sum(axis=1)


class Band:
    """The distinct vectors of one shard whose norms lie in one power of two."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, directions: np.ndarray):
        # Copies of a vector are one point; their ids stay together in rising order.
        _, first, group = np.unique(rows.view([("", rows.dtype)] * rows.shape[1]).ravel(),
                                    return_index=True, return_inverse=True)
        order = np.lexsort((ids, group))
        self.ids, self.cuts = ids[order], np.searchsorted(group[order], np.arange(len(first) + 1))
        self.rows = rows[first]
        norms = (self.rows ** 2).sum(axis=1)
        self.most = float(norms.max())
        lifted = np.column_stack((self.rows, np.sqrt(np.maximum(self.most - norms, 0))))
        points = lifted @ directions
        self.tree = Tree(points)
        order = np.concatenate(self.tree.members)  # leaf by leaf
        self.rows, self.points, self.point = self.rows[order], points[order], order
        self.copies = np.diff(self.cuts)[order]
        sizes = np.array([len(m) for m in self.tree.members])
        starts = np.cumsum(sizes) - sizes
        slots = np.arange(sizes.max())
        self.leaves = np.where(slots < sizes[:, None], starts[:, None] + slots, -1)  # -1: no row
        single = np.flatnonzero(self.copies == 1)
        self.alone = dict(zip(self.ids[self.cuts[order[single]]].tolist(), single.tolist()))

    def search(self, query: np.ndarray, projected: np.ndarray, own: int, k: int, reach: float, floor: float):
        """``(rows, ids, least)``: verified vectors that may be among the ``k`` best, and the k-th best score."""
        away = self.tree.distances(projected)
        order = np.argsort(away)
        away, square = away[order], float(query @ query) + self.most
        mine = self.alone.get(own, -1)  # a row that holds no id but the query's own
        rows, scores, done, step = np.empty(0, np.int64), np.empty(0), 0, 8
        least = floor
        while done < len(order) and away[done] <= reach * max(square - 2 * least, 0.0):
            new = self.leaves[order[done:done + step]].ravel()
            new = new[(new >= 0) & (new != mine)]
            gap = self.points[new] - projected
            new = new[np.einsum("ij,ij->i", gap, gap) <= reach * max(square - 2 * least, 0.0)]
            value = self.rows[new] @ query
            rows, scores = np.concatenate((rows, new)), np.concatenate((scores, value))
            if len(scores) >= k:
                least = max(least, float(np.partition(scores, -k)[-k]))
            keep = scores >= least - 1e-9
            rows, scores = rows[keep], scores[keep]
            done, step = done + step, min(2 * step, 64)
        ids = [[i for i in self._ids(r)[:k + 1].tolist() if i != own] for r in rows]
        return np.repeat(rows, [len(x) for x in ids]), [i for x in ids for i in x], least

    def _ids(self, row: int) -> np.ndarray:
        return self.ids[self.cuts[self.point[row]]:self.cuts[self.point[row] + 1]]


def inner_products(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products summed from the first component to the last, the same for equal rows."""
    total = np.zeros(len(rows))
    for d in range(len(query)):
        total += rows[:, d] * query[d]
    return total


def nearest(rows: DataFrame, asked: Column, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding",
            miss: float = MISS, seed: int = 11, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row where ``asked`` holds, ``k`` near others.

    The score is the inner product of the vectors as they are, in double
    precision.  Ties go to smaller ids; copies of a vector are found together.
    Vectors that are NULL, empty, zero or hold NULL or non-finite components, and
    NULL ids, take no part, and only vectors of one length are compared; an
    empty table gives no rows; other columns are ignored.
    """
    kept = rows.filter(vectors.usable(F.col(vector), zero_too=False) & F.col(vec_id).isNotNull()).select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"),
        asked.alias("_asked"))
    reach = chi_square_bound(miss)

    def search(queries: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        out, lengths = [], part["vector"].map(len).to_numpy() if len(part) else np.empty(0)
        wanted = queries["vector"].map(len).to_numpy() if len(queries) else np.empty(0)
        for n in sorted(set(lengths.tolist()) & set(wanted.tolist())):
            ids = part["vec_id"].to_numpy()[lengths == n]
            data = np.ascontiguousarray(np.stack(part["vector"].to_numpy()[lengths == n]))
            directions = np.random.default_rng(seed).standard_normal((n + 1, DIMS))
            power = np.frexp(np.abs(data).max(axis=1))[1]
            bands = [Band(ids[power == p], data[power == p], directions) for p in sorted(set(power.tolist()))[::-1]]
            for q, v in zip(queries["vec_id"].to_numpy()[wanted == n].tolist(), queries["vector"][wanted == n]):
                query, found, floor = np.asarray(v, float), [], -math.inf
                projected = query @ directions[:-1]
                for band in bands:
                    at, named, floor = band.search(query, projected, q, k, reach, floor)
                    found.append((np.array(named, np.int64), inner_products(band.rows[at], query)))
                named, scores = (np.concatenate(x) for x in zip(*found))
                first = np.lexsort((named, -scores))[:k]
                out.append((np.full(len(first), q), named[first], scores[first]))
        columns = [np.concatenate(x) for x in zip(*out)] if out else [np.empty(0, np.int64)] * 2 + [np.empty(0)]
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), columns)))

    found = vectors.blocked(kept, kept.filter(F.col("_asked")), search,
                            "query_id long, vec_id long, score double", shard, block)
    return vectors.best(found, k)
