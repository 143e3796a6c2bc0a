"""Whitening against exact sums and a library eigensolver."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lurewatch.llm import queries, whitening

SF = "/root/testdata/sf0.01"


def check(rows, found, k=4):
    """``rows`` (id, vector) of one length that take part, against what was found."""
    x = [[math.floor(256 * float(c)) for c in v] for _, v in rows]
    fit = sorted({tuple(v) for v in x})
    n, d = len(fit), len(x[0])
    sums = [sum(v[i] for v in fit) for i in range(d)]
    centred = np.array([[v[i] - sums[i] / n for i in range(d)] for v in fit])
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(k, int((values > values[0] * 1e-12).sum()))
    by = defaultdict(list)
    for r in found:
        by[r.vec_id].append(r)
    assert len(found) == k * len(rows)
    sign = {}
    for (i, _), v in zip(rows, x):
        own = sorted(by[i], key=lambda r: r.component)
        want = sum((n * a - s) ** 2 for a, s in zip(v, sums))
        for r in own:
            j = r.component - 1
            assert r.n == n and int(r.deviation) == want
            assert r.explained == pytest.approx(values[j] / np.trace(cov), rel=1e-9)
            assert r.identity_error < 1e-9
            flat = abs(values - values[j]) < 1e-9 * values[0]
            if flat.sum() == 1:  # else any basis of the space will do
                w = (np.array(v) - np.array(sums) / n) @ vectors[:, j] / math.sqrt(values[j])
                if abs(w) > 1e-6:
                    sign.setdefault(j, np.sign(w * r.whitened))
                    assert r.whitened == pytest.approx(sign[j] * w, rel=1e-7, abs=1e-9)


def whitened(df, **options):
    return whitening.whiten(df, whitening.fit(df, **options), carry=["vec_id"]).collect()


def test_given_embeddings(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    found = queries.QUERIES["op13_whitened_embeddings"](spark, SF).collect()
    ids = [i for i, _ in rows]
    assert len(ids) == len(set(ids))
    check(rows, found)


def test_odd_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(60)]
    rows += [(100 + i, rows[0][1]) for i in range(500)]  # copies count once
    odd = [(900, None), (901, []), (902, [1.0] * 5 + [None]), (903, [float("nan")] * 6), (904, [float("inf")] + [0.0] * 5),
           (905, [1e300] + [0.0] * 5), (907, [0.5, 1.5])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumns(
        {c: F.lit("x") for c in ("_x", "_c", "_row", "_vector", "d", "n", "whitened")})
    check(rows, whitened(df))
    assert "d" in whitening.whiten(df, whitening.fit(df)).columns
    empty = df.filter("vec_id < 0")
    assert whitened(empty) == []


def test_huge_numbers_are_exact(spark):
    rng = np.random.default_rng(6)
    rows = [(i, (rng.normal(size=4) * 2.0 ** 33).tolist()) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = whitened(df)
    x = [[math.floor(256 * c) for c in v] for _, v in rows]
    sums = [sum(c) for c in zip(*x)]
    for r in found:
        assert int(r.deviation) == sum((40 * a - s) ** 2 for a, s in zip(x[r.vec_id], sums))
    check(rows, found)


def test_few_dimensions_and_no_variance(spark):
    rng = np.random.default_rng(7)
    rows = [(i, [float(a), float(a) * 2, 5.0]) for i, a in enumerate(rng.normal(size=50).round(1))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = whitened(df)
    assert {r.component for r in found} <= {1, 2}  # the third dimension never varies
    assert whitened(df.filter("vec_id = 0")) == []


def test_equal_eigenvalues(spark):
    rows = [(2 * i + s, [(-1.0) ** s if j == i else 0.0 for j in range(5)]) for i in range(5) for s in (0, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    check(rows, whitened(df))


@pytest.mark.parametrize("seed", range(6))
def test_spectrum_slicing(seed):
    rng = np.random.default_rng(seed)
    d = [1, 2, 7, 30, 64, 64][seed]
    q, _ = np.linalg.qr(rng.normal(size=(d, d)))
    e = np.sort(rng.random(d) ** 3)[::-1] if seed < 5 else np.repeat([3.0, 3.0 - 1e-9, 2.0, 1.0], 16)
    v = (q * e) @ q.T
    v = (v + v.T) / 2
    values, vectors = whitening.leading(v, 6)
    assert np.allclose(values, np.sort(np.linalg.eigvalsh(v))[::-1][:6], rtol=1e-10, atol=0)
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-9
    assert np.abs(v @ vectors - vectors * values).max() < 1e-12 * max(1, e.max()) * 100
    for s in (*(e[:3] * 1.001), e.mean(), 0.0):
        assert whitening.positive_pivots(v - s * np.eye(d)) == (np.linalg.eigvalsh(v) > s).sum() or s == 0.0
