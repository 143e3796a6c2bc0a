import math
import random

import numpy as np
from pyspark.sql import functions as F

from lurewatch.llm import ann, topk

SCHEMA = "vec_id long, embedding array<float>, label int, vector string, score int"


def rows(n, seed=1, dims=16):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((5, dims))
    made = []
    for i in range(n):
        v = centres[i % 5] * 0.5 + rng.standard_normal(dims)
        made.append((i, [float(np.float32(x)) for x in v / np.linalg.norm(v)], i % 5, "x", 0))
    for i in range(0, n, 7):  # copies of one vector
        made[i] = (i, made[0][1], 0, None, None)
    odd = [None, [], [float("nan")] * dims, [1.0] * (dims - 1) + [None], [float("inf")] + [0.0] * (dims - 1), [0.0] * dims]
    return made + [(n + i, v, None, None, None) for i, v in enumerate(odd)] + [(None, made[3][1], 1, "y", 1)]


def taking_part(made, zero):
    return [(i, v) for i, v, *_ in made if i is not None and v and all(x is not None and math.isfinite(x) for x in v)
            and (zero or any(v))]


def brute(made, every, k, value, zero=True):
    out = set()
    kept = [(i, value(v)) for i, v in taking_part(made, zero)]
    for q, a in kept:
        if q % every == 0:
            scores = sorted(((-sum(x * y for x, y in zip(a, b)), i) for i, b in kept if i != q and len(a) == len(b)))[:k]
            out |= {(q, r, i, -s) for r, (s, i) in enumerate(scores, 1)}
    return out


def whole(v):
    return [math.floor(1024 * x) for x in v]


def test_top_k_is_exact(spark):
    made = rows(400)
    df = spark.createDataFrame(made, SCHEMA)
    for shard, block in ((8192, 2048), (60, 9)):
        found = topk.top_k(df, F.col("vec_id") % 10 == 0, 10, shard=shard, block=block)
        assert {tuple(r) for r in found.collect()} == brute(made, 10, 10, whole)


def test_top_k_of_few_and_negative_vectors(spark):
    made = [(0, [1.0, -1.0], 0, "", 0), (10, [-1.0, 1.0], 0, "", 0), (11, [-0.5, 0.25], 0, "", 0), (12, [3.0], 0, "", 0)]
    found = topk.top_k(spark.createDataFrame(made, SCHEMA), F.col("vec_id") % 10 == 0, 10)
    assert {tuple(r) for r in found.collect()} == brute(made, 10, 10, whole)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert topk.top_k(none, F.lit(True)).count() == 0
    assert ann.nearest(none, F.lit(True)).count() == 0


def test_random_searches_against_all_scores():
    rng = random.Random(3)
    for _ in range(60):
        n, dims, k = rng.randint(1, 80), rng.randint(1, 9), rng.randint(1, 12)
        data = np.array([[rng.randint(-6, 6) for _ in range(dims)] for _ in range(n)])
        shard, query = topk.Shard(np.arange(n), data), np.array([rng.randint(-6, 6) for _ in range(dims)])
        ids, scores = shard.search(query, 0, k)
        got = sorted(zip((-scores).tolist(), ids.tolist()))[:k]
        assert got == sorted((-int(data[i] @ query), i) for i in range(1, n))[:k]


def test_neighbours_reach_the_recall_and_have_exact_scores(spark):
    made = rows(1500)
    df = spark.createDataFrame(made, SCHEMA)
    want = brute(made, 20, 20, lambda v: v, zero=False)
    found = ann.nearest(df, F.col("vec_id") % 20 == 0, 20, shard=600, block=30).collect()
    scores = {(q, i): s for q, _, i, s in want}
    both = [r for r in found if (r.query_id, r.vec_id) in scores]
    assert len(found) == len(want) and len(both) >= 0.9 * len(want)
    assert all(abs(r.score - scores[r.query_id, r.vec_id]) < 1e-9 for r in both)
    by_query = {}
    for r in sorted(found, key=lambda r: (r.query_id, r["rank"])):
        assert by_query.get(r.query_id, (-9.0, -1)) < (-r.score, r.vec_id)
        by_query[r.query_id] = (-r.score, r.vec_id)


def test_chi_square():
    # Tail of 8 degrees of freedom at its 5 % point, from any table.
    assert abs(ann.chi_square_bound(0.05) - 15.507) < 1e-2
