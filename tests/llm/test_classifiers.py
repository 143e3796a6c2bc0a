import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lurewatch.llm import labelled, queries, quality, toxicity
from tests.check_oracle import connect

SF = "/root/testdata/sf0.01"
MODULES = [(toxicity, "toxic"), (quality, "quality")]


def made_up(n=300, seed=4):
    """Texts of made-up words; a third has words of a bad kind, another third endless repeats."""
    rng = random.Random(seed)
    syllables = ["ta", "ro", "mi", "ne", "su", "ka", "lo"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    rows, labels = [], []
    for i in range(n):
        text = [word() for _ in range(rng.randint(8, 80))]
        if i % 3 == 0:
            text = [rng.choice(["grubvile", "snarkox"]) + (word() if rng.random() < 0.3 else "") if rng.random() < 0.2 else w for w in text]
        if i % 3 == 1:
            text = [w for w in text[:10] for _ in range(8)]
        rows.append((i, " ".join(text)))
        labels.append((i, int(i % 3 != 1), int(i % 3 == 0)))
    return rows, labels


@pytest.mark.parametrize("module,label", MODULES)
def test_learns_from_the_allowed_rows_alone(spark, documents, module, label):
    rows, labels = made_up()
    known = spark.createDataFrame(labels + [(None, 1, 1), (5000, None, None), (0, 1, 1)], "doc_id long, quality int, toxic int")
    docs = documents(rows)
    learn = labelled.fold(F.col("doc_id"), 5) != 0
    scored = {r.doc_id: r.score for r in module.score(docs, module.fit(docs, known, learn)).collect()}
    at = {"quality": 1, "toxic": 2}[label]
    held = [x for x in labels if zlib.crc32(str(x[0]).encode()) % 5 == 0]
    right = [(scored[x[0]] >= 0.5) == bool(x[at]) for x in held]
    assert len(held) > 30 and np.mean(right) > 0.9
    # Labels of held-out rows do not matter.
    turned = known.withColumn(label, F.when(learn, F.col(label)).otherwise(1 - F.col(label)))
    again = {r.doc_id: r.score for r in module.score(docs, module.fit(docs, turned, learn)).collect()}
    assert again == scored


@pytest.mark.parametrize("module,label", MODULES)
def test_odd_texts_and_missing_labels(spark, documents, module, label):
    rows, labels = made_up(90)
    odd = [(900, None), (901, ""), (902, " \n "), (903, "x" * 200_000), (904, "\x00\x1c￿ 日本"), (None, "no id"), (905, "a"), (905, "a")]
    docs, known = documents(rows + odd), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = module.fit(docs, known, F.lit(True))
    found = module.score(docs, model).collect()
    assert len(found) == len(rows) + len(odd) and all(0 <= r.score <= 1 for r in found)
    assert len({r.score for r in found if r.doc_id == 905}) == 1
    assert module.score(docs.limit(0), model).count() == 0
    nothing = module.fit(docs, known.limit(0), F.lit(True))
    assert {r.score for r in module.score(docs, nothing).collect()} == {0.0}


def test_quadratic_discriminant_agrees_with_its_formula():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((200, 4)) @ rng.standard_normal((4, 4))
    g = quality.Gaussian(x, np.eye(4))
    cov = g.factor @ g.factor.T
    at = x[:5] - g.mean
    want = -0.5 * np.einsum("ij,jk,ik->i", at, np.linalg.inv(cov), at) - 0.5 * np.linalg.slogdet(cov)[1]
    assert np.allclose(g.log_density(x[:5]), want)


@pytest.mark.parametrize("name,label", [("op5_quality_discriminant", "quality"), ("op3_compression_toxicity", "toxic")])
def test_held_out_rows(spark, name, label):
    found = {r.doc_id: r for r in queries.QUERIES[name](spark, SF).collect()}
    rows = connect(SF).execute(f"SELECT doc_id, {label} FROM labels").fetchall()
    right = [found[i].predicted == y for i, y in rows if found[i].held_out]
    # Toxic words of few labelled rows are too rare to learn at this size.
    assert len(right) > 20 and np.mean(right) > (0.95 if label == "quality" else 0.85)
    assert all(found[i].held_out == (zlib.crc32(str(i).encode()) % (4 if label == "quality" else 5) == (2 if label == "quality" else 0)) for i in found)
