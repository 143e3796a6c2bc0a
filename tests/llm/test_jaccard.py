"""The n-gram join against the similarity of every pair of documents."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lurewatch.llm import jaccard, queries


def grams(text, words):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def expected(rows, words=4, share=(85, 100)):
    """Counted (doc_id, n_shingles, component_id) over all pairs that share an n-gram."""
    sets, at, up = [grams(t, words) for _, t in rows], defaultdict(list), list(range(len(rows)))

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i, s in enumerate(sets):
        for j, n in Counter(j for g in s for j in at[g]).items():
            if share[1] * n >= share[0] * (len(s) + len(sets[j]) - n):
                up[root(i)] = root(j)
        for g in s:
            at[g].append(i)
    least = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)].append(doc_id)
    return Counter((d, len(s), min(least[root(i)], default=None) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def found(docs, **options):
    got = jaccard.named(jaccard.near_duplicates(docs, **options))
    return Counter(tuple(r) for r in got.select("doc_id", "n_shingles", "component_id").collect())


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        i = rng.randrange(len(words))
        words[i:i + rng.choice([0, 1, 1, 1])] = [f"n{rng.random()}"] * rng.choice([0, 1, 1, 2])
    return " ".join(words)


@pytest.mark.parametrize("words, share", [(4, (85, 100)), (5, (4, 5)), (2, (1, 2))])
def test_edited_copies(documents, words, share):
    rng = random.Random(words)
    rows = []
    for g in range(12):
        base = [f"g{g}w{rng.randint(0, 10**6)}" for _ in range(rng.choice([3, 4, 5, 9, 40, 150, 400]))]
        for _ in range(rng.choice([2, 5, 40])):
            rows.append((len(rows), edited(rng, base, rng.randint(0, 1 + len(base) // 25))))
    rows += [(9000, None), (9001, ""), (9001, " \n"), (9002, "a b"), (9003, "A  b"), (9004, "a"), (9005, "a b c d"), (None, "A B C D"),
             (None, None), (3, rows[2][1]), (3, rows[2][1]), (9006, "é à"), (9007, "É à")]
    rows += [(9100 + i, "c d e f " * 50) for i in range(50)] + [(9200, "c d e f " * 5000)]
    rng.shuffle(rows)
    assert found(documents(rows), words=words, share=share, block=20_000, bucket=10_000) == expected(rows, words, share)


def test_chains_and_common_passages(documents):
    rng = random.Random(8)
    rows, chains = [], [[f"g{g}w{rng.randint(0, 10**6)}" for _ in range(200)] for g in range(2)]
    for i in range(160):  # each text differs from the one before in three words
        for _ in range(3):
            chains[i % 2][rng.randrange(200)] = f"n{rng.random()}"
        rows.append((i, " ".join(chains[i % 2])))
    lines = [" ".join(f"l{k}x{rng.randint(0, 10**6)}" for _ in range(12)) for k in range(12)]
    for i in range(150):  # nothing but common lines
        rows.append((1000 + i, " ".join(rng.sample(lines, 8))))
    assert found(documents(rows)) == expected(rows)


def test_a_large_group_of_unlike_copies_costs_few_comparisons(documents, monkeypatch):
    """Copies of one text with one to six changed words: most are like the text itself and none other."""
    rng = random.Random(2)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(150)]
    rows = [(0, " ".join(base))]
    for i in range(1, 1500):
        w = list(base)
        for k in rng.sample(range(150), rng.randint(1, 6)):
            w[k] = f"n{rng.random()}"
        rows.append((i, " ".join(w)))
    made, verified = [], jaccard._verified
    monkeypatch.setattr(jaccard, "_verified", lambda pairs, *more: made.append(pairs.count()) or verified(pairs, *more))
    assert found(documents(rows)) == expected(rows)
    assert sum(made) < 20 * len(rows)


def test_empty_and_unlinked_tables(documents):
    assert found(documents([])) == Counter()
    rows = [(1, "one two three four five"), (2, "six seven eight nine ten"), (3, None)]
    assert found(documents(rows)) == expected(rows)


def test_many_equal_rows(spark):
    docs = spark.range(200_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a b c d e f").alias("text"))
    assert found(docs, block=1000) == {(None, 3, None): 200_000}
    # A hot text reaches each block once, and folds before the block is read.
    hot = docs.repartition(40)
    assert jaccard._dealt(hot, 4).groupBy("_block").count().toDF("b", "n").filter("n > 1").isEmpty()
    assert jaccard._dealt(hot, 4).count() == 4


def test_hashes_travel_unchanged():
    keys = np.sort(np.random.default_rng(0).integers(0, 1 << 48, 1000, dtype=np.uint64))
    assert (jaccard._unpacked([jaccard._packed(keys[:10]), jaccard._packed(keys[10:])]) == keys).all()


def test_given_documents(spark):
    for sf in ("sf0.001", "sf0.01"):
        path = f"/root/testdata/{sf}"
        rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]
        got = queries.QUERIES["op12_ngram_jaccard_join"](spark, path)
        assert Counter(tuple(r) for r in got.select("doc_id", "n_shingles", "component_id").collect()) == expected(rows)
