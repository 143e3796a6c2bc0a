"""The near-duplicate stage against the similarity of every pair of texts."""

import random
from collections import Counter, defaultdict

import corpus_pipeline
from lurewatch.llm import shingles

SF = "/root/testdata/sf0.01"


def grams(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def components(rows):
    """The components of (id, text) rows over pairs of Jaccard 0.8 or more, each as a set of places."""
    sets, at, up = [grams(t) for _, t in rows], defaultdict(list), list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, s in enumerate(sets):
        shared = Counter(j for g in s for j in at[g])
        for j, n in shared.items():
            if 5 * n >= 4 * (len(s) + len(sets[j]) - n):
                up[root(i)] = root(j)
        for g in s or [None]:
            if not s and at[g]:
                up[root(i)] = root(at[g][0])
            at[g].append(i)
    out = defaultdict(set)
    for i in range(len(rows)):
        out[root(i)].add(i)
    return list(out.values())


def smallest(rows):
    return Counter(min(rows[i][0] for i in c) for c in components(rows))


def test_edited_copies_go(documents):
    rng = random.Random(4)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(248)]

    def edited(n):
        w = list(base)
        for k in range(n):
            w[10 + 40 * k] = f"new{rng.random()}"
        return " ".join(w)

    # Three edits leave 0.88 of the shingles, six 0.78; words written otherwise are the same.
    rows = [(5, " ".join(base)), (7, edited(3)), (3, " ".join(base).upper()), (9, edited(6)), (11, "a b"), (12, "A  b"),
            (13, None), (14, " ")]
    kept = corpus_pipeline.drop_near_duplicates(documents(rows).sparkSession, documents(rows), SF)
    assert Counter(r.doc_id for r in kept.collect()) == smallest(rows) == Counter([3, 9, 11, 13])


def test_members_of_a_band_that_differ_from_its_least(documents):
    rng = random.Random(8)
    groups = [[f"g{g}w{rng.randint(0, 10**6)}" for _ in range(300)] for g in range(3)]
    rows = []
    for i in range(150):  # chains: each text differs from the one before in three words
        w = groups[i % 3]
        for _ in range(3):
            w[rng.randrange(300)] = f"n{rng.random()}"
        rows.append((i, " ".join(w)))
    kept = shingles.representatives(documents(rows))
    assert Counter(r.doc_id for r in kept.collect()) == smallest(rows)


def test_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    kept = [r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).select("doc_id").collect()]
    assert Counter(kept) == smallest(rows)
