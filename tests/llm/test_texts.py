"""Operators on documents against brute-force versions, with the odd cases of each."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lurewatch.llm import bpe, components, mixing, queries, simhash, substrings

ODD = [(90, None), (91, ""), (92, " \n\t"), (93, "one"), (94, "two words"), (None, "no id here at all"), (None, "no id here at all"),
       (95, "A B\x0bC\x1cD Ä ä ß 日本 " * 4), (96, "x" * 40_000 + " end"), (97, None), (97, None)]


def texts(n=120, seed=2):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "cc", "é", "日本", "x,y", "Ze", "q" * 30]
    base = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 90))) for _ in range(25)]
    return [(i, rng.choice(base)[rng.randint(0, 9):] + rng.choice([" ", "\n", "\t\x0b"]) + rng.choice(base)) for i in range(n)]


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


def repeats(rows, width):
    order = [1 << 63 if i is None else i for i, *_ in rows]
    first = {}
    for o, (_, t, *_) in zip(order, rows):
        w = words(t)
        for j in range(len(w) - width + 1):
            key = tuple(w[j:j + width])
            first[key] = min(first.get(key, o), o)
    out = Counter()
    for o, (i, t, *_) in zip(order, rows):
        w = words(t)
        covered = [False] * len(w)
        for j in range(len(w) - width + 1):
            if first[tuple(w[j:j + width])] < o:
                covered[j:j + width] = [True] * width
        out[i, len(w), sum(covered), b" ".join(x for x, c in zip(w, covered) if not c).decode()] += 1
    return out


@pytest.mark.parametrize("width,block", [(13, 2000), (13, 10**6), (30, 3000), (4, 3000)])
def test_substrings(spark, documents, width, block):
    rows = texts() + ODD + [(3, texts()[5][1]), (7, texts()[7][1])]
    got = substrings.deduplicate(documents(rows), width, block=block, bucket=3000)
    assert {"lang", "_row", "_block", "fp"} <= set(got.columns)
    found = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got.collect())
    assert found == repeats(rows, width)
    assert all(sum(n for _, n in r.spans) == r.n_removed for r in got.collect())


def test_substrings_verbatim_and_empty(documents):
    kept = substrings.deduplicate(documents([(1, "a  b"), (2, None)]), verbatim=True).select("doc_id", "kept_text")
    assert {tuple(r) for r in kept.collect()} == {(1, "a  b"), (2, None)}
    assert substrings.deduplicate(documents([])).count() == 0


def fingerprint(text):
    w = [x.lower() for x in words(text)]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i:i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def reach(nodes, linked):
    """Brute-force components: node -> set of nodes."""
    group = {x: {x} for x in nodes}
    for x in nodes:
        for y in nodes:
            if group[x] is not group[y] and linked(x, y):
                group[x] |= group[y]
                for z in group[y]:
                    group[z] = group[x]
    return group


def test_near_duplicates(documents):
    rows = texts(60) + ODD + [(200 + i, t) for i, (_, t) in enumerate(texts(60)[:15])]
    got = simhash.near_duplicates(documents(rows)).collect()
    prints = {fingerprint(t) for _, t in rows}
    group = reach(prints, lambda x, y: (x ^ y).bit_count() <= 2)
    least = defaultdict(lambda: None)
    for i, t in rows:
        for x in group[fingerprint(t)]:
            if i is not None:
                least[x] = i if least[x] is None else min(i, least[x])
    want = Counter((i, fingerprint(t), least[fingerprint(t)]) for i, t in rows)
    assert Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got) == want
    assert simhash.near_duplicates(documents([])).count() == 0


@pytest.mark.parametrize("cell", [2, 16])
@pytest.mark.parametrize("distance", [1, 2])
def test_links_of_dense_fingerprints(spark, cell, distance):
    rng = random.Random(cell)
    made = {rng.getrandbits(64) for _ in range(10)}
    for x in list(made):
        for _ in range(30):
            for _ in range(rng.randint(1, 3)):
                x ^= 1 << rng.randrange(64)
            made.add(x)
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in made]
    found = components.components(simhash.links(spark.createDataFrame(signed, "fp long"), distance, cell)).collect()
    group = reach(made, lambda x, y: (x ^ y).bit_count() <= distance)
    got = {r.node % (1 << 64): r.component for r in found}
    assert set(got) == {x for x in made if len(group[x]) > 1}
    for x in got:
        assert {y for y in got if got[y] == got[x]} == group[x]


def test_components_of_stars_rings_and_odd_links(spark):
    links = ([(1, k) for k in range(2, 40)] + [(100 + k, 100 + (k + 1) % 9) for k in range(9)]  # a star, a ring
             + [(205, 201), (205, 203), (201, 203)] + [(7, 7), (300, 300)]  # a triangle, self-links
             + [(None, 1), (400, None)] + [(1, 2)] * 3)
    found = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {k: 1 for k in range(1, 40)} | {100 + k: 100 for k in range(9)} | dict.fromkeys((201, 203, 205), 201)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_a_long_chain(spark):
    chain = list(range(200))
    random.Random(1).shuffle(chain)
    links = spark.createDataFrame(list(zip(chain, chain[1:])) + [(500, 501), (500, 501), (502, 502)], "a long, b long")
    found = {r.node: r.component for r in components.components(links).collect()}
    assert found == {**{i: 0 for i in range(200)}, 500: 500, 501: 500}


def test_representatives(documents):
    rows = [(5, "same text here now"), (3, "Same text HERE now"), (3, "Same text HERE now"), (8, "other words in this one"),
            (None, "same text here now"), (None, "alone with no id"), (None, "alone with no id")]
    kept = simhash.representatives(documents(rows))
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([rows[1], rows[3], rows[5]])


def encodings(rows):
    encoding = queries.vocabulary().encoding()
    return Counter((i, np.array(encoding.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t in rows)


@pytest.mark.parametrize("chunk,overlap", [(64, 16), (300, 50), (32_768, 256)])
def test_bpe_round_trip(documents, chunk, overlap):
    rng = random.Random(chunk)
    letters = "ab  \n'é日本1,.ll's　 "
    rows = ODD + [(i, "".join(rng.choice(letters) for _ in range(n))) for i, n in enumerate([0, 1, 63, 64, 65, 300, 2000, 5000])]
    rows += [(20, " " * 3000), (21, "日" * 2000), (21, "日" * 2000), (22, "<|endoftext|> don't")]
    words_ = queries.vocabulary()
    back = bpe.decode(bpe.encode(documents(rows), words_, chunk, overlap), words_)
    assert Counter((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in back.collect()) == encodings(rows)
    assert bpe.encode(documents([]), words_).count() == 0


def targets(sizes):
    """Sources by code point, None last; weights 5, 2, 1; 150 % in all, none above twice its size."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    full, left = {}, dict(weight)
    while left:
        level = (1.5 * sum(sizes.values()) - sum(full.values())) / sum(left.values())
        over = [s for s in left if left[s] * level >= 2 * sizes[s]]
        if not over:
            break
        for s in over:
            full[s] = 2.0 * sizes[s]
            del left[s]
    return {s: full.get(s, weight[s] * level) for s in names}


@pytest.mark.parametrize("group", [4096, 5])
def test_mix(documents, group):
    rng = random.Random(5)
    rows = [(i, " ".join("w" * rng.randint(1, 300) for _ in range(rng.randint(0, 60))), None,
             rng.choice(["b", "b", "b", "é", "a", None, "Z"])) for i in range(400)]
    rows += [(i, t, None, "odd") for i, t in ODD] + [(999, None, None, "empty")]
    df = documents(rows)
    got = mixing.mix(df, group=group, fan_in=3).collect()
    sizes = defaultdict(int)
    for _, t, _, s in rows:
        sizes[s] += len(words(t))
    want, taken, longest = targets(sizes), Counter(), Counter()
    assert Counter((r.doc_id, r.size, r.source) for r in got) == Counter((i, len(words(t)), s) for i, t, _, s in rows)
    for r in got:
        assert math.isclose(r.target, want[r.source]) and r.source_size == sizes[r.source]
        assert r.copies in (math.floor(r.target / max(r.source_size, 1)), math.floor(r.target / max(r.source_size, 1)) + 1, 0)
        assert r.copies * r.size <= 2 * r.size
        taken[r.source] += r.copies * r.size
        longest[r.source] = max(longest[r.source], r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= longest[s] + 1e-6
    again = mixing.mix(df.repartition(13, "text"), group=group, fan_in=3).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    assert mixing.mix(documents([])).count() == 0


def test_mix_takes_documents_as_they_are(documents):
    df = documents([(i % 40, f"text {i} " * (i % 7), None, "ab"[i % 2]) for i in range(120)])
    mixed, rows = mixing.mix(df).collect(), mixing.taken(df)
    assert rows.columns == df.columns
    assert rows.count() == sum(r.copies for r in mixed)
    assert rows.exceptAll(df.union(df)).count() == 0


def test_mix_is_unbiased(documents):
    df = documents([(i, "w " * (1 + i % 9), None, "a") for i in range(40)] + [(100, "w " * 400, None, "b")])
    runs = [mixing.mix(df, seed=s).filter("source = 'a'").agg(F.sum(F.col("copies") * F.col("size"))).first()[0] for s in range(3)]
    target = mixing.mix(df).filter("source = 'a'").first().target
    assert all(abs(x - target) <= 9 for x in runs)


def test_word_count(spark):
    from lurewatch.llm.common import word_count

    for i, t in ODD:
        assert spark.createDataFrame([(t,)], "t string").select(word_count(F.col("t"))).first()[0] == len(words(t))
