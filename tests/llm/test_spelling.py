"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lurewatch.llm import queries, spelling

SF = "/root/testdata/sf0.001"


def words(rows, least=3):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc_id}:{run}".encode()) if doc_id is not None else 1
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= least}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i:] == b[i + 1:] or (len(a) == len(b) and a[i + 1:] == b[i + 1:])


def expected(rows):
    n = words(rows)
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def got(df):
    rows = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_made_words(documents):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdeéÿABC") for _ in range(rng.randint(4, 9))) for _ in range(60)]
    text = []
    for w in base:
        for _ in range(rng.randint(1, 30)):
            v = list(w)
            if rng.random() < 0.5:
                v[rng.randrange(len(v))] = rng.choice("abÀc")
            elif rng.random() < 0.5:
                v.insert(rng.randrange(len(v)), "a")
            text.append("".join(v))
    rng.shuffle(text)
    rows = [(i, " ".join(text[i::7])) for i in range(7)] + [(None, "a×bcde" * 3), (7, None), (8, ""), (3, "bcde fabcd" * 40)]
    rows += [(9, "x" * 300 + " " + "x" * 299), (9, "x" * 300 + " " + "x" * 299), (10, ("x" * 300 + " " + "x" * 299 + " ") * 3)]
    for size in (None, 4, 64):
        assert got(spelling.groups(documents(rows), size=size)) == expected(rows)
    assert got(spelling.groups(documents([]))) == set()


def test_neighbourhoods_meet_in_every_edit():
    """Of two different reduced words one edit apart, at least one generates the other."""
    def own(e):
        return int(spelling.key(np.array(e, np.uint64).reshape(1, -1))[0])

    rng = np.random.default_rng(1)
    for n in (1, 2, 5):
        w = tuple(rng.integers(0, 4, n).tolist())
        edits = {w[:i] + w[i + 1:] for i in range(n)} | {w[:i] + (s,) + w[i + k:] for k in (0, 1) for i in range(n + 1 - k) for s in range(4)}
        made = set(spelling.neighbourhood(np.array(w, np.uint64), 4).tolist())
        assert own(w) in made and made <= {own(e) for e in edits | {w}}
        for e in edits - {w}:
            assert (own(e) in made) != (own(w) in spelling.neighbourhood(np.array(e, np.uint64), 4).tolist())


def test_given_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert got(queries.QUERIES["op11_spelling_variants"](spark, SF)) == expected(rows)


def test_counts_do_not_depend_on_the_batch(documents, monkeypatch):
    rows = [(i, f"hello world{'s' * (i % 3)} again") for i in range(200)]
    monkeypatch.setattr(spelling, "HELD", 2)
    df = documents(rows).withColumn("n", F.lit(9))
    assert {r.word: r.n for r in spelling.counted_runs(df).collect()} == words(rows, 1)
