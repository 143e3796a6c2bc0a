"""Spelling variants of words, grouped by a reduced alphabet.

Every letter is hashed to one of a few symbols.  Words one edit apart have reduced
words at most one edit apart, so the one-edit neighbourhood of each distinct reduced
word joined with the reduced vocabulary finds every pair; the pairs of words behind it
are verified on their letters.  Each pair of neighbouring reduced words is generated from
one side alone: an insertion is a deletion of the longer word.  The number of symbols follows the size of the vocabulary, so that the
reduced words of few letters do not become crowded: neighbourhoods grow with the
logarithm of the vocabulary, candidates in proportion to it.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import stored
from .words import mixed

#: Runs of letters. Fixed value.
LETTERS = "[A-Za-zÀ-ÿ]+"
#: Distinct runs that a task holds before it hands its counts over.
HELD = 200_000
_BASE = np.uint64(0x9E3779B97F4A7C15)


def counted_runs(docs: DataFrame, every: int = 97, shortest: int = 5) -> DataFrame:
    """``word, n``: the runs of letters of every whole text and how often each occurs.

    A-Z are lower-cased.  ``h`` is the crc32 of ``<doc_id>:<run>``; where ``every``
    divides it, the run loses its code point ``h % length``.  With a NULL id nothing is
    deleted; a NULL or empty text has no runs.  Tasks count before the shuffle.
    """
    letters = re.compile(LETTERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def told() -> pa.RecordBatch:
            words = [(w, n) for w, n in ((b.decode("utf-8"), n) for b, n in held.items()) if len(w) >= shortest]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in words], pa.string()),
                                               pa.array([n for _, n in words], pa.int64())], ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                start = None if doc_id is None else zlib.crc32(f"{doc_id}:".encode())
                own: Counter = Counter()
                for word, n in Counter(letters.findall(text.as_py() or "")).items():
                    own[word.encode().lower()] += n  # on bytes, A-Z alone
                for word, n in own.items():
                    if start is not None and (h := zlib.crc32(word, start)) % every == 0:
                        letter_list = word.decode("utf-8")
                        at = h % len(letter_list)
                        word = (letter_list[:at] + letter_list[at + 1:]).encode()
                    held[word] += n
                if len(held) > HELD:
                    yield told()
        yield told()

    parts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def alphabet(words: int) -> int:
    """Symbols of the reduced alphabet: six of them tell about a quarter as many words apart as there are."""
    size = 4
    while size < 64 and 4 * size ** 6 < words:
        size *= 2
    return size


def symbols(word: str, size: int) -> np.ndarray:
    """The reduced word."""
    return (mixed(np.array([ord(c) for c in word], np.uint64), 5) % np.uint64(size)).astype(np.uint64)


def key(reduced: np.ndarray) -> np.ndarray:
    """A 64-bit key of each row of symbols, the length included."""
    out = np.full(reduced.shape[0], reduced.shape[1] + 1, np.uint64)
    for j in range(reduced.shape[1]):
        out = out * _BASE + reduced[:, j] + np.uint64(1)
    return mixed(out)


def neighbourhood(reduced: np.ndarray, size: int) -> np.ndarray:
    """The distinct keys of a reduced word and of its one-edit neighbours, each pair of neighbours from one side.

    A longer word makes all its deletions, which are the insertions of the shorter one,
    and a replacement is made from the smaller symbol to the larger.
    """
    n = len(reduced)
    at = np.arange(n)
    shorter = np.array([np.delete(reduced, i) for i in at], np.uint64).reshape(n, max(0, n - 1))
    place, symbol = np.nonzero(np.arange(size, dtype=np.uint64)[None, :] > reduced[:, None])
    other = np.repeat(reduced[None, :], len(place), axis=0)
    other[np.arange(len(place)), place] = symbol
    return np.unique(np.concatenate([key(shorter), key(other), key(reduced[None, :])]))


def near_pairs(words: DataFrame, size: int) -> DataFrame:
    """``a, b`` (a < b): all pairs of the distinct ``word`` values that are exactly one edit apart."""
    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [symbols(w, size) for w in batch.column("word").to_pylist()]
            keys = np.array([key(r[None, :])[0] for r in made], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(keys), pa.array(
                [r.astype(np.uint8).tobytes() for r in made], pa.binary())], ["word", "key", "reduced"])

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(0, len(batch), 1000):  # bounds what is held at a time
                rows = batch.slice(part, 1000)
                made = [neighbourhood(np.frombuffer(r, np.uint8).astype(np.uint64), size)
                        for r in rows.column("reduced").to_pylist()]
                yield pa.RecordBatch.from_arrays([
                    rows.column("key").take(pa.array(np.repeat(np.arange(len(rows)), [len(m) for m in made]))),
                    pa.array(np.concatenate(made).view(np.int64))], ["key", "other"])

    coded = stored(words.select("word").mapInArrow(reduce, "word string, key long, reduced binary"), "spelling-reduced")
    vocabulary = coded.groupBy("key").agg(F.first("reduced").alias("reduced"))
    met = vocabulary.mapInArrow(expand, "key long, other long").join(
        coded.select(F.col("key").alias("other")).distinct(), "other")
    pairs = (met.join(coded.select("key", F.col("word").alias("x")), "key")
             .join(coded.select(F.col("key").alias("other"), F.col("word").alias("y")), "other")
             .filter((F.col("key") != F.col("other")) | (F.col("x") < F.col("y"))))
    pairs = pairs.filter((F.abs(F.length("x") - F.length("y")) <= 1) & (F.levenshtein("x", "y", 1) == 1))
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for the rows of ``forms (word, form)``, none NULL: the last word on the way of forms.

    The way doubles each round; a form is at least twice as frequent as its word, so ways are short and never meet themselves.
    """
    at = stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        joined = stored(at.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root"),
                                                               F.col("_next").isNotNull().alias("moved")), "spelling-roots")
        at = joined.select("word", "root")
        if joined.filter("moved").isEmpty():
            return at


def groups(docs: DataFrame, every: int = 97, shortest: int = 5, least: int = 3, size: int | None = None) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every word of ``shortest`` letters that occurs ``least`` times.

    Near words differ by one inserted, deleted or replaced code point.  ``form`` is the
    most frequent near word (ties: the first in code-point order) if it is at least twice
    as frequent, else NULL; ``root`` follows the forms to the last.  An empty table has no
    words; other columns of ``docs`` are ignored; repeated rows count each time.
    """
    words = stored(counted_runs(docs, every, shortest).filter(F.col("n") >= least), "spelling-words")
    pairs = stored(near_pairs(words, size or alphabet(words.count())), "spelling-pairs")
    both = pairs.union(pairs.select("b", "a")).toDF("word", "near")
    best = (both.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near").groupBy("word")
            .agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("_best")))
    chosen = -F.col("_best.less") >= 2 * F.col("n")
    named = stored(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(chosen, F.col("_best.near")).alias("form"), F.when(chosen, -F.col("_best.less")).alias("form_n")), "spelling-forms")
    last = roots(named.filter(F.col("form").isNotNull()))
    return (named.join(last, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
