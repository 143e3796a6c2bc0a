"""Near duplicates for a corpus: close SimHash fingerprints or alike sets of word shingles.

Two texts are linked if the fingerprints of their shingles differ in two bits or fewer
(``simhash``), or if their sets of shingles have a Jaccard similarity of 0.8 or more
(``jaccard``).  Fingerprints alone let most edited copies pass: at a similarity of 0.8
to 0.9 they differ in 3 to 8 bits.  Both searches give a component to each text; a
small graph between the two kinds of components joins them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import jaccard, simhash
from .common import stored
from .components import components

WORDS, SHARE, DISTANCE = 5, (4, 5), 2
#: Characters of a block of texts and of a bucket of hashes: half of ``jaccard``'s, as workers of other stages live on beside.
BLOCK, BUCKET = 2_000_000, 4_000_000


def near_duplicates(docs: DataFrame, words: int = WORDS, share: tuple[int, int] = SHARE, distance: int = DISTANCE) -> DataFrame:
    """``doc_id, text_hash, component`` for every row of ``docs``.

    Words are cut at space and 0x09-0x0D, A-Z in lower case.  Texts without words are one
    component (their fingerprint is zero); texts of ``words`` words or fewer are one
    shingle.  Repeated rows, NULL ids and empty tables are as in ``simhash``.
    """
    close = stored(simhash.near_duplicates(docs, words, distance), "shingles-close")
    alike = jaccard.near_duplicates(docs, words, share, BLOCK, BUCKET)
    by_text = close.groupBy("text_hash").agg(F.min("component").alias("_close"))
    both = (alike.groupBy("text_hash").agg(F.min("component").alias("_alike")).filter(F.col("_alike").isNotNull())
            .join(by_text, "text_hash").select(F.xxhash64(F.lit("close"), "_close").alias("a"),
                                               F.xxhash64(F.lit("alike"), "_alike").alias("b")).distinct())
    joined = components(stored(both, "shingles-links"))
    rows = close.select("doc_id", "text_hash", F.xxhash64(F.lit("close"), "component").alias("node"))
    return rows.join(joined, "node", "left").select("doc_id", "text_hash", F.coalesce("component", "node").alias("component"))


def representatives(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, one for each component: its smallest id, of repeated rows one."""
    return simhash.first_of_each(docs, near_duplicates(docs, **options))
