"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint of 64 bits is cut into 16 segments of 4 bits, and its embedding is
the vector of their bit counts.  A differing bit changes one count by one at
most, so the Manhattan distance of two embeddings never exceeds the Hamming
distance of their fingerprints.  Pairs within distance 2 of each other are found
by a range join on the integer grid: two points at distance 2 or less have a grid
point within distance 1 of both, so each point is entered in its own cell and in
the neighbouring cells one step away (33 at most), and cells are joined on
equality.  Pairs that meet in a cell are verified on the full fingerprints.

A cell that holds more than ``CELL`` fingerprints is not expanded into pairs.
Its members enter instead their fingerprint and its 64 one-bit changes; all that
share such a value are within 2 bits of each other, and each is linked to the
smallest alone.  That loses no connection and writes 65 rows a fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .common import merged, packed, stored, unpacked
from .components import components

SEGMENTS, BITS = 16, 4
#: Most fingerprints of a cell that are compared pair by pair.
CELL = 16
SEED = 42
#: Shingles counted at a time; bounds the memory for a very long text.
BLOCK = 1 << 16


def simhash(text: str | None, words: int = 3) -> int:
    """The fingerprint of one text, as an unsigned number; 0 for a text without words.

    On bytes, ``lower`` changes A-Z alone and ``split`` cuts at space and 0x09-0x0D alone.
    """
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined, digest = b" ".join(parts), xxhash.xxh64_intdigest
    if len(parts) <= words:
        return digest(joined, SEED)
    ends = np.cumsum([len(p) + 1 for p in parts])
    starts = np.concatenate(([0], ends[:-words])).tolist()
    stops = (ends[words - 1:] - 1).tolist()
    counts = np.zeros(64, np.int64)
    for i in range(0, len(starts), BLOCK):
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in
                              zip(starts[i:i + BLOCK], stops[i:i + BLOCK])), "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """``doc_id, fp, text_hash`` for every row; nothing is shuffled.

    ``fp`` is the fingerprint as a signed long, ``text_hash`` tells texts of one id
    apart.  A NULL, empty or blank text has the fingerprint 0; other columns are ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.fromiter((simhash(t.as_py(), words) for t in batch.column("text")), np.uint64, len(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made.view(np.int64)),
                                              batch.column("text_hash")], ["doc_id", "fp", "text_hash"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_hash().alias("text_hash")).mapInArrow(
        run, "doc_id long, fp long, text_hash long")


def text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _segment(fp: Column, i: int) -> Column:
    return F.bit_count(F.shiftrightunsigned(fp, BITS * i).bitwiseAND(F.lit((1 << BITS) - 1))).cast("long")


def cells(fps: DataFrame) -> DataFrame:
    """``fp, cell``: each fingerprint in its own grid cell and those one step away.

    A cell is written as 16 counts of 3 bits each in a long.
    """
    counts = [_segment(F.col("fp"), i) for i in range(SEGMENTS)]
    home = counts[0]
    for i, c in enumerate(counts[1:], 1):
        home = home.bitwiseOR(F.shiftleft(c, 3 * i))
    rows = fps.select("fp", F.array(*counts).alias("_c"), home.alias("_home"))
    steps = F.array(*[F.lit(1 << 3 * i).cast("long") for i in range(SEGMENTS)])
    up = F.filter(F.transform(steps, lambda s, i: F.when(F.get("_c", i) < BITS, F.col("_home") + s)),
                  lambda x: x.isNotNull())
    down = F.filter(F.transform(steps, lambda s, i: F.when(F.get("_c", i) > 0, F.col("_home") - s)),
                    lambda x: x.isNotNull())
    return rows.select("fp", F.explode(F.concat(F.array("_home"), up, down)).alias("cell"))


def links(fps: DataFrame, distance: int = 2, cell: int = CELL) -> DataFrame:
    """``a, b`` (a < b): links that connect what lies within ``distance`` (1 or 2) bits.

    ``fps`` holds distinct fingerprints.  From small cells come all close pairs,
    from large ones enough to connect them.
    """
    entered = cells(fps)
    sizes = entered.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = stored(entered.join(merged(sizes), "cell"), "simhash-cells")
    few = shared.filter(F.col("n") <= cell)
    pairs = F.filter(F.flatten(F.transform("_in", lambda x, i: F.transform(
        F.slice("_in", i + 2, F.size("_in")), lambda y: F.when(
            F.bit_count(x.bitwiseXOR(y)) <= distance, F.struct(x.alias("a"), y.alias("b")))))),
        lambda p: p.isNotNull())
    # No list here is longer than ``cell``.
    found = (few.groupBy("cell").agg(F.sort_array(F.collect_list("fp")).alias("_in"))
             .select(F.explode(pairs).alias("p")).select("p.a", "p.b"))
    many = shared.filter(F.col("n") > cell).select("fp").distinct()
    one = F.array(*[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)])
    changed = many.select("fp", F.explode(F.concat(
        F.array(F.lit(0).cast("long")), one)).alias("_m")).select("fp", F.col("fp").bitwiseXOR(F.col("_m")).alias("_v"))
    if distance < 2:
        changed = changed.filter("fp = _v").unionByName(
            changed.filter("fp <> _v").join(merged(many.withColumnRenamed("fp", "_v")), "_v", "left_semi"))
        star = changed.select(F.least("fp", "_v").alias("a"), F.greatest("fp", "_v").alias("b"))
    else:
        least = changed.groupBy("_v").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
        star = changed.join(merged(least), "_v").select("a", F.col("fp").alias("b"))
    return found.unionByName(star.filter("a < b")).distinct()


def near_duplicates(docs: DataFrame, words: int = 3, distance: int = 2) -> DataFrame:
    """``doc_id, fp, text_hash, component_id, component`` for every row of ``docs``.

    ``component`` is the smallest fingerprint of a component, and ``component_id`` is the smallest ``doc_id`` reachable over links of
    ``distance`` differing bits or fewer.  Equal fingerprints are one node, so
    groups of copies cost one row each.  Repeated rows get equal results; a NULL
    ``doc_id`` is reached like others but never names a component unless the
    component has no other id; an empty table gives no rows.
    """
    marked = stored(fingerprints(docs, words), "simhash-fp")
    nodes = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-nodes")
    joined = components(stored(links(nodes.select("fp"), distance), "simhash-links"))
    named = nodes.join(merged(joined.withColumnRenamed("node", "fp")), "fp", "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("_component"))
    named = stored(named, "simhash-named")
    first = named.groupBy("_component").agg(F.min("first").alias("component_id"))
    linked = named.join(merged(first), "_component").select("fp", "component_id", F.col("_component").alias("component"))
    # A fingerprint with very many documents is spread over the tasks by AQE's skew join.
    return marked.join(merged(linked), "fp").select("doc_id", "fp", "text_hash", "component_id", "component")


def representatives(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, one for each component: its smallest id, of repeated rows one.

    Rows with a NULL id stay only where a component has no other.
    """
    return first_of_each(docs, near_duplicates(docs, **options))


def first_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``docs``, one for each ``component`` of ``found (doc_id, text_hash, component)``."""
    unnamed = F.col("doc_id").isNull()
    first = found.groupBy("component").agg(F.min(F.struct(unnamed.alias("unnamed"), "doc_id", "text_hash")).alias("_r"))
    kept = first.select(F.coalesce(F.col("_r.doc_id").cast("string"), F.lit("null")).alias("_id"),
                        F.col("_r.text_hash").alias("_hash")).distinct()
    rows = docs.select(packed(docs.columns), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("_id"),
                       text_hash().alias("_hash"))
    alike = Window.partitionBy("_id", "_hash").orderBy(F.lit(0))
    return (rows.join(kept, ["_id", "_hash"], "left_semi").withColumn("_nth", F.row_number().over(alike))
            .filter("_nth = 1").select(*unpacked(docs.columns)))
