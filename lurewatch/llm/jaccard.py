"""N-gram Jaccard join: which documents are connected by sets of word n-grams that are alike.

Prefix filtering, rare first.  All n-grams are ordered by how many sets hold them (a
class that grows with its logarithm, then the hash).  Two sets with Jaccard similarity
t or more share one of the first ``n - ceil(t n) + 1`` n-grams of each; for the smaller
set of the two already ``n - ceil(2t / (1 + t) n) + 1`` will do.  Only n-grams that
several sets hold are written to the inverted lists.  An entry of a list knows the size
of its set, its place in the order, and how the n-grams from that place on spread over
16 ranges of hashes.  Pairs of a list pass

* the length filter: the smaller set has at least t of the larger one's size;
* the positional filter: enough n-grams follow the shared one in both;
* the suffix filter: the smaller counts of each range add up to enough;

and each pair is then verified once on the sets themselves.

Long lists are not expanded into pairs.  Each round compares a few central members
(pivots, those with the fewest unshared n-grams before the entry) with the members of
other components, and the links found join components.  Lists whose possible pairs lie
in one component are done; the others go on with 16 times as many pivots, so a group
of n near copies costs about n comparisons, and what is left after log(n) rounds has
been compared entirely.  No connection is lost, and there is no cap.

Counting n-grams: different texts are dealt to blocks of a few MB.  A block sends the hash
of each of its n-grams once; buckets of hashes add up, and send back to each block the
hashes that several sets hold, with their class.  Texts are shuffled once.  64-bit hashes
stand for texts, sets and n-grams: of 10^10 different texts about three pairs would be
taken for equal.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import give_back, shuffle_width, stored
from .components import components
from .simhash import text_hash
from .substrings import member
from .words import Words

WORDS, SHARE = 4, (85, 100)
#: Characters of a block of documents, and of the texts whose hashes make up a bucket.
BLOCK, BUCKET = 4_000_000, 8_000_000
#: Ranges of hashes of the suffix filter.
RANGES = 16
#: Pivots of a list in the first round, and how many times more in each that follows.
PIVOTS, MORE = 1, 16
#: Rows with one text that a block takes in any case, and the share of all rows (one in ...) from which on it is dealt out.
HELD, HOT = 1 << 10, 10_000
_U = np.uint64


class Sets:
    """The distinct n-gram sets of some texts: ``node[i]`` and ``size[i]`` of text i, and ``of[node]``, the sorted hashes.

    A text of fewer than ``words`` words is one n-gram, a text without words has the empty set.
    """

    def __init__(self, texts: list[str | None], words: int):
        all_words = Words([(t or "").encode("utf-8", "surrogatepass").lower() for t in texts])
        grams, cuts = all_words.windows(words), all_words.cuts
        short = {n: all_words.windows(n) for n in range(1, words)}
        self.node, self.size = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        self.of: dict[int, np.ndarray] = {}
        for i, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
            if a == b:
                own = np.zeros(0, _U)
            elif b - a < words:
                own = short[b - a][a:a + 1]
            else:
                own = np.unique(grams[a:b - words + 1])
            node = xxhash.xxh64_intdigest(own.tobytes(), 42)
            node -= (node >> 63) << 64
            self.node[i], self.size[i] = node, len(own)
            if len(own):
                self.of.setdefault(node, own)


def prefix(n: int, share: tuple[int, int]) -> int:
    """How many n-grams of a set of ``n`` may be the first that it shares with a set alike."""
    return n - -(-share[0] * n // share[1]) + 1


def index_prefix(n: int, share: tuple[int, int]) -> int:
    """The same for sets alike that are not smaller."""
    return n - -(-2 * share[0] * n // (share[0] + share[1])) + 1


def _packed(keys: np.ndarray) -> bytes:
    """Sorted hashes of 48 bits, byte by byte: the high bytes repeat and compress."""
    return np.ascontiguousarray(keys.view(np.uint8).reshape(-1, 8)[:, 5::-1].T).tobytes()


def _unpacked(data: list[bytes]) -> np.ndarray:
    out = np.zeros((sum(len(x) for x in data) // 6, 8), np.uint8)
    at = 0
    for x in data:
        n = len(x) // 6
        out[at:at + n, 5::-1] = np.frombuffer(x, np.uint8).reshape(6, n).T
        at += n
    return out.view(_U).ravel()


def _joined(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(x or b"" for x in column.to_pylist()), np.uint8)


def _classes(counts: np.ndarray) -> np.ndarray:
    """1 to 255, rising with the logarithm of a count of two or more."""
    return np.clip(np.round(6 * np.log2(np.maximum(counts, 2))) - 5, 1, 255).astype(np.uint8)


def _dealt(docs: DataFrame, blocks: int) -> DataFrame:
    """``text_hash, text, _block``: each text once in a block.

    Equal texts meet in a block, where they are folded as sorted rows, before a block is
    read.  A text with more than one in ``HOT`` of all rows (there are fewer than ``HOT`` of them) is
    dealt by task as well, so that no block gets many of its rows.
    """
    rows = docs.select(text_hash().alias("text_hash"), "text")
    counts = stored(rows.groupBy("text_hash").agg(F.count(F.lit(1)).alias("_n")), "jaccard-texts")
    total = counts.agg(F.sum("_n")).first()[0] or 0
    hot = counts.filter(F.col("_n") > max(HELD, total // HOT)).select("text_hash", F.lit(True).alias("_hot"))
    dealt = rows.join(F.broadcast(hot), "text_hash", "left").withColumn("_block", F.pmod(F.xxhash64(
        "text_hash", F.when(F.col("_hot"), F.spark_partition_id())), F.lit(blocks)))
    return (dealt.repartition(shuffle_width(docs.sparkSession), "_block")
            .groupBy("_block", "text_hash").agg(F.first("text").alias("text")))


def prefixes(docs: DataFrame, words: int, share: tuple[int, int], block: int = BLOCK, bucket: int = BUCKET) -> DataFrame:
    """Three kinds of rows in one table, written once.

    0: ``text_hash, node, size`` of a text; 1: ``gram, node, size, pos, before, index, ranges`` of an
    n-gram in the prefix of a set that another set holds too; 2: ``node, grams``, the set of such a node.
    """
    size = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks, buckets = max(1, math.ceil(size / block)), max(1, math.ceil(size / bucket))
    by_block = _dealt(docs, blocks).groupBy("_block")

    def count(rows: pa.Table) -> pa.Table:
        give_back()  # of the block before
        sets = Sets(rows.column("text").to_pylist(), words)
        grams = np.concatenate([np.zeros(0, _U), *sets.of.values()]) >> _U(16)
        keys, counts = np.unique(grams, return_counts=True)
        to = (keys % _U(buckets)).astype(np.int64)
        by = np.argsort(to, kind="stable")
        keys, counts = keys[by], np.minimum(counts[by], 255).astype(np.uint8)
        own, first = np.unique(to[by], return_index=True)
        parts = list(zip(first.tolist(), [*first[1:].tolist(), len(by)]))
        return pa.table({"_block": pa.array(np.full(len(own), rows.column("_block")[0].as_py()), pa.int64()),
                         "_bucket": pa.array(own, pa.int64()),
                         "keys": pa.array([_packed(keys[a:b]) for a, b in parts], pa.binary()),
                         "counts": pa.array([counts[a:b].tobytes() for a, b in parts], pa.binary())})

    def shared(rows: pa.Table) -> pa.Table:
        give_back()  # of the block before
        keys, counts = _unpacked(rows.column("keys").to_pylist()), _joined(rows.column("counts"))
        _, inverse = np.unique(keys, return_inverse=True)
        total = np.bincount(inverse, counts)[inverse]
        out: dict[str, list] = {"_block": [], "keys": [], "classes": []}
        at = 0
        for to, packed in zip(rows.column("_block").to_pylist(), rows.column("keys").to_pylist()):
            n = len(packed) // 6
            own = np.flatnonzero(total[at:at + n] > 1) + at
            at += n
            if len(own):
                out["_block"].append(to)
                out["keys"].append(_packed(keys[own]))
                out["classes"].append(_classes(total[own]).tobytes())
        return pa.table({"_block": pa.array(out["_block"], pa.int64()), "keys": pa.array(out["keys"], pa.binary()),
                         "classes": pa.array(out["classes"], pa.binary())})

    def enter(_key, rows: pa.Table, known: pa.Table) -> pa.Table:
        give_back()  # of the block before
        sets = Sets(rows.column("text").to_pylist(), words)
        keys, classes = _unpacked(known.column("keys").to_pylist()), _joined(known.column("classes"))
        by = np.argsort(keys)
        keys, classes = keys[by], classes[by]
        parts: list[dict] = [{"kind": np.zeros(len(rows), np.int32), "text_hash": rows.column("text_hash"),
                              "node": sets.node, "size": sets.size}]
        whole: dict[str, list] = {"node": [], "grams": []}
        for node, own in sets.of.items():
            at = member(own >> _U(16), keys)
            rank = np.where(at >= 0, classes[at], 0) if len(keys) else np.zeros(len(own), np.uint8)
            order = np.lexsort((own, rank))
            n, unshared = len(own), int((rank == 0).sum())
            places = np.arange(min(unshared, n), prefix(n, share))
            if not len(places):
                continue
            chosen = own[order]
            spread = np.zeros((n + 1, RANGES), np.int64)  # from each place on
            spread[np.arange(n), (chosen >> _U(60)).astype(np.int64)] = 1
            spread = spread[::-1].cumsum(axis=0)[::-1][places]
            parts.append({"kind": np.ones(len(places), np.int32), "gram": chosen[places].view(np.int64),
                          "node": np.full(len(places), node), "size": np.full(len(places), n), "pos": places,
                          "before": np.full(len(places), unshared), "index": places < index_prefix(n, share),
                          "ranges": pa.array(list(spread.astype(np.int32)), pa.list_(pa.int32()))})
            whole["node"].append(node)
            whole["grams"].append(own.view(np.int64))
        parts.append({"kind": np.full(len(whole["node"]), 2, np.int32), **whole})
        return pa.concat_tables([_filled(p) for p in parts])

    sent = by_block.applyInArrow(count, "_block long, _bucket long, keys binary, counts binary")
    back = sent.groupBy("_bucket").applyInArrow(shared, "_block long, keys binary, classes binary")
    made = by_block.cogroup(back.groupBy("_block")).applyInArrow(enter, ", ".join(f"{c} {t}" for c, (t, _) in _COLUMNS.items()))
    return stored(made, "jaccard")


_COLUMNS = {"kind": ("int", pa.int32()), "text_hash": ("long", pa.int64()),
            "gram": ("long", pa.int64()), "node": ("long", pa.int64()), "size": ("long", pa.int64()),
            "pos": ("long", pa.int64()), "before": ("long", pa.int64()), "index": ("boolean", pa.bool_()),
            "ranges": ("array<int>", pa.list_(pa.int32())), "grams": ("array<long>", pa.list_(pa.int64()))}


def _filled(columns: dict) -> pa.Table:
    """A table of all columns; those not given are NULL."""
    n = len(columns["kind"])
    return pa.table({c: (columns[c].cast(kind) if isinstance(columns[c], (pa.Array, pa.ChunkedArray)) else
                         pa.array(columns[c], kind)) if c in columns else pa.nulls(n, kind) for c, (_, kind) in _COLUMNS.items()})


def _needed(x: str, y: str, share: tuple[int, int]) -> Column:
    """The least overlap of two sets alike, by their sizes: ceil(t / (1 + t) (x + y))."""
    a, b = share
    return F.expr(f"({a} * ({x} + {y}) + {a + b - 1}) div {a + b}")


def _verified(pairs: DataFrame, sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """The rows of ``pairs (a, b)`` whose sets are alike."""
    both = F.size(F.array_intersect("x", "y")).cast("long")
    return (pairs.join(sets.select(F.col("node").alias("a"), F.col("grams").alias("x")), "a")
            .join(sets.select(F.col("node").alias("b"), F.col("grams").alias("y")), "b")
            .withColumn("_both", both)
            .filter(share[1] * F.col("_both") >= share[0] * (F.size("x") + F.size("y") - F.col("_both"))).select("a", "b"))


def links(made: DataFrame, share: tuple[int, int], pivots: int = PIVOTS, more: int = MORE) -> DataFrame | None:
    """``node, component`` of the connected nodes of ``prefixes``; None if nothing is linked."""
    a, b = share
    entries = made.filter("kind = 1").select("gram", "node", "size", "pos", "before", "index", "ranges")
    # As the larger of a pair, a set reaches down to this size, and up to that of its partner's.
    entries = entries.withColumn("low", F.expr(f"({a} * size + {b - 1}) div {b}")).withColumn(
        "high", F.expr(f"least(size, ((size - pos) * {a + b}) div {a} - size)"))
    alive = entries.withColumn("component", F.col("node"))
    sets, seen, joined, count = None, None, None, pivots
    while True:
        lists = (alive.groupBy("gram").agg(F.min(F.when(F.col("index"), F.col("size"))).alias("least"),
                                           F.max(F.when(F.col("index"), F.col("size"))).alias("most"),
                                           F.count_if("index").alias("members"))
                 .filter("members > 0"))
        able = F.col("index") | ((F.col("high") >= F.col("least")) & (F.col("low") <= F.col("most")))
        alive = alive.drop("least", "most", "members").join(lists, "gram").filter(able)
        apart = alive.groupBy("gram").agg(F.min("component").alias("_a"), F.max("component").alias("_b")).filter("_a <> _b")
        alive = stored(alive.join(apart.select("gram"), "gram", "left_semi"), "jaccard-alive")
        if alive.isEmpty():
            return joined
        if sets is None:
            wanted = alive.select("node").distinct()
            sets = stored(made.filter("kind = 2").select("node", "grams").join(wanted, "node", "left_semi")
                          .groupBy("node").agg(F.first("grams").alias("grams")), "jaccard-sets")
        index = alive.filter("index")
        salt = F.when(F.col("members") <= count, F.xxhash64("node")).otherwise(
            F.pmod(F.xxhash64("node", F.lit(count)), F.lit(count)))
        chosen = (index.groupBy("gram", salt.alias("_salt")).agg(F.min(F.struct(
            "before", "node", "size", "pos", "ranges", "component")).alias("_p"))
            .select("gram", *[F.col(f"_p.{c}").alias(f"p_{c}") for c in ("node", "size", "pos", "ranges", "component")]))
        chosen = stored(chosen, "jaccard-pivots")
        enough = F.aggregate(F.zip_with("ranges", "p_ranges", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
        # Every pair has the smaller set (of equal ones the smaller node) as its pivot.
        pairs = (alive.join(chosen, "gram").filter(
            (F.col("component") != F.col("p_component"))
            & (F.struct("size", "node") > F.struct("p_size", "p_node"))
            & F.col("p_size").between(F.col("low"), F.col("high"))
            & (F.least(F.col("size") - F.col("pos"), F.col("p_size") - F.col("p_pos")) >= _needed("size", "p_size", share)))
            .filter(enough >= _needed("size", "p_size", share))
            .select(F.col("p_node").alias("a"), F.col("node").alias("b")).distinct())
        if seen is not None:
            pairs = pairs.join(seen, ["a", "b"], "left_anti")
        pairs = stored(pairs, "jaccard-pairs")
        seen = pairs if seen is None else seen.union(pairs)
        new = _verified(pairs, sets, share)
        own = alive.select("node", "component").distinct()
        # Links between components as they are: only what changes goes through the search for components.
        merged = stored(new.join(own.toDF("a", "x"), "a").join(own.toDF("b", "y"), "b").select(
            F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "jaccard-links")
        used = chosen.select("gram", F.col("p_node").alias("node"), F.lit(True).alias("_used"))
        alive = (alive.join(used, ["gram", "node"], "left")
                 .withColumn("index", F.col("index") & F.col("_used").isNull()).drop("_used"))
        if not merged.isEmpty():
            changed = stored(components(merged).toDF("_from", "_to"), "jaccard-changed")
            alive = (alive.join(changed, F.col("component") == F.col("_from"), "left")
                     .withColumn("component", F.coalesce("_to", "component")).drop("_from", "_to"))
            fresh = changed.toDF("node", "component")
            if joined is not None:
                fresh = fresh.join(joined.select("node"), "node", "left_anti")
                fresh = joined.join(changed, F.col("component") == F.col("_from"), "left").select(
                    "node", F.coalesce("_to", "component").alias("component")).union(fresh)
            joined = stored(fresh, "jaccard-components")
        count *= more


def near_duplicates(docs: DataFrame, words: int = WORDS, share: tuple[int, int] = SHARE, block: int = BLOCK,
                    bucket: int = BUCKET, pivots: int = PIVOTS) -> DataFrame:
    """``doc_id, text_hash, node, n_shingles, component`` for every row of ``docs``.

    ``node`` stands for the set of n-grams, ``n_shingles`` is its size, and rows of one
    ``component`` are connected over sets of Jaccard similarity ``share`` (a fraction) or
    more.  Words are cut at space and 0x09-0x0D, A-Z in lower case; a text of fewer than
    ``words`` words is one n-gram; texts without words have no component (NULL), as they
    are linked with nothing.  Repeated rows and rows with a NULL id count as rows of their
    own; an empty table gives no rows; other columns are ignored.
    """
    made = prefixes(docs, words, share, block, bucket)
    joined = links(made, share, pivots)
    known = made.filter("kind = 0").select(F.col("text_hash").alias("_hash"), "node", F.col("size").alias("n_shingles")).distinct()
    if joined is None:
        known = known.withColumn("component", F.lit(None).cast("long"))
    else:
        known = known.join(joined, "node", "left")
    known = known.withColumn("component", F.when(F.col("n_shingles") > 0, F.coalesce("component", "node")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("text_hash"))
    # A text that very many rows hold is spread over the tasks by AQE's skew join.
    return rows.join(known, F.col("text_hash") == F.col("_hash")).select(
        "doc_id", "text_hash", "node", "n_shingles", "component")


def named(found: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id``: the smallest id of each component, its own for a text without words."""
    found = stored(found, "jaccard-rows")
    first = found.filter(F.col("component").isNotNull()).groupBy("component").agg(F.min("doc_id").alias("_first"))
    return (found.join(first, "component", "left")
            .select("doc_id", "n_shingles", F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(
                F.col("_first")).alias("component_id")))
