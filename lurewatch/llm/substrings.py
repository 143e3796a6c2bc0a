"""Substring deduplication by level-wise doubling.

Only windows that repeat at one length are looked at again at the next, up to
twice as long.  Two documents that share a window of 13 words share its windows
of 7 words; the first level therefore counts 7-word windows, of each 13-word
window the one with the least hash (about a quarter of all positions).  Those
that occur in several documents extend to the 13-word windows around them, which
are counted by 96-bit hashes.  Longer targets go through more levels, and each
looks only at what survived the one before.  A word is removed if a window that covers it also starts in
a document with a smaller id.

Documents are dealt to blocks of a few MB.  A block sends each window hash once,
with its smallest id, however many of its documents hold it: a passage that a
third of all documents share costs one row a block, not one a document.  Hashes
are gathered in buckets, and each block gets back what it needs to know.  The
texts are shuffled once, to their blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import give_back, packed, shuffle_width, unpacked, with_row
from .words import Words

#: Characters of a block of documents, and of the texts whose hashes make up a bucket.
BLOCK, BUCKET = 4_000_000, 8_000_000
_U = np.uint64
#: Bits of a first-level hash; the last bit says that a block alone has it in several documents.
_KEY = _U(0xFFFFFFFFFFFFFFFE)


def levels(width: int) -> list[int]:
    """Window lengths of the search, two at least; each is at most twice the one before."""
    out = [width]
    while out[0] > 7 or len(out) == 1:
        out.insert(0, (out[0] + 1) // 2)
    return out


class Block:
    """Documents of one block with their words; ``order`` holds their ids, the NULL id last."""

    def __init__(self, rows: pa.Table, width: int):
        self.rows, self.width = rows, width
        self.order = rows.column("_order").to_numpy()
        self.words = Words([(t or "").encode("utf-8", "surrogatepass") for t in rows.column("_text").to_pylist()])
        self.inside = self.words.inside(width)

    def anchors(self, length: int, of: int) -> np.ndarray:
        """For each window of ``of`` words the least hash of its windows of ``length`` words."""
        small = self.words.windows(length)
        n = max(0, len(self.words.hash) - of + 1)
        out = small[:n].copy()
        for j in range(1, of - length + 1):
            np.minimum(out, small[j:n + j], out=out)
        return out & _KEY

    def survivors(self, length: int | None, known: np.ndarray | None) -> np.ndarray:
        """Positions of the full windows that repeat at ``length`` words, by the hashes in ``known``."""
        at = np.flatnonzero(self.inside)
        return at if known is None else at[member(self.anchors(length, self.width)[at], known) >= 0]


def member(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Where each value lies in a sorted array, -1 if it does not."""
    if not len(among):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(among, values), len(among) - 1)
    return np.where(among[at] == values, at, -1)


def grouped(keys: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in rising order with the smallest and the largest id of each."""
    by = np.argsort(keys, kind="stable")
    keys, order = keys[by], order[by]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    if not len(first):
        return keys, order, order
    return keys[first], np.minimum.reduceat(order, first), np.maximum.reduceat(order, first)


def _dealt(block: int, keys: np.ndarray, columns: dict[str, np.ndarray], buckets: int) -> pa.Table:
    """One row for each bucket that has keys of the block; arrays travel as bytes."""
    bucket = ((keys >> _U(33)) % _U(buckets)).astype(np.int64)
    by = np.argsort(bucket, kind="stable")
    own, first = np.unique(bucket[by], return_index=True)
    ends = [*first[1:].tolist(), len(by)]
    made = {"_block": pa.array(np.full(len(own), block), pa.int64()), "_bucket": pa.array(own, pa.int64())}
    for name, values in columns.items():
        values = values[by]
        made[name] = pa.array([values[a:b].tobytes() for a, b in zip(first.tolist(), ends)], pa.binary())
    return pa.table(made)


def _joined(rows: pa.Table, name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(x or b"" for x in rows.column(name).to_pylist()), kind)


def _back(rows: pa.Table, sizes: list[int], chosen: np.ndarray, columns: dict[str, np.ndarray]) -> pa.Table:
    """The chosen entries of a bucket, back to the blocks that sent them."""
    ends = np.cumsum(sizes)
    out: dict[str, list] = {"_block": [], **{name: [] for name in columns}}
    for block, a, b in zip(rows.column("_block").to_pylist(), (ends - sizes).tolist(), ends.tolist()):
        own = chosen[a:b]
        if own.any():
            out["_block"].append(block)
            for name, values in columns.items():
                out[name].append(values[a:b][own].tobytes())
    return pa.table({"_block": pa.array(out["_block"], pa.int64()),
                     **{name: pa.array(out[name], pa.binary()) for name in columns}})


def deduplicate(docs: DataFrame, width: int = 13, carry: list[str] | None = None,
                verbatim: bool = False, block: int = BLOCK, bucket: int = BUCKET) -> DataFrame:
    """``carry`` columns (default: all but ``text``) and what is left of each document.

    Added are ``n_words``, ``n_removed``, ``spans`` (first word and number of words
    of each removed run) and ``kept_text``, the kept words joined by one space
    (``verbatim``: a text that loses no word stays as it is).
    Windows are judged on the input.  A NULL or empty text has no words.  A NULL
    id counts as larger than any other, and NULL ids as equal; repeated rows get
    equal results; two texts of one id do not remove each other's words; an empty
    table gives no rows; columns with the name of a result are replaced, others pass.
    """
    spark = docs.sparkSession
    made = ("text", "n_words", "n_removed", "spans", "kept_text")
    carry = [c for c in docs.columns if c not in made] if carry is None else carry
    steps = levels(width)
    size = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks, buckets = max(1, math.ceil(size / block)), max(1, math.ceil(size / bucket))
    own = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text"))
    # Copies of one NULL-id text meet in a block; the rest is dealt by id.
    dealt = docs.select(packed(carry), F.col("text").alias("_text"),
                        F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("_order"),
                        F.pmod(F.xxhash64(own), F.lit(blocks)).alias("_block"))
    # Read three times, written once: the plans below share this exchange.
    dealt = dealt.repartition(shuffle_width(spark), "_block")
    by_block = dealt.groupBy("_block")

    def windows_of(length: int, before: int | None):
        """Hashes of ``length`` words in the windows that repeat at ``before`` words."""
        def run(rows: pa.Table, known: pa.Table | None) -> pa.Table:
            give_back()  # of the block before
            part = Block(rows, width)
            at = part.survivors(before, None if known is None else np.sort(_joined(known, "keys", _U)))
            keys, text = part.anchors(length, width)[at], part.words.text[at]
            new = np.ones(len(at), bool)  # neighbours mostly share their least hash
            new[1:] = (keys[1:] != keys[:-1]) | (text[1:] != text[:-1])
            keys, low, high = grouped(keys[new], part.order[text[new]])
            return _dealt(rows.column("_block")[0].as_py(), keys, {"keys": keys | (low < high).astype(_U)}, buckets)

        if before is None:
            return lambda rows: run(rows, None)
        return lambda _key, rows, known: run(rows, known) if len(rows) and len(known) else long_empty.select(
            ["_block", "_bucket", "keys"])

    def short_repeats(rows: pa.Table) -> pa.Table:
        give_back()
        sizes = [len(x) // 8 for x in rows.column("keys").to_pylist()]
        marked = _joined(rows, "keys", _U)
        keys = marked & _KEY
        # A second block with the same hash is another document, and so is the mark of one block.
        _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
        several = (counts > 1) | (np.bincount(inverse, marked & _U(1), len(counts)) > 0)
        return _back(rows, sizes, several[inverse], {"keys": keys})

    def long_windows(_key, rows: pa.Table, known: pa.Table) -> pa.Table:
        give_back()  # of the block before
        if not len(rows) or not len(known):
            return long_empty
        part = Block(rows, width)
        at = part.survivors(steps[-2], np.sort(_joined(known, "keys", _U)))
        keys, checks = part.words.windows(width)[at], part.words.windows(width, 3)[at]
        order = part.order[part.words.text[at]]
        unique, low, high = grouped(keys, order)
        by = np.argsort(keys, kind="stable")
        checks = checks[by][np.searchsorted(keys[by], unique)]
        return _dealt(rows.column("_block")[0].as_py(), unique, {
            "keys": unique, "checks": (checks >> _U(32)).astype(np.uint32), "low": low, "several": low < high}, buckets)

    long_empty = pa.table({"_block": pa.array([], pa.int64()), "_bucket": pa.array([], pa.int64()), **{
        c: pa.array([], pa.binary()) for c in ("keys", "checks", "low", "several")}})

    def long_repeats(rows: pa.Table) -> pa.Table:
        give_back()
        sizes = [len(x) // 8 for x in rows.column("keys").to_pylist()]
        keys, checks = _joined(rows, "keys", _U), _joined(rows, "checks", np.uint32)
        low, several = _joined(rows, "low", np.int64), _joined(rows, "several", bool)
        by = np.lexsort((checks, keys))
        new = np.ones(len(by), bool)
        new[1:] = (keys[by][1:] != keys[by][:-1]) | (checks[by][1:] != checks[by][:-1])
        least = np.empty(len(by), np.int64)
        least[by] = np.minimum.reduceat(low[by], np.flatnonzero(new))[np.cumsum(new) - 1] if len(by) else 0
        return _back(rows, sizes, (least < low) | several, {"keys": keys, "least": least})

    def remove(_key, rows: pa.Table, known: pa.Table) -> pa.Table:
        give_back()  # of the block before
        part = Block(rows, width)
        words = part.words
        keys, least = _joined(known, "keys", _U), _joined(known, "least", np.int64)
        by = np.argsort(keys)
        keys, least = keys[by], least[by]
        at = np.flatnonzero(part.inside)
        hashes = words.windows(width)[at]
        where = member(hashes, keys)
        hit = (where >= 0) & (least[where] < part.order[words.text[at]]) if len(keys) else np.zeros(len(at), bool)
        change = np.zeros(len(words.hash) + 1, np.int32)
        np.add.at(change, at[hit], 1)
        np.add.at(change, at[hit] + width, -1)
        covered = np.cumsum(change[:-1]) > 0
        counts = np.diff(words.cuts)
        removed = np.concatenate(([0], np.cumsum(covered)))
        removed = removed[words.cuts[1:]] - removed[words.cuts[:-1]]
        spans = [_runs(covered[words.cuts[i]:words.cuts[i + 1]]) if removed[i] else [] for i in range(len(rows))]
        texts = rows.column("_text")
        kept = [texts[i].as_py() if verbatim and not removed[i] else
                words.kept(i, covered).decode("utf-8", "surrogatepass") for i in range(len(rows))]
        return pa.table({
            "_row": rows.column("_row"), "n_words": pa.array(counts, pa.int64()), "n_removed": pa.array(removed, pa.int64()),
            "spans": pa.array(spans, pa.list_(pa.list_(pa.int64()))), "kept_text": pa.array(kept, pa.string())})

    sent, known, before = "_block long, _bucket long, keys binary", None, None
    for length in steps[:-1]:
        found = (by_block if known is None else by_block.cogroup(known.groupBy("_block"))).applyInArrow(
            windows_of(length, before), sent)
        known, before = found.groupBy("_bucket").applyInArrow(short_repeats, "_block long, keys binary"), length
    full = (by_block.cogroup(known.groupBy("_block"))
            .applyInArrow(long_windows, f"{sent}, checks binary, low binary, several binary")
            .groupBy("_bucket").applyInArrow(long_repeats, "_block long, keys binary, least binary"))
    out = by_block.cogroup(full.groupBy("_block")).applyInArrow(
        remove, with_row(dealt, "n_words long, n_removed long, spans array<array<bigint>>, kept_text string"))
    return out.select(*unpacked(carry), "n_words", "n_removed", "spans", "kept_text")


def _runs(covered: np.ndarray) -> list[list[int]]:
    """(first, number) of each run of covered words."""
    edges = np.flatnonzero(np.diff(covered.astype(np.int8), prepend=0, append=0))
    return [[int(a), int(b - a)] for a, b in zip(edges[0::2], edges[1::2])]
