"""Byte-level BPE encoding and decoding with overlapping chunks.

Texts up to one chunk are encoded where they are read.  Longer ones are cut into
chunks that overlap.  Each chunk is pre-tokenised on its own; the boundaries in
an overlap, as the two chunks see them, resynchronise at the first one they
share, for what follows a boundary depends only on the text after it.  Cutting
there gives pieces that are encoded in parallel, on any executor, and whose ids
are put together in order.  A text with an overlap that never resynchronises
(such as one endless run of blanks) is encoded whole.

A cut is only made after a character that is no white space.  The look-ahead in
the pattern concerns white space alone, so a piece then has the same
pre-tokens by itself as inside its text.
"""

from __future__ import annotations

import base64
import sys
import types
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from .common import give_back

#: Characters of a chunk and of an overlap.
CHUNK, OVERLAP = 32_768, 256
#: Characters after a match that the pattern may have looked at.
AHEAD = 3
#: Texts handed back at a time.
ROWS = 256


class Vocabulary:
    """Ranks of a public vocabulary file (a token in base64 and its rank on each line), read on the driver."""

    def __init__(self, lines: bytes, pattern: str):
        self.lines, self.pattern = lines, pattern

    @classmethod
    def read(cls, path: str, pattern: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls(f.read(), pattern)

    def ranks(self) -> dict[bytes, int]:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, self.lines.splitlines())}

    def encoding(self):
        """The tiktoken encoding, built once in each worker process."""
        kept = sys.modules.setdefault("_llm_vocabularies", types.ModuleType("_llm_vocabularies")).__dict__
        key = (self.pattern, len(self.lines), hash(self.lines))
        if key not in kept:
            import tiktoken

            kept[key] = tiktoken.Encoding("own", pat_str=self.pattern, mergeable_ranks=self.ranks(), special_tokens={})
        return kept[key]

    def table(self) -> list[bytes]:
        """The bytes of each id."""
        ranks = self.ranks()
        out = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            out[rank] = token
        return out


def _ids(encoding, text: str) -> bytes:
    return np.array(encoding.encode_ordinary(text), "<u4").tobytes()


def boundaries(pattern, text: str, whole: bool) -> list[int]:
    """Where matches start in ``text`` after a character that is no white space.

    ``whole=False``: the text goes on, and matches near its end are not trusted.
    """
    safe = len(text) if whole else len(text) - AHEAD
    out = []
    for match in pattern.finditer(text):
        if match.end() >= safe:
            break
        at = match.end()
        if not text[at - 1].isspace() and "Cn" not in (unicodedata.category(text[at - 1]), unicodedata.category(text[at])):
            out.append(at)
    return out


def chunks(text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> Iterator[tuple[int, int, str, bool]]:
    """``(number, start, text, last)`` of the overlapping chunks of a text."""
    number, start = 0, 0
    while True:
        end = start + chunk + overlap
        yield number, start, text[start:end], end >= len(text)
        if end >= len(text):
            return
        number, start = number + 1, start + chunk


def encode(docs: DataFrame, vocabulary: Vocabulary, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``doc_id, ids`` (little-endian unsigned 32-bit ranks, one after the other) for every row.

    NULL and empty texts have no ids.  Special tokens are ordinary text.
    Repeated rows and NULL ids stay rows of their own; other columns are ignored.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = dict(texts.dtypes)["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary.lines, vocabulary.pattern))  # a vocabulary file: a few MB

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = Vocabulary(*shared.value).encoding()
        for batch in batches:
            for i in range(0, len(batch), ROWS):
                part = batch.slice(i, ROWS)
                ids = pa.array([_ids(encoding, t) for t in part.column("text").to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids], ["doc_id", "ids"])
        batch = part = ids = None
        give_back()

    is_short = F.length("text") <= chunk
    made = texts.filter(is_short).mapInArrow(short, f"doc_id {kind}, ids binary")
    return made.unionByName(_encode_long(texts.filter(~is_short), kind, shared, chunk, overlap))


def _encode_long(texts: DataFrame, kind: str, shared, chunk: int, overlap: int) -> DataFrame:
    """The way of texts beyond one chunk; equal rows are encoded once."""
    same = texts.groupBy("doc_id", "text").agg(F.count(F.lit(1)).alias("copies"))
    keyed = same.select("doc_id", "copies", F.sha2("text", 256).alias("key"), "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        pattern = regex.compile(shared.value[1])
        for batch in batches:
            for row in range(len(batch)):
                text = batch.column("text")[row].as_py()
                for number, start, part, last in chunks(text, chunk, overlap):
                    at = boundaries(pattern, part, last)
                    head = [start + x for x in at if x < overlap]
                    tail = [start + x for x in at if x >= chunk]
                    yield pa.RecordBatch.from_arrays([
                        *(batch.column(c).slice(row, 1) for c in ("doc_id", "copies", "key")),
                        pa.array([number], pa.int64()), pa.array([start], pa.int64()), pa.array([last]),
                        pa.array([head], pa.list_(pa.int64())), pa.array([tail], pa.list_(pa.int64())),
                        pa.array([part], pa.string())], names)

    names = ["doc_id", "copies", "key", "number", "start", "last", "head", "tail", "text"]
    cuts = keyed.mapInArrow(cut, f"doc_id {kind}, copies long, key string, number long, start long, last boolean, "
                                 "head array<long>, tail array<long>, text string")
    doc = Window.partitionBy("doc_id", "key")
    order = doc.orderBy("number")
    stitched = cuts.withColumn("sync", F.array_min(F.array_intersect("tail", F.lead("head").over(order))))
    stitched = stitched.withColumns({
        "whole": F.max(F.col("sync").isNull() & ~F.col("last")).over(doc),
        "first": F.coalesce(F.lag("sync").over(order), F.lit(0)) - F.col("start"),
        "end": F.coalesce(F.col("sync"), F.col("start") + F.length("text")) - F.col("start")})
    # A text that never resynchronised keeps its plain chunks, without overlap, to be put together again.
    piece = (F.when(F.col("whole") & ~F.col("last"), F.substr("text", F.lit(1), F.lit(chunk)))
             .when(F.col("whole"), F.col("text"))
             .otherwise(F.substr("text", (F.col("first") + 1).cast("int"), (F.col("end") - F.col("first")).cast("int"))))
    pieces = stitched.select("doc_id", "copies", "key", "number", "whole", piece.alias("text")).repartition("key", "number")

    def encode_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = Vocabulary(*shared.value).encoding()
        for batch in batches:
            ids = pa.array([t.encode() if w else _ids(encoding, t) for t, w in zip(
                batch.column("text").to_pylist(), batch.column("whole").to_pylist())], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], ids], [*batch.schema.names[:5], "part"])
        batch = ids = None
        give_back()

    parts = pieces.mapInArrow(encode_pieces, f"doc_id {kind}, copies long, key string, number long, whole boolean, part binary")

    def put_together(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("number")
        ids = b"".join(rows.column("part").to_pylist())
        if rows.column("whole")[0].as_py():
            ids = _ids(Vocabulary(*shared.value).encoding(), ids.decode())
        return pa.table([rows.column("doc_id").slice(0, 1), rows.column("copies").slice(0, 1),
                         pa.array([ids], pa.binary())], ["doc_id", "copies", "ids"])

    whole = parts.groupBy("doc_id", "key").applyInArrow(put_together, f"doc_id {kind}, copies long, ids binary")
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    return whole.withColumn("_copy", each).select("doc_id", "ids")


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Add ``decoded``: the raw bytes of the ids, one after the other (they need not be valid UTF-8 in parts)."""
    shared = encoded.sparkSession.sparkContext.broadcast((vocabulary.lines, vocabulary.pattern))
    others = [c for c in encoded.columns if c != "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = Vocabulary(*shared.value).table().__getitem__
        for batch in batches:
            for i in range(0, len(batch), ROWS):
                part = batch.slice(i, ROWS)
                texts = [b"".join(map(raw, np.frombuffer(x or b"", "<u4").tolist())) for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in others), pa.array(texts, pa.binary())],
                                                 [*others, "decoded"])
        batch = part = texts = raw = None
        give_back()

    kinds = dict(encoded.dtypes)
    return encoded.select(*others).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in others), "decoded binary"]))
