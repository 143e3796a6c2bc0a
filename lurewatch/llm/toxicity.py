"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text:
each keeps the pieces of words that are clearly more frequent in its own
kind, most frequent last, where zstandard reaches them most cheaply.  A text is cut into windows
of two words.  A window is compressed with either dictionary; the difference of
the two lengths says which text it resembles.  Both dictionaries end in one
fixed string, and every window begins with it: a window then always is a
compressed block with a match, so that lengths differ by the window's own matches
and not by the block format.

A document's differences are counted by size, and a logistic function of the
counts, fitted on documents that the dictionaries have not seen, turns them into
a calibrated score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import give_back, packed, unpacked, with_row
from .labelled import Logistic, sample

#: Words of a window, and bytes of a dictionary at most.
WINDOW, SIZE = 2, 12_000
#: Length of the counted pieces; how many times as often as in the other texts, and how often, they must occur.
PIECE, RATIO, LEAST = 5, 6.0, 8
#: Occurrences that one text adds to a count at most.
OFTEN = 8
#: Most labelled documents of each label to learn from, and the longest in characters.
MOST, LONGEST = 3000, 20_000
#: Differences of lengths are counted from the first to the second of these.
FROM, TO = -4, 8
#: Window differences remembered by a task; only a saving of time.
REMEMBERED = 300_000
COMMON = bytes(range(48, 80))
LEVEL = 3


def _pieces(word: bytes) -> list[bytes]:
    word = b" " + word + b" "
    return [word[i:i + PIECE] for i in range(len(word) - PIECE + 1)]


def _counts(texts: list[bytes]) -> Counter:
    """Occurrences of each piece, of a text no more than ``OFTEN`` each."""
    counts: Counter = Counter()
    for text in texts:
        own: Counter = Counter()
        for word, n in Counter(text.split()).items():
            for piece in _pieces(word):
                own[piece] += n
        for piece, n in own.items():
            counts[piece] += min(n, OFTEN)
    return counts


def train_dictionary(texts: list[bytes], others: list[bytes], size: int = SIZE) -> bytes:
    """Runs of pieces typical of ``texts`` against ``others``, the most frequent last."""
    own, other = _counts(texts), _counts(others)
    typical = {p for p, n in own.items() if n >= LEAST and
               (n + 0.5) / len(texts) > RATIO * (other[p] + 0.5) / len(others)}
    runs: Counter = Counter()
    for text in texts:
        for word in set(text.split()):
            padded, run = b" " + word + b" ", []
            for at, piece in enumerate(_pieces(word)):
                if piece in typical:
                    run = [run[0] if run else at, at + PIECE]
                elif run:
                    runs[padded[run[0]:run[1]]] += 1
                    run = []
            if run:
                runs[padded[run[0]:run[1]]] += 1
    kept: list[bytes] = []
    for run, _ in sorted(runs.items(), key=lambda x: (-x[1], x[0])):
        if not any(run in x for x in kept[-200:]):
            kept.append(run)
            size -= len(run)
            if size < 0:
                break
    return b"".join(kept[::-1])


class Model:
    """Both dictionaries and the calibration; small, so that tasks carry it along."""

    def __init__(self, texts: list[str], y: np.ndarray, share: float):
        raw = [_raw(t) for t in texts]
        toxic, plain = ([t for t, v in zip(raw, y) if v == k] for k in (1, 0))
        self.usable = len(toxic) >= 2 and len(plain) >= 2
        if not self.usable:
            return
        self.toxic = train_dictionary(toxic[::2], plain[::2])
        self.plain = train_dictionary(plain[::2], toxic[::2], max(len(self.toxic), 256))
        counts = self.counter()
        fresh = toxic[1::2] + plain[1::2]
        self.logistic = Logistic(np.array([counts(t) for t in fresh]),
                                 np.repeat([1.0, 0.0], [len(toxic[1::2]), len(plain[1::2])]), share)

    def counter(self):
        """A function from a text to its counts; holds the compressors of one task."""
        import zstandard

        def compressor(content: bytes):
            words = zstandard.ZstdCompressionDict(content + COMMON, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            words.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(level=LEVEL, dict_data=words, write_checksum=False,
                                            write_content_size=False, write_dict_id=False).compress

        toxic, plain, known = compressor(self.toxic), compressor(self.plain), {}

        def difference(window: bytes) -> int:
            found = known.get(window)
            if found is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                block = COMMON + b" " + window + b" "
                found = len(plain(block)) - len(toxic(block))
                found = known[window] = min(max(found, FROM), TO)
            return found

        def counts(text: bytes) -> np.ndarray:
            words = text.split()
            found = np.zeros(TO - FROM + 1)
            for at, n in Counter(difference(b" ".join(words[i:i + WINDOW])) for i in range(0, len(words), WINDOW)).items():
                found[at - FROM] = n
            total = max(found.sum(), 1.0)
            values = np.arange(FROM, TO + 1)
            most = values[found > 0].max() if found.any() else 0
            return np.r_[np.log1p(found), 10 * found / total, (found * values).sum() / total, most, np.log(total)]

        return counts


def _raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").lower()


def fit(docs: DataFrame, labels: DataFrame, learn: Column, most: int = MOST, longest: int = LONGEST) -> Model:
    """A model from at most ``most`` labelled documents of each label (``labels.toxic``), where ``learn`` holds."""
    model = Model(*sample(docs, labels, "toxic", learn, most, longest))
    give_back()  # the driver's, of texts and counts
    return model


def score(docs: DataFrame, model: Model, carry: list[str] | None = None) -> DataFrame:
    """``carry`` columns (default: all) and ``score``, 0 to 1, of each whole text; a narrow pass.

    NULL, empty and blank texts have no windows and get what the calibration says
    of that; without both labels to learn from every score is 0.  Only the text
    enters the score.  Repeated rows get equal scores; an empty table gives no rows.
    """
    carry = docs.columns if carry is None else carry
    # A text travels once: out of the carried columns where it is one of them.
    carried = "text" in carry
    row = docs.select(packed(carry), *([] if carried else [F.col("text").alias("_text")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = model.counter() if model.usable else None
        for batch in batches:
            made = np.zeros(len(batch))
            if counts is not None and len(batch):
                texts = batch.column("_row").field("text") if carried else batch.column("_text")
                made = model.logistic.score(np.array([counts(_raw(t.as_py())) for t in texts]))
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(made, pa.float64())], ["_row", "score"])
        batch = texts = counts = None
        give_back()

    scored = row.mapInArrow(run, with_row(row, "score double"))
    return scored.select(*unpacked([c for c in carry if c != "score"]), "score")
