"""Document quality by regularised quadratic discriminant analysis.

A text is described by 16 statistics, each transformed towards a bell shape and
clipped to the range seen while learning.  Each class has a Gaussian with its own
mean and a covariance shrunk twice: towards the covariance pooled over both
classes, and that sum towards its diagonal.  The score is the difference of the two
log densities, from Mahalanobis distances by the Cholesky factors that the model
keeps.  A logistic function of that difference, fitted on documents that the
Gaussians have not seen, calibrates it to a share between 0 and 1.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import packed, unpacked, with_row
from .labelled import Logistic, sample

#: Most labelled documents of each label to learn from, and the longest in characters.
MOST, LONGEST = 4000, 50_000
#: Share of the pooled covariance, and then of the diagonal, in a class covariance.
POOLED, DIAGONAL = 0.1, 0.1
#: Words of nothing in particular that steady the shares of short texts.
FEW = 6
#: Bytes compressed at a time for the compression ratio.
PART = 1 << 16
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "!#$%&*+/<=>@[\\]^_`{|}~"]] = True


def statistics(text: str | None) -> np.ndarray:
    """The transformed statistics of one whole text; an empty text has zeros alone."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return np.zeros(16)
    n, counts = len(words), Counter(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size = max(int(lengths.sum()), 1)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    packed = sum(len(zlib.compress(raw[i:i + PART], 1)) for i in range(0, len(raw), PART))
    bare = sum(k for w, k in counts.items() if not any(c > 127 or chr(c).isalnum() for c in w))
    ends = sum(k for w, k in counts.items() if w[-1] in b".,;:")
    shares = np.array([
        sum(map(eq, words, words[1:])) / (n + FEW),          # a word like the one before
        (counts.most_common(1)[0][1] - 1) / (n + FEW),       # the most frequent word
        byte[_SYMBOL].sum() / (size + FEW), byte[_UPPER].sum() / (size + 5 * FEW), byte[_DIGIT].sum() / size,
        bare / (n + FEW), ends / (n + FEW), (lengths <= 3).sum() / (n + FEW), (lengths >= 15).sum() / (n + FEW), byte[128:].sum() / size,
        1 - len(set(lines)) / len(lines)])
    return np.r_[np.log1p(n), np.log1p(lengths.mean()), np.log1p(lengths.std()),
                 np.log1p(len(counts)) / np.log1p(n), np.log(packed / (len(raw) + 8 * FEW)), np.arcsinh(20 * shares)]


class Gaussian:
    """A class mean and the Cholesky factor of its covariance."""

    def __init__(self, x: np.ndarray, pooled: np.ndarray):
        self.mean = x.mean(axis=0)
        own = np.cov(x, rowvar=False, bias=True)
        mixed = (1 - POOLED) * own + POOLED * pooled
        mixed = (1 - DIAGONAL) * mixed + DIAGONAL * np.diag(np.diag(mixed))
        self.factor = np.linalg.cholesky(mixed + 1e-4 * np.eye(len(mixed)))
        self.log_root = np.log(np.diag(self.factor)).sum()

    def log_density(self, x: np.ndarray) -> np.ndarray:
        z = np.linalg.solve(self.factor, (x - self.mean).T)
        return -0.5 * (z * z).sum(axis=0) - self.log_root


class Model:
    """Scales, two Gaussians and the calibration."""

    def __init__(self, described: list, y: np.ndarray, share: float):
        self.usable = min((y == 1).sum(), (y == 0).sum()) >= 4
        if not self.usable:
            return
        x = np.array(described)
        self.low, self.high = np.quantile(x, 0.001, axis=0), np.quantile(x, 0.999, axis=0)
        learn = np.zeros(len(y), bool)
        for k in (1, 0):
            learn[np.flatnonzero(y == k)[::2]] = True
        x = np.clip(x, self.low, self.high)
        self.mean, self.scale = x[learn].mean(axis=0), x[learn].std(axis=0) + 1e-3
        z = (x - self.mean) / self.scale
        parts = [z[learn & (y == k)] for k in (0, 1)]
        pooled = sum(np.cov(p, rowvar=False, bias=True) * len(p) for p in parts) / learn.sum()
        self.classes = [Gaussian(p, pooled) for p in parts]
        self.logistic = Logistic(self._difference(z[~learn]), y[~learn], share, 1e-4)

    def _difference(self, z: np.ndarray) -> np.ndarray:
        d = self.classes[1].log_density(z) - self.classes[0].log_density(z)
        return np.arcsinh(d)[:, None]

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.logistic.score(self._difference((np.clip(x, self.low, self.high) - self.mean) / self.scale))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, most: int = MOST, longest: int = LONGEST) -> Model:
    """A model from at most ``most`` labelled documents of each label (``labels.quality``), where ``learn`` holds."""
    return Model(*sample(docs, labels, "quality", learn, most, longest, statistics))


def score(docs: DataFrame, model: Model, carry: list[str] | None = None) -> DataFrame:
    """``carry`` columns (default: all) and ``score``, 0 to 1, of each whole text; a narrow pass.

    NULL, empty and blank texts have zero statistics and are scored like any
    other; without both labels to learn from every score is 0.  Only the text
    enters the score.  Repeated rows get equal scores; an empty table gives no rows.
    """
    carry = docs.columns if carry is None else carry
    row = docs.select(packed(carry), F.col("text").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.zeros(len(batch))
            if model.usable and len(batch):
                made = model.score(np.array([statistics(t.as_py()) for t in batch.column("_text")]))
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(made, pa.float64())], ["_row", "score"])

    scored = row.mapInArrow(run, with_row(row, "score double"))
    return scored.select(*unpacked([c for c in carry if c != "score"]), "score")
