"""Screenshot preparation and a pluggable visual scorer."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

IMAGE_SIZE = 224
#: Images held as tensors at a time (0.6 MB each at full size).
IMAGES = 32
#: Per-channel (R, G, B) mean and deviation. Fixed values.
MEAN = (0.485, 0.456, 0.406)
STD = (0.229, 0.224, 0.225)
#: The normalised value of each channel and byte.
LEVELS = (np.arange(256).astype(np.float32) / 255.0 - np.float32(MEAN)[:, None]) / np.float32(STD)[:, None]


def read_images(spark, root: str) -> DataFrame:
    """(path, label, height, width, n_channels, data) of ``legit/`` and ``phish/`` PNGs."""
    img = (spark.read.format("image").option("pathGlobFilter", "*.png")
           .option("recursiveFileLookup", True).load(root).select("image.*"))
    folder = F.regexp_extract("origin", "/(legit|phish)/[^/]*$", 1)
    return img.select(
        F.col("origin").alias("path"),
        F.when(folder == "phish", 1).when(folder == "legit", 0).alias("label"),
        "height", "width", F.col("nChannels").alias("n_channels"), "data")


def _tensor(data: bytes, h: int, w: int, c: int, size: int) -> np.ndarray:
    """BGR(A) or grey bytes -> resized, scaled, normalised float32 CHW values."""
    px = np.frombuffer(data, dtype=np.uint8).reshape(h, w, c)
    px = px[:, :, 2::-1] if c >= 3 else np.repeat(px[:, :, :1], 3, axis=2)
    rows = (np.arange(size) * h) // size
    cols = (np.arange(size) * w) // size
    # Values are looked up on the smaller of the two pictures.
    if h * w > size * size:
        px = px[rows][:, cols]
    x = np.stack([LEVELS[k][px[:, :, k]] for k in range(3)])
    if h * w <= size * size:
        x = x.take(rows, axis=1).take(cols, axis=2)
    return x.ravel()


def _parts(batches: Iterator[pd.DataFrame], size: int) -> Iterator[tuple[pd.DataFrame, list[tuple[np.ndarray | None, str | None]]]]:
    """A few images at a time, with their tensors or errors."""
    for whole in batches:
        for i in range(0, len(whole), IMAGES):
            pdf = whole.iloc[i:i + IMAGES]
            yield pdf, [_tensor_or_error(d, h, w, c, size) for d, h, w, c in
                        zip(pdf["data"], pdf["height"], pdf["width"], pdf["n_channels"])]


def _tensor_or_error(data: bytes, h: int, w: int, c: int, size: int) -> tuple[np.ndarray | None, str | None]:
    """A tensor, or why there is none: an unreadable file has a height of -1, a cut one too few bytes."""
    try:
        if data is None or min(h, w, c) < 1:
            raise ValueError("unreadable image")
        return _tensor(data, int(h), int(w), int(c), size), None
    except Exception as why:  # one bad image must not end the job
        return None, str(why) or type(why).__name__


def prepare_images(df: DataFrame, size: int = IMAGE_SIZE) -> DataFrame:
    """Add ``tensor array<float>`` (3*size*size), Arrow batches, no row UDF; NULL for an image that can't be read."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), IMAGES):
                part = batch.slice(i, IMAGES)
                made = [_tensor_or_error(*row, size)[0] for row in zip(
                    *(part.column(c).to_pylist() for c in ("data", "height", "width", "n_channels")))]
                # The values travel as one array, not as a list of arrays that is taken apart again.
                ends = np.cumsum([0] + [0 if t is None else len(t) for t in made])
                values = np.concatenate([np.empty(0, np.float32)] + [t for t in made if t is not None])
                tensors = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values),
                                                   mask=pa.array([t is None for t in made]))
                yield pa.record_batch([part.column("path"), part.column("label"), tensors], ["path", "label", "tensor"])

    cols = df.select("path", F.col("label").cast("int"), "height", "width", "n_channels", "data")
    return cols.mapInArrow(work, "path string, label int, tensor array<float>")


Scorer = Callable[[np.ndarray], np.ndarray]


def score_images(df: DataFrame, scorer: Scorer | None, size: int = IMAGE_SIZE) -> DataFrame:
    """(path, prob, ok, error) from a scorer over an (n, 3, size, size) batch.

    Preparation and scoring are one pass: no tensor leaves the task.  An image that cannot be read, or that
    the scorer fails on, gets the neutral 0.5, ``ok = false`` and the reason; the others of its batch keep
    their scores.  Without a scorer every image gets 0.5 and ``ok = false``.
    """
    def scored(tensors: list[np.ndarray]) -> list[tuple[float, bool, str | None]]:
        try:
            made = np.asarray(scorer(np.stack(tensors).reshape(-1, 3, size, size)), dtype=float).reshape(len(tensors))
            return [(float(p), True, None) if np.isfinite(p) else (0.5, False, "score is not a number") for p in made]
        except Exception as why:
            if len(tensors) == 1:
                return [(0.5, False, str(why) or type(why).__name__)]
            return [scored([t])[0] for t in tensors]  # find the image that fails

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, tensors in _parts(batches, size):
            good = [t for t, _ in tensors if t is not None]
            found = iter(scored(good) if good else [])
            rows = [next(found) if t is not None else (0.5, False, why) for t, why in tensors]
            yield pd.DataFrame({"path": pdf["path"].to_numpy(), "prob": [r[0] for r in rows], "ok": [r[1] for r in rows],
                                "error": [r[2] for r in rows]})

    if scorer is None:
        return df.select("path", F.lit(0.5).alias("prob"), F.lit(False).alias("ok"), F.lit("no model").alias("error"))
    cols = df.select("path", "height", "width", "n_channels", "data")
    return cols.mapInPandas(work, "path string, prob double, ok boolean, error string")
