"""Screenshot-like PNG files derived from the ``embeddings`` table."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F


def _png(px: np.ndarray) -> bytes:
    """RGB pixels (h, w, 3) as a PNG file."""
    def chunk(kind: bytes, body: bytes) -> bytes:
        return (struct.pack(">I", len(body)) + kind + body
                + struct.pack(">I", zlib.crc32(kind + body)))

    h, w, _ = px.shape
    raw = b"".join(b"\0" + px[y].tobytes() for y in range(h))
    return (b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0))
            + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def pixels(vec: np.ndarray) -> np.ndarray:
    """A vector as a small RGB picture, scaled to its own range."""
    v = np.asarray(vec, dtype=np.float64)
    side = max(int(len(v) ** 0.5), 1)
    v = v[: side * side]
    span = float(v.max() - v.min()) or 1.0
    grey = np.floor((v - v.min()) / span * 255).astype(np.uint8).reshape(side, side)
    return np.stack([grey, 255 - grey, grey // 2], axis=2)


def write_pngs(embeddings: DataFrame, root: str) -> DataFrame:
    """Write a PNG per row below ``legit/`` or ``phish/``; returns (path, label)."""
    id_col, vec_col = embeddings.columns[0], next(
        n for n, t in embeddings.dtypes if t.startswith("array"))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        uri = root if "://" in root else f"file://{root}"
        target, base = fs.FileSystem.from_uri(uri)
        for folder in ("legit", "phish"):
            target.create_dir(f"{base}/{folder}", recursive=True)
        for pdf in batches:
            out = []
            for i, v in zip(pdf["id"], pdf["vec"]):
                label = int(i) % 2
                name = f"{('legit', 'phish')[label]}/{int(i)}.png"
                # whole-file writes under a fixed name: a retried task rewrites the same file
                with target.open_output_stream(f"{base}/{name}") as f:
                    f.write(_png(pixels(v)))
                out.append((name, label))
            yield pd.DataFrame(out, columns=["path", "label"])

    rows = embeddings.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).alias("vec"))
    return rows.mapInPandas(work, "path string, label int")
