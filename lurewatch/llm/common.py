"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..sources.feeds import work_dir

#: A word: a run of characters other than space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once below the shared folder and read it back.

    Later jobs then neither repeat the work nor depend on the memory or the
    local disks of single executors.
    """
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def merged(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that shuffles and sorts both sides, whatever sizes Spark expects.

    Spark takes an exploded table for as small as it was before, and a Parquet table for as small as its
    compressed files, and so may send a side that grows with the input through the driver to all executors.
    """
    return df.hint("merge")


def word_count(text: Column) -> Column:
    """Number of words of a text, NULL counting as empty; keeps no list of words."""
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "w")
    return F.length(F.translate(marks, " \t\n\x0b\x0c\r", "")).cast("long")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ordered_hash(values: Column, buckets: Column | int) -> Column:
    """Bucket 0..buckets-1 of a value, NULL included."""
    return F.pmod(F.xxhash64(values), F.lit(buckets) if isinstance(buckets, int) else buckets)


def small_batches(spark: SparkSession, rows: int) -> None:
    """From now on Arrow batches of this session hold ``rows`` rows at most; a lower bound that is set already stays.

    By default 10,000 whole texts travel in one, and executors keep the memory of their largest batches.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def packed(columns: list[str]) -> Column:
    """Columns of any name as one column ``_row``, so that they cannot clash with those of an operator."""
    return F.struct(*[F.col(f"`{c}`") for c in columns] or [F.lit(0).alias("none")]).alias("_row")


def unpacked(columns: list[str]) -> list[Column]:
    return [F.col(f"_row.`{c}`") for c in columns]


def with_row(df: DataFrame, more: str) -> StructType:
    """The schema of ``_row`` as it is in ``df``, NULL flags included, and of more columns."""
    out = StructType([df.schema["_row"]])
    for field in StructType.fromDDL(more).fields:
        out = out.add(field)
    return out


def give_back() -> None:
    """Return freed memory of this Python worker to the system; workers live on after a task, and would keep it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)
