"""Feed readers and sinks, all with explicit schemas.

A ``cap`` keeps the first n rows of a defined order (rank, or the URL text
where a feed has none), so a capped read gives the same rows on any number of
executors.  By default everything is read.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import constants as C

LABELLED_SCHEMA = "url string, label int"
#: Usual row caps of the four feeds, for callers that want them. Fixed values.
VERIFIED_CAP, LINES_CAP, COMMENTED_CAP, RANKED_CAP = 20_000, 10_000, 10_000, 20_000


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for intermediate tables.

    On a cluster this is below the shared folder in ``spark.checkpoint.dir``;
    a machine-local folder is used only where that is unset (tests).
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        base = os.path.join(tempfile.gettempdir(), "lurewatch-work")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """Deal a scan out before costly expressions: a partition per core at least, about ``rows`` rows in one at most.

    The partitions of a scan follow bytes, but a Parquet row group is read whole by one of them: a table of few
    row groups leaves most partitions empty, and full ones grow with the table.  So rows are counted for each
    partition (from the footers); a scan that is dealt out well is returned as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    counts = df.groupBy(F.spark_partition_id().alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    filled, most, total = counts.agg(F.count("_n"), F.max("_n"), F.sum("_n")).first()
    if filled >= cores and most <= rows:
        return df
    return df.repartition(cores * max(1, -(-(total or 0) // (cores * rows))))


def _trimmed(name: str):
    """Without white space of any kind at the ends."""
    return F.regexp_replace(name, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def _cap(df: DataFrame, cap: int | None, *order) -> DataFrame:
    return df if cap is None else df.orderBy(*order).limit(cap)


def read_labelled_csv(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.schema(LABELLED_SCHEMA).option("header", True)
            .option("escape", '"').csv(path).dropna(subset=["url", "label"]))


def fallback_sample(spark: SparkSession, kind: str = "feed") -> DataFrame:
    rows = C.FALLBACK_FEED_ROWS if kind == "feed" else C.FALLBACK_TRAINING_ROWS
    return spark.createDataFrame(list(rows), LABELLED_SCHEMA)


def or_fallback(df: DataFrame, kind: str = "feed") -> DataFrame:
    """The input, or the built-in sample when the input has no rows."""
    return fallback_sample(df.sparkSession, kind) if df.isEmpty() else df


def read_verified_csv(spark: SparkSession, path: str, cap: int | None = None) -> DataFrame:
    """Header CSV with a ``url`` column among others; only that one is read."""
    raw = spark.read.option("header", True).option("escape", '"').csv(path)
    out = raw.select(_trimmed("url").alias("url")).filter(F.col("url") != "")
    return _cap(out, cap, "url").withColumn("label", F.lit(1))


def read_lines(spark: SparkSession, path: str, cap: int | None = None) -> DataFrame:
    """One URL per line; lines not starting with ``http`` are dropped."""
    out = spark.read.text(path).select(_trimmed("value").alias("url"))
    return _cap(out.filter(F.col("url").startswith("http")), cap, "url").withColumn(
        "label", F.lit(1))


def read_commented_csv(spark: SparkSession, path: str,
                       cap: int | None = None) -> DataFrame:
    """``#``-commented CSV (id, dateadded, url, threat, status); online rows only."""
    schema = "id string, dateadded string, url string, threat string, status string"
    raw = (spark.read.schema(schema).option("comment", "#").option("escape", '"').csv(path))
    out = (raw.select(_trimmed("url").alias("url"), _trimmed("status").alias("status"))
           .filter((F.col("url") != "") & (F.col("status") == "online")).select("url"))
    return _cap(out, cap, "url").withColumn("label", F.lit(1))


def read_ranked(spark: SparkSession, path: str, cap: int | None = None) -> DataFrame:
    """Headerless ``rank,domain``; the best ``cap`` ranks as legitimate URLs."""
    raw = spark.read.schema("rank bigint, domain string").csv(path)
    out = raw.withColumn("domain", _trimmed("domain")).filter(F.col("domain") != "")
    return _cap(out, cap, "rank", "domain").select(
        "rank", "domain", F.concat(F.lit("https://"), F.col("domain")).alias("url"),
        F.lit(0).alias("label"))


def union_feeds(feeds: dict[str, DataFrame]) -> DataFrame:
    """Union in the given order; ``priority`` is the position of the feed, ``seq`` a row's place in it (0 if unknown)."""
    out = None
    for i, (name, df) in enumerate(feeds.items()):
        seq = F.col("seq").cast("long") if "seq" in df.columns else F.lit(0).cast("long")
        part = df.select("url", "label", F.lit(name).alias("source"), F.lit(i).alias("priority"), seq.alias("seq"))
        out = part if out is None else out.unionByName(part)
    return out


def write_corpus(df: DataFrame, path: str) -> None:
    (df.select("url", "label").write.option("header", True).option("escape", '"')
     .option("quoteAll", True).csv(path))


def read_screenshots(spark: SparkSession, root: str) -> DataFrame:
    """PNG files under ``legit/`` and ``phish/``; the folder gives the label."""
    df = (spark.read.format("binaryFile").option("pathGlobFilter", "*.png")
          .option("recursiveFileLookup", True).load(root))
    folder = F.regexp_extract("path", "/(legit|phish)/[^/]*$", 1)
    out = df.withColumn("label", F.when(folder == "phish", 1).when(folder == "legit", 0))
    out = out.filter(F.col("label").isNotNull()).select("path", "label", "length", "content")
    if out.select("path").isEmpty():
        raise FileNotFoundError(f"no screenshots under {root}")
    return out
