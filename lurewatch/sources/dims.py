"""Reference dictionaries as small DataFrames, list order kept in ``idx``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import constants as C


def _indexed(spark: SparkSession, values, name: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(values)), f"idx int, {name} string")


def brands(spark: SparkSession, extended: bool = False) -> DataFrame:
    values = C.BRANDS + C.EXTRA_GENERATOR_BRANDS if extended else C.BRANDS
    return _indexed(spark, values, "brand")


def tlds(spark: SparkSession) -> DataFrame:
    """(tld, trust): 1 trusted, 0 suspicious."""
    rows = [(t, 1.0) for t in C.TRUSTED_TLDS] + [(t, 0.0) for t in C.SUSPICIOUS_TLDS]
    return spark.createDataFrame(rows, "tld string, trust double")


def whitelist(spark: SparkSession, path: str | None = None,
              ranked: DataFrame | None = None) -> DataFrame:
    """Known-legitimate domains.

    ``path``: text file(s), one domain per line (``#`` starts a comment).
    ``ranked``: a feed with a ``domain`` column.  Neither: the starter set.
    """
    if path is not None:
        lines = spark.read.text(path).select(F.lower(F.trim("value")).alias("domain"))
        return lines.filter((F.col("domain") != "") & ~F.col("domain").startswith("#")).distinct()
    if ranked is not None:
        return ranked.select(F.lower("domain").alias("domain")).distinct()
    return spark.createDataFrame([(d,) for d in C.KNOWN_DOMAINS], "domain string")


def free_hosting(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(d,) for d in C.FREE_HOSTING], "domain string")


def shorteners(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(d,) for d in C.SHORTENERS], "domain string")
