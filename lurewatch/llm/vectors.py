"""Vectors in blocks: which rows take part, and blocked searches of a query set against all rows."""

from __future__ import annotations

from collections.abc import Callable

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


def usable(vector: Column, zero_too: bool = True) -> Column:
    """Neither NULL nor empty, no NULL, NaN or infinite component; ``zero_too=False`` leaves out zero vectors."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(finite, F.lit(False))
    return kept if zero_too else kept & F.exists(vector, lambda x: x != 0)


def blocked(rows: DataFrame, asked: DataFrame, search: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame],
            schema: str, shard: int, block: int) -> DataFrame:
    """Run ``search(queries, shard)`` for every block of ``asked`` and every shard of ``rows``.

    Both have ``vec_id`` and ``vector``.  Shards and blocks are dealt by a hash of
    the id, so copies of one vector lie in all shards, and no task ever holds
    more than about ``shard`` rows and ``block`` queries.  Rows travel once for
    each block and queries once for each shard.
    """
    shards = max(1, math.ceil(rows.count() / shard))
    blocks = max(1, math.ceil(asked.count() / block))

    def dealt(df: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        return df.select("vec_id", "vector", F.pmod(F.xxhash64("vec_id"), F.lit(n)).alias(own),
                         F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long"))).alias(other))

    left = dealt(asked, "_block", blocks, "_shard", shards).groupBy("_block", "_shard")
    right = dealt(rows, "_shard", shards, "_block", blocks).groupBy("_block", "_shard")
    return left.cogroup(right).applyInPandas(search, schema)


def best(found: DataFrame, k: int) -> DataFrame:
    """Merge the shards: ``query_id, rank, vec_id, score``, the ``k`` largest scores, ties to smaller ids."""
    from pyspark.sql.window import Window

    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id").asc())
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
