"""Compute derived columns exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def settle(df: DataFrame, *names: str) -> DataFrame:
    """Materialise ``names`` in the row as plain columns.

    Long chains of derived columns get copied into every filter and join key
    pushed below them, and each copy holds the whole chain again.  A one-element
    ``inline`` ends that: predicates stay above it, the chain below is computed
    once per row, and it is still a narrow, code-generated step.
    """
    keep = [c for c in df.columns if c not in names]
    return df.select(*keep, F.inline(F.array(F.struct(*names))))
