"""Brand look-alike expressions shared by features and rules.

Containment tests are single-pass regex alternations; edit distances use the
thresholded built-in ``levenshtein`` behind an exact length test.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from . import constants as C
from .strings import any_of, near_any, str_array


def contains_brand(s: Column, brands: Sequence[str] = C.BRANDS) -> Column:
    return s.rlike(any_of(brands))


def brandish(s: Column, brands: Sequence[str] = C.BRANDS) -> Column:
    """Contains a brand or is at most one edit away from one."""
    return contains_brand(s, brands) | near_any(s, brands, 1)


def equals_or_one_longer(s: Column, brands: Sequence[str] = C.BRANDS) -> Column:
    """Contains a brand and is at most one character longer than it."""
    alt = any_of(brands)
    return s.rlike(f"(?s)^(?:.?(?:{alt})|(?:{alt}).)$")


def distances(s: Column, brands: Sequence[str] = C.BRANDS) -> Column:
    """Edit distance to every brand, in brand order."""
    return F.transform(str_array(brands), lambda b: F.levenshtein(s, b))


def first_near(s: Column, brands: Sequence[str] = C.BRANDS, k: int = 2) -> Column:
    """1-based index of the first brand at distance 1..k (NULL if none)."""
    lo, hi = min(map(len, brands)) - k, max(map(len, brands)) + k
    flags = F.transform(str_array(brands), lambda b: F.levenshtein(s, b, k) >= 1)
    return F.when(F.length(s).between(max(lo, 3), hi),
                  F.nullif(F.array_position(flags, True).cast("int"), F.lit(0)))


def other_brand_near(parts: list[Column], first: Column, brands: Sequence[str]) -> Column:
    """A brand other than ``first`` is within one edit of one of ``parts``."""
    def near(b: Column) -> Column:
        hit = F.lit(False)
        for p in parts:
            hit = hit | (F.levenshtein(p, b, 1) >= 0)
        return (b != first) & hit

    return F.exists(str_array(brands), near)
