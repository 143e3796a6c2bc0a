"""String kernels: ``Column -> Column``, no Python workers."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, functions as F


def sql_list(values: Iterable[str]) -> str:
    """Comma-separated SQL string literals."""
    return ", ".join("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values)


def str_array(values: Iterable[str]) -> Column:
    """A constant string array (folded to one literal by the optimizer)."""
    return F.expr(f"array({sql_list(values)})")


def in_list(expression: str, values: Iterable[str]) -> Column:
    """``expression IN (values)``; long lists become one hash-set lookup.

    Takes SQL text so that a long list costs one call to the JVM, not one per value.
    """
    return F.expr(f"({expression}) IN ({sql_list(values)})")


def any_of(words: Iterable[str]) -> str:
    """Regex alternation matching any of the literal ``words``."""
    return "|".join(w.replace(".", r"\.") for w in words)


def exactly(words: Iterable[str]) -> str:
    """Regex matching one of the literal ``words`` and nothing else."""
    return f"^(?:{any_of(words)})$"


def chars(s: Column) -> Column:
    """Characters of ``s`` in order; empty array for the empty string."""
    return F.filter(F.split(s, ""), lambda c: c != "")


def count_of(s: Column, needle: str) -> Column:
    """Occurrences of a one-character ``needle``."""
    return F.length(s) - F.length(F.replace(s, F.lit(needle), F.lit("")))


def count_match(s: Column, pattern: str) -> Column:
    return F.regexp_count(s, F.lit(pattern))


def distinct_chars(s: Column) -> Column:
    return F.size(F.array_distinct(chars(s)))


def entropy(s: Column) -> Column:
    """Shannon entropy (bits per character); 0 for the empty string.

    Runs over the distinct characters only: H = log2(n) - sum(c*log2(c))/n.
    """
    n = F.length(s)

    def add(acc: Column, c: Column) -> Column:
        k = (n - F.length(F.replace(s, c, F.lit("")))).cast("double")
        return acc + k * F.log2(k)

    weighted = F.aggregate(F.array_distinct(chars(s)), F.lit(0.0), add)
    return F.when(n > 0, F.log2(n.cast("double")) - weighted / n).otherwise(F.lit(0.0))


def longest_match(s: Column, pattern: str) -> Column:
    """Length of the longest non-overlapping match of ``pattern`` (0 if none)."""
    runs = F.regexp_extract_all(s, F.lit(f"({pattern})"), F.lit(1))
    return F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0))


def max_special_run(s: Column) -> Column:
    return longest_match(s, r"[^\p{L}\p{N}]+")


def max_consonant_run(s: Column) -> Column:
    return longest_match(s, r"[^aeiou\P{L}]+")


def keyword_hits(expression: str, keywords: Sequence[str]) -> Column:
    """How many of ``keywords`` occur in the SQL expression (each counted once)."""
    return F.expr(" + ".join(
        f"CAST(contains({expression}, {sql_list([k])}) AS INT)" for k in keywords))


def near_any(s: Column, words: Sequence[str], k: int) -> Column:
    """Some word is within edit distance ``k``.

    The length test is exact (distance >= length difference) and spares the
    dynamic program for most rows.
    """
    lo, hi = min(map(len, words)) - k, max(map(len, words)) + k
    return F.length(s).between(lo, hi) & F.exists(
        str_array(words), lambda w: F.levenshtein(s, w, k) >= 0)


def md5_bucket(s: Column, n: int) -> Column:
    """Deterministic bucket in ``[0, n)`` from the first 32 bits of md5."""
    return F.pmod(F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("bigint"), F.lit(n))


def pick(values: Sequence[str], seed: Column) -> Column:
    """Deterministic choice of one of ``values``."""
    return F.element_at(str_array(values), (md5_bucket(seed, len(values)) + 1).cast("int"))
