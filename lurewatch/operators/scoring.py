"""Lexical scorers: a deterministic heuristic and Spark ML models.

A scorer is either a ``Column`` builder (evaluated inside the cascade's single
narrow stage) or a ``DataFrame -> DataFrame`` function adding ``lex_prob``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.constants import FEATURE_NAMES, KNOWN_DOMAINS
from ..functions.features import feature_expressions

#: Features the heuristic reads, by meaning.
HEURISTIC_FEATURES = (
    "url_length", "has_ip_host", "has_https", "suspicious_keyword_count",
    "has_suspicious_tld", "brand_in_domain", "brand_domain_match",
    "tld_trust_score", "is_free_hosting", "is_known_legitimate",
)
#: Zero-based vector positions the browser build reads for the same ten values;
#: the last three are off by one there. Fixed values.
POSITIONAL_FEATURES = tuple(FEATURE_NAMES[i] for i in (0, 13, 14, 16, 17, 23, 24, 31, 32, 56))


def heuristic_expression(f: dict[str, Column], mode: str = "named") -> Column:
    """Risk in [0, 1] from a dict of feature expressions.

    ``mode="positional"`` reproduces the browser build's shifted positions.
    """
    if mode not in ("named", "positional"):
        raise ValueError(f"unknown mode {mode!r}")
    source = HEURISTIC_FEATURES if mode == "named" else POSITIONAL_FEATURES
    length, ip, https, kw, bad_tld, brand_in, brand_match, trust, free, known = (
        f[n] for n in source)

    def add(cond: Column, w: float) -> Column:
        return F.when(cond, F.lit(w)).otherwise(F.lit(0.0))

    risk = (F.lit(0.5) + add(ip > 0, 0.3) + add(https == 0, 0.05)
            + F.least(kw * 0.05, F.lit(0.2)) + add(bad_tld > 0, 0.15)
            + F.when(brand_match > 0, F.lit(0.25)).when(brand_in > 0, F.lit(0.1))
            .otherwise(F.lit(0.0))
            + add(trust < 0.5, 0.1) + add(free > 0, 0.1)
            + add(length > 75, 0.05) + add(length > 150, 0.1))
    return F.when(known > 0, F.lit(0.05)).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), risk)))


def heuristic_score(mode: str = "named", whitelist=None) -> Column:
    """Heuristic over ``prepare``/``host_columns`` output, no feature table needed."""
    names = HEURISTIC_FEATURES if mode == "named" else POSITIONAL_FEATURES
    return heuristic_expression(feature_expressions(whitelist or KNOWN_DOMAINS, names), mode)


def check_feature_columns(metadata_features: list[str], columns: list[str]) -> None:
    """Refuse to score when the model's features and the table's differ."""
    present = [n for n in columns if n in set(metadata_features)]
    if len(metadata_features) != len(FEATURE_NAMES) or present != list(metadata_features):
        missing = sorted(set(metadata_features) - set(columns))
        raise ValueError(
            f"model expects {len(metadata_features)} features; table offers {len(present)}"
            f" in a different layout (missing: {missing[:5]})")


def hard_label(prob: Column, threshold: float) -> Column:
    return (prob >= threshold).cast("int")


def ml_scorer(model, features_ready: bool = False):
    """``DataFrame -> DataFrame`` adding ``lex_prob`` from a fitted classifier.

    ``features_ready``: the table brings the feature columns, or the ``features`` vector of them.
    """
    from pyspark.ml.functions import vector_to_array

    from ..functions.features import extract_features, feature_vector

    def score(df: DataFrame) -> DataFrame:
        keep = df.columns
        table = df if features_ready else extract_features(df)
        scored = model.transform(df if features_ready and "features" in keep else feature_vector(table))
        return scored.select(*keep, vector_to_array("probability")[1].alias("lex_prob"))

    return score


def score_equal(df: DataFrame, model) -> DataFrame:
    """``df`` with ``lex_prob`` in place of its ``features``; equal vectors go through the model once.

    The distinct vectors grow far more slowly than a table of URLs.  Its rows travel
    to the scores with a 128-bit hash of their vector instead of the vector.
    """
    from .joins import salted_join

    key = F.concat_ws("|", F.xxhash64("features"), F.xxhash64(F.lit("features"), F.col("features")))
    rest = [F.col(n) for n in df.columns if n != "features"]
    # The second aggregate joins 0.0 and -0.0, which hash alike.  It uses the count, as the planner would
    # take a plain distinct below it out again and score every row.
    distinct = df.groupBy("features").agg(F.count(F.lit(1)).alias("_n"))
    scores = ml_scorer(model, features_ready=True)(distinct).groupBy(
        key.alias("_vector")).agg(F.max_by("lex_prob", "_n").alias("lex_prob"))
    return salted_join(df.select(*rest, key.alias("_vector")), scores, "_vector").drop("_vector")
