"""The 77 lexical features as native column expressions.

``extract_features`` adds only the requested columns, each its own expression,
so that asking for three features prunes the other 74.  The edit-distance array
is one shared intermediate column.  There is no shuffle, join or Python worker:
the dictionaries are small literals.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import partial

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from . import brands as B
from . import constants as C
from . import strings as S
from . import urls as U


def _flag(cond: Column) -> Column:
    return cond.cast("double")


def _per(num: Column, text: Column) -> Column:
    return num.cast("double") / F.greatest(F.length(text), F.lit(1))


def _affix_flag(d: Column) -> Column:
    """A listed word, then ``-`` or ``.``, then brand text (or the mirror image).

    The words hold no separator themselves, so only the first and the last
    token of the domain can be such a word.
    """
    head = F.regexp_extract(d, r"^([^.\-]*)[.\-]", 1)
    tail = F.regexp_extract(d, r"[.\-]([^.\-]*)$", 1)
    rest_after = F.substr(d, F.length(head) + 2)
    rest_before = F.substr(d, F.lit(1), F.length(d) - F.length(tail) - 1)
    return ((head.rlike(S.exactly(C.SUSPICIOUS_PREFIXES)) & B.brandish(rest_after))
            | (tail.rlike(S.exactly(C.SUSPICIOUS_SUFFIXES)) & B.brandish(rest_before)))


def _hyphen_flag(d: Column) -> Column:
    """Two hyphenated parts, one a brand, the other telling.

    If the first part is the brand any second part counts; otherwise the first
    part has to contain a combination word.
    """
    first = F.substring_index(d, "-", 1)
    second = F.substring_index(d, "-", -1)
    telling = first.rlike(S.any_of(C.COMBO_WORDS))
    return (S.count_of(d, "-") == 1) & (
        (first.rlike(S.exactly(C.BRANDS)) & (second != ""))
        | (telling & B.other_brand_near([first, second], first, C.BRANDS)))


def _near_flag(d: Column, dist: Column, match: Column) -> Column:
    """A brand 1..2 edits away that comes before the first matching brand."""
    near_at = F.array_position(F.transform(dist, lambda x: x.between(1, 2)), True)
    match_at = F.array_position(F.transform(
        S.str_array(C.BRANDS),
        lambda b: d.contains(b) & (F.length(d) - F.length(b) <= 1)), True)
    return (F.length(d) >= 3) & (near_at > 0) & F.when(
        match, near_at < match_at).otherwise(F.lit(True))


def feature_expressions(whitelist: Sequence[str] = C.KNOWN_DOMAINS,
                        names: Sequence[str] = C.FEATURE_NAMES) -> dict[str, Column]:
    """Feature name -> expression over the columns of ``prepare``."""
    c = F.col
    u, nl, h, p, q = c("u"), c("netloc"), c("host"), c("path"), c("query")
    d, tld, ip = c("domain_base"), c("tld"), c("is_ip")
    lu, lp = F.lower(u), F.lower(p)
    port = F.when(nl.contains(":"), F.substring_index(nl, ":", -1)).otherwise(F.lit(""))
    port_is_number = port.rlike(r"^\p{Nd}+$")
    labels = F.split(h, r"\.")
    bare_path = F.replace(p, F.lit("/"), F.lit(""))
    random_text = F.concat(d, bare_path)
    segments = F.size(F.filter(F.split(p, "/"), lambda s: s != ""))
    words = U.domain_words(d)
    longest_word = F.coalesce(F.array_max(F.transform(words, F.length)), F.lit(0))
    vowels = S.count_match(d, "[aeiou]")
    vowel_ratio = _per(vowels, d)
    domain_digits = S.count_match(d, r"\p{Nd}")
    hex_escapes = S.count_match(u, "%[0-9a-fA-F]{2}")
    no_digits = F.regexp_replace(d, r"\p{Nd}", "")
    brand_in = B.contains_brand(d)
    brand_match = B.equals_or_one_longer(d)
    known = lambda: U.in_whitelist("host", whitelist) | (
        h.contains(".") & ~ip & U.in_whitelist("reg_domain", whitelist))
    shortener = lambda: S.in_list("host", C.SHORTENERS)

    e: dict[str, Callable[[], Column]] = {
        "url_length": lambda: F.length(u),
        "hostname_length": lambda: F.length(h),
        "path_length": lambda: F.length(p),
        "num_digits": lambda: S.count_match(u, r"\p{Nd}"),
        "num_subdomains": lambda: F.greatest(F.size(labels) - 2, F.lit(0)),
        "has_ip_host": lambda: _flag(ip),
        "has_https": lambda: _flag(c("scheme") == "https"),
        "has_port": lambda: _flag(nl.contains(":")),
        "suspicious_keyword_count": lambda: S.keyword_hits("lower(u)", C.SUSPICIOUS_KEYWORDS),
        "has_suspicious_tld": lambda: _flag(S.in_list("tld", C.SUSPICIOUS_TLDS)),
        "domain_entropy": lambda: S.entropy(d),
        "url_shortener": lambda: _flag(shortener()),
        # v2
        "digit_ratio": lambda: _per(S.count_match(u, r"\p{Nd}"), u),
        "hex_encoded_count": lambda: hex_escapes,
        "max_consecutive_special": lambda: S.max_special_run(u),
        "brand_in_domain": lambda: _flag(brand_in),
        "brand_domain_match": lambda: _flag(brand_match),
        "has_port_number": lambda: _flag(port_is_number & ~port.isin("80", "443")),
        "has_single_char_subdomain": lambda: _flag(h.rlike(r"(?:^|\.)[^.]\.[^.]*\.")),
        "path_depth": lambda: segments,
        "query_length": lambda: F.length(q),
        "has_encoded_chars": lambda: _flag(u.contains("%") | lu.contains("&amp;")),
        "domain_digit_count": lambda: domain_digits,
        "hostname_hyphen_count": lambda: S.count_of(h, "-"),
        # v3
        "tld_trust_score": lambda: F.when(tld == "", F.lit(0.0))
        .when(S.in_list("tld", C.TRUSTED_TLDS), F.lit(1.0))
        .when(S.in_list("tld", C.SUSPICIOUS_TLDS), F.lit(0.0)).otherwise(F.lit(0.5)),
        "is_free_hosting": lambda: _flag(U.suffix_matches("host", C.FREE_HOSTING)),
        "domain_has_digit_insert": lambda: _flag(
            d.rlike(r"\p{Nd}") & (F.length(no_digits) >= 3) & S.near_any(no_digits, C.BRANDS, 2)),
        "registered_domain_length": lambda: F.length(c("reg_domain")),
        # v4
        "vowel_ratio": lambda: vowel_ratio,
        "char_repetition_ratio": lambda: F.lit(1.0) - _per(S.distinct_chars(d), d),
        "has_admin_path": lambda: _flag(lp.rlike(S.any_of(C.ADMIN_PATHS))),
        "has_suspicious_path": lambda: _flag(lp.rlike(S.any_of(C.SUSPICIOUS_PATHS))),
        "brand_in_path": lambda: _flag(brand_in & B.contains_brand(lp)),
        "randomness_score": lambda: _per(S.distinct_chars(random_text), random_text),
        "host_to_url_ratio": lambda: _per(F.length(h), u),
        "path_to_url_ratio": lambda: _per(F.length(p), u),
        "num_query_params": lambda: F.when(q == "", F.lit(0)).otherwise(S.count_of(q, "&") + 1),
        "has_fragment": lambda: _flag(u.contains("#")),
        "max_domain_word_length": lambda: longest_word,
        "num_domain_words": lambda: F.size(words),
        "tld_length": lambda: F.length(tld),
        "path_has_numbers": lambda: S.count_match(p, r"\p{Nd}"),
        "has_double_slash_path": lambda: _flag(p.contains("//")),
        "path_entropy": lambda: S.entropy(bare_path),
        "domain_vowel_consonant_ratio": lambda: vowels.cast("double")
        / F.greatest(F.length(d) - vowels, F.lit(1)),
        "num_special_in_path": lambda: S.count_match(p, r"[^\p{L}\p{N}/.]"),
        "has_long_query": lambda: _flag(F.length(q) > 100),
        # v5
        "is_known_legitimate": lambda: _flag(known()),
        "domain_name_in_whitelist": lambda: _flag(~known() & U.suffix_matches("host", whitelist)),
        # v6
        "brand_near_match": lambda: _flag(_near_flag(d, c("brand_distances"), brand_match)),
        "brand_hyphenated_domain": lambda: _flag(_hyphen_flag(d)),
        "suspicious_prefix_suffix": lambda: _flag(_affix_flag(d)),
        "has_non_ascii_chars": lambda: _flag(d.rlike(r"[^\x00-\x7F]")),
        "short_unknown_domain": lambda: _flag(
            (F.length(d) < 12) & ~shortener() & ~known() & ~ip
            & ((vowel_ratio < 0.3) | (S.entropy(d) > 3.0))),
        # v7
        "domain_consonant_cluster_ratio": lambda: _per(S.max_consonant_run(d), d),
        "url_encoding_density": lambda: _per(hex_escapes, u),
        "domain_starts_with_digit": lambda: _flag(d.rlike(r"^\p{Nd}")),
        "domain_ends_with_digit": lambda: _flag(d.rlike(r"\p{Nd}$")),
        "path_has_file_extension": lambda: _flag(p.rlike(r"\.[a-zA-Z]{2,5}$")),
        "has_suspicious_file_ext": lambda: _flag(lp.rlike("(?:" + S.any_of(C.SUSPICIOUS_EXTENSIONS) + ")$")),
        "domain_has_repeated_chars": lambda: _flag(F.length(d) != S.distinct_chars(d)),
        "domain_avg_word_length": lambda: longest_word,
        "path_to_domain_ratio": lambda: _per(F.length(p), d),
        "has_double_scheme": lambda: _flag(lu.contains("httphttp") | lu.contains("httpshttps")),
        "brand_min_levenshtein": lambda: F.when(d == "", F.lit(10)).otherwise(
            F.least(F.lit(10), F.array_min(c("brand_distances")))),
        "domain_digit_ratio": lambda: _per(domain_digits, d),
        "path_segment_count": lambda: segments,
        "query_has_encoded": lambda: _flag(q.contains("%")),
        "has_suspicious_port": lambda: _flag(
            port_is_number & ~F.ltrim(port, F.lit("0")).isin("80", "443", "8080", "8443")),
    }
    for name, ch in (("num_dots", "."), ("num_hyphens", "-"), ("num_underscores", "_"),
                     ("num_slashes", "/"), ("num_question", "?"), ("num_equal", "="),
                     ("num_at", "@"), ("num_percent", "%")):
        e[name] = partial(S.count_of, u, ch)
    return {n: e[n]().cast("double") for n in names}


def prepare(df: DataFrame, url: str = "url") -> DataFrame:
    """Parsed URL, domain parts and the shared edit-distance array."""
    return U.host_columns(df, url).withColumn("brand_distances", B.distances(F.col("domain_base")))


def extract_features(df: DataFrame, names: Sequence[str] = C.FEATURE_NAMES, url: str = "url",
                     whitelist: Sequence[str] | DataFrame = C.KNOWN_DOMAINS) -> DataFrame:
    """Add the named feature columns to ``df`` (input columns are kept)."""
    from ..operators.joins import with_reputation

    ready, whitelist = with_reputation(prepare(df, url), whitelist)
    exprs = feature_expressions(whitelist, names)
    return ready.select(
        *[F.col(n) for n in df.columns], *[exprs[n].alias(n) for n in names])


def feature_array(df: DataFrame, url: str = "url") -> DataFrame:
    """Fixed-order ``array<double>`` of all features."""
    keep = df.columns
    return extract_features(df, url=url).select(
        *keep, F.array(*[F.col(n) for n in C.FEATURE_NAMES]).alias("features"))


def feature_vector(df: DataFrame) -> DataFrame:
    """ML vector column ``features`` from the 77 feature columns."""
    return VectorAssembler(inputCols=list(C.FEATURE_NAMES), outputCol="features",
                           handleInvalid="error").transform(df)


def feature_long(df: DataFrame, url: str = "url") -> DataFrame:
    """One row per URL and feature."""
    keep = df.columns
    return extract_features(df, url=url).unpivot(
        keep, list(C.FEATURE_NAMES), "feature", "value")
