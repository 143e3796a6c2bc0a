"""Typosquat and look-alike generators over a table of protected names.

Input: ``DataFrame(brand)`` (or ``domain``) of any size; output one row per variant
with ``brand, family, pos, variant``.  ``pos`` is the 1-based place of the variant in
its family, which makes per-family caps a filter.  All are narrow: the word
tables are literals and the expansion is an ``explode`` per input row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import constants as C
from ..functions import strings as S

def _brand() -> Column:
    return F.col("brand")


def _head(i: Column) -> Column:
    return F.substr(_brand(), F.lit(1), i - 1)


def _tail(i: Column) -> Column:
    return F.substr(_brand(), i)


def _char(i: Column) -> Column:
    return F.substr(_brand(), i, F.lit(1))


def _positions(last: Column) -> Column:
    return F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))


def _emit(df: DataFrame, family: str, variants: Column) -> DataFrame:
    keep = df.columns
    return df.select(*keep, F.posexplode(variants).alias("_p", "variant")).select(
        *keep, F.lit(family).alias("family"), (F.col("_p") + 1).alias("pos"), "variant")


def _first(df: DataFrame, cap: int | None, per_word: int) -> DataFrame:
    """First ``cap`` rows, template word by template word, then name by name.

    Names come in list order (``idx``) where the input has it.
    """
    if cap is None:
        return df
    name = "idx" if "idx" in df.columns else "brand"
    return df.orderBy(F.floor((F.col("pos") - 1) / per_word), name, "pos").limit(cap)


def _swapped() -> Column:
    return F.transform(_positions(F.length(_brand()) - 1),
                       lambda i: F.concat(_head(i), _char(i + 1), _char(i), _tail(i + 2)))


def _omitted() -> Column:
    return F.transform(_positions(F.length(_brand())), lambda i: F.concat(_head(i), _tail(i + 1)))


def _doubled() -> Column:
    return F.transform(_positions(F.length(_brand())), lambda i: F.concat(_head(i), _char(i), _tail(i)))


def _substituted(table: Sequence[tuple[str, str]]) -> Column:
    """One character replaced by each of its images, by position then image."""
    subs = F.array(*[F.struct(F.lit(a).alias("c"), F.lit(b).alias("r")) for a, b in table])
    return F.flatten(F.transform(_positions(F.length(_brand())), lambda i: F.transform(
        F.filter(subs, lambda t: t["c"] == _char(i)),
        lambda t: F.concat(_head(i), t["r"], _tail(i + 1)))))


def _character_level() -> Column:
    """The variants of one name meet in one row, so they are made distinct as an array, without a shuffle."""
    return F.array_distinct(F.concat(_omitted(), _doubled(), _swapped(), _substituted(C.LEET_SHORT)))


def _filled(templates: Sequence[str]) -> Column:
    """``{brand}`` filled into constant templates, in order."""
    return F.transform(S.str_array(templates), lambda t: F.replace(t, F.lit("{brand}"), _brand()))


def _templates(df: DataFrame, family: str, templates: Sequence[str]) -> DataFrame:
    return _emit(df, family, _filled(templates))


def _hosted(seed: int = 42) -> Column:
    host = S.pick(C.FREE_HOSTING, F.concat(_brand(), F.lit(f"|host|{seed}")))
    word = S.pick(C.COMBO_WORDS[:10], F.concat(_brand(), F.lit(f"|word|{seed}")))
    return F.array(
        F.concat(F.lit("https://"), _brand(), F.lit("-"), word, F.lit("."), host, F.lit("/login")),
        F.concat(F.lit("https://"), word, F.lit("-"), _brand(), F.lit("."), host, F.lit("/verify")))


def _hosted_sample(n: int = 3, seed: int = 42) -> Column:
    ranked = F.array_sort(F.transform(S.str_array(C.FREE_HOSTING), lambda h: F.struct(
        F.md5(F.concat_ws("|", _brand(), h, F.lit(str(seed)))).alias("k"), h.alias("h"))))
    return F.transform(F.slice(ranked, 1, n), lambda x: F.concat(
        F.lit("https://"), _brand(), F.lit("-secure."), x["h"], F.lit("/login")))


#: The variants of a name by family: every per-name family there is.
FAMILIES: dict[str, Callable[[], Column]] = {
    "swap": _swapped,
    "omission": _omitted,
    "duplication": _doubled,
    "leet": lambda: _substituted(C.LEET),
    "homograph": lambda: _substituted(C.HOMOGRAPHS),
    "bitsquat": lambda: _substituted([(c, r) for c, images in C.BITFLIPS for r in images]),
    "char": _character_level,
    "combo": lambda: _filled([
        t for w in C.COMBO_SQUAT_WORDS
        for t in (f"{{brand}}{w}", f"{{brand}}-{w}", f"{w}{{brand}}", f"{w}-{{brand}}")]),
    "hyphenated": lambda: _filled([t for w in C.COMBO_WORDS[:15] for t in (f"{w}-{{brand}}", f"{{brand}}-{w}")]),
    "affix": lambda: _filled([
        t for w in C.AFFIX_PREFIXES for t in (f"{w}{{brand}}", f"{w}-{{brand}}")] + [
        t for w in C.AFFIX_SUFFIXES for t in (f"{{brand}}{w}", f"{{brand}}-{w}")]),
    "subdomain": lambda: _filled([t for w in C.SUBDOMAIN_PREFIXES for t in (f"{w}.{{brand}}", f"{w}-{{brand}}")]),
    "subdomain_abuse": lambda: _filled([
        t for s in C.SUBDOMAIN_ABUSE_SUBS for d in C.SUBDOMAIN_ABUSE_TLDS
        for t in (f"{s}.{{brand}}.{d}", f"{{brand}}.{s}.{d}")]),
    "path": lambda: _filled([
        f"http://{d}.{t}{p}" for d in C.PATH_PHISH_DOMAINS for t in C.SUSPICIOUS_TLDS[:5]
        for p in C.PATH_PHISH_PATHS]),
    "free_hosting": _hosted,
    "free_hosting_sampled": _hosted_sample,
}


def of_families(df: DataFrame, families: Sequence[str]) -> DataFrame:
    """The variants of several families, by one explode over an array of families: the names are read once."""
    each = F.array(*[F.struct(F.lit(f).alias("family"), FAMILIES[f]().alias("variants")) for f in families])
    keep = df.columns
    return df.select(*keep, F.explode(each).alias("_f")).select(
        *keep, F.col("_f.family").alias("family"), F.posexplode("_f.variants").alias("_p", "variant")).select(
        *keep, "family", (F.col("_p") + 1).alias("pos"), "variant")


def swaps(df: DataFrame) -> DataFrame:
    """Two neighbouring characters exchanged."""
    return _emit(df, "swap", _swapped())


def omissions(df: DataFrame) -> DataFrame:
    """One character left out."""
    return _emit(df, "omission", _omitted())


def duplications(df: DataFrame) -> DataFrame:
    """One character doubled."""
    return _emit(df, "duplication", _doubled())


def leet(df: DataFrame, table: Sequence[tuple[str, str]] = C.LEET) -> DataFrame:
    return _emit(df, "leet", _substituted(table))


def homographs(df: DataFrame) -> DataFrame:
    return _emit(df, "homograph", FAMILIES["homograph"]())


def bitsquats(df: DataFrame) -> DataFrame:
    return _emit(df, "bitsquat", FAMILIES["bitsquat"]())


def char_variants(df: DataFrame) -> DataFrame:
    """Distinct character-level variants per name (omission, double, swap, leet)."""
    return _emit(df, "char", _character_level())


def combos(df: DataFrame) -> DataFrame:
    return _emit(df, "combo", FAMILIES["combo"]())


def hyphenated(df: DataFrame) -> DataFrame:
    return _emit(df, "hyphenated", FAMILIES["hyphenated"]())


def affixes(df: DataFrame) -> DataFrame:
    return _emit(df, "affix", FAMILIES["affix"]())


def subdomains(df: DataFrame) -> DataFrame:
    return _emit(df, "subdomain", FAMILIES["subdomain"]())


def subdomain_abuse(df: DataFrame) -> DataFrame:
    return _emit(df, "subdomain_abuse", FAMILIES["subdomain_abuse"]())


def paths(df: DataFrame) -> DataFrame:
    return _emit(df, "path", FAMILIES["path"]())


def urgency(df: DataFrame, cap: int | None = None) -> DataFrame:
    """Urgency URLs for a table of target words (column ``brand``)."""
    out = _templates(df, "urgency", [
        t for w in C.URGENCY_WORDS for tld in C.SUSPICIOUS_TLDS[:8]
        for t in (f"http://{w}-{{brand}}.{tld}/verify", f"http://{{brand}}-{w}.{tld}/confirm")])
    return _first(out, cap, 16)


def crypto(df: DataFrame, cap: int | None = None) -> DataFrame:
    """Coin and airdrop URLs for a table of coin names (column ``brand``)."""
    out = _templates(df, "crypto", [
        t for p in C.CRYPTO_PATTERNS for tld in C.SUSPICIOUS_TLDS[:6]
        for dom in (p.replace("{coin}", "{brand}"),)
        for t in (f"http://{dom}.{tld}/claim", f"https://{dom}.{tld}/connect")])
    return _first(out, cap, 12)


def free_hosting(df: DataFrame, seed: int = 42) -> DataFrame:
    """Two URLs per name on a seeded free host with a seeded word."""
    return _emit(df, "free_hosting", _hosted(seed))


def free_hosting_sampled(df: DataFrame, n: int = 3, seed: int = 42) -> DataFrame:
    """``{brand}-secure`` on ``n`` seeded free hosts per name."""
    return _emit(df, "free_hosting_sampled", _hosted_sample(n, seed))


#: Families that need a TLD: scheme and TLD list. Fixed values.
ASSEMBLY = {
    "swap": ("http", C.TRUSTED_TLDS + C.SUSPICIOUS_TLDS),
    "omission": ("http", C.TRUSTED_TLDS + C.SUSPICIOUS_TLDS),
    "duplication": ("http", C.TRUSTED_TLDS + C.SUSPICIOUS_TLDS),
    "leet": ("http", C.TRUSTED_TLDS + C.SUSPICIOUS_TLDS),
    "bitsquat": ("http", C.TRUSTED_TLDS + C.SUSPICIOUS_TLDS),
    "char": ("http", C.TRUSTED_TLDS + C.SUSPICIOUS_TLDS),
    "homograph": ("http", C.TRUSTED_TLDS),
    "combo": ("https", C.TRUSTED_TLDS),
    "hyphenated": ("https", C.TRUSTED_TLDS),
    "affix": ("https", C.TRUSTED_TLDS),
}
#: Usual rows per name and family, for callers that want them. Fixed values.
FAMILY_CAPS = {"swap": 5, "omission": 5, "duplication": 3, "leet": 5, "homograph": 3,
               "bitsquat": 3, "combo": 8, "subdomain_abuse": 4, "path": 5}


def assemble(df: DataFrame, seed: int = 42) -> DataFrame:
    """Variants to labelled URLs; the TLD is a seeded pick per variant."""
    key = F.concat_ws("|", "brand", "family", F.col("pos").cast("string"), F.lit(str(seed)))
    url = F.when(F.col("variant").startswith("http"), F.col("variant")).when(
        F.col("family") == "subdomain", F.concat(F.lit("https://"), "variant", F.lit(".com"))
    ).otherwise(F.concat(F.lit("http://"), F.col("variant")))
    for family, (scheme, tlds) in ASSEMBLY.items():
        url = F.when(F.col("family") == family, F.concat(
            F.lit(f"{scheme}://"), F.col("variant"), F.lit("."), S.pick(tlds, key))).otherwise(url)
    return df.withColumns({"url": url, "label": F.lit(1)})


def all_families(df: DataFrame, caps: dict[str, int] | None = None) -> DataFrame:
    """Every per-name family in one narrow pass, cut to ``caps`` rows a name where given."""
    from .corpus import cap_per_group

    every = of_families(df, list(FAMILIES))
    return every if caps is None else cap_per_group(every, caps)


def generated_corpus(df: DataFrame, seed: int = 42) -> DataFrame:
    """Labelled phishing URLs of all families: those of the names, and urgency and coin URLs of the fixed word lists."""
    from .corpus import union_corpora

    def listed(words: Sequence[str]) -> DataFrame:
        return df.sparkSession.createDataFrame([(w,) for w in words], "brand string")

    return assemble(union_corpora(all_families(df.select("brand")), urgency(listed(C.URGENCY_TARGETS)),
                                  crypto(listed(C.CRYPTO_COINS))), seed)


def legit_variations(df: DataFrame, n: int = 2, seed: int = 42) -> DataFrame:
    """Legitimate URLs per ``domain``: bare, n paths, sub-domain, sub-domain with path."""
    d = F.col("domain")

    def key(tag: Column) -> Column:
        return F.concat(d, F.lit("|"), tag, F.lit(f"|{seed}"))

    def path(tag: Column) -> Column:
        return S.pick(C.LEGIT_PATHS, key(tag))

    sub = S.pick(C.LEGIT_SUBDOMAINS, key(F.lit("sub")))
    urls = F.concat(
        F.array(F.concat(F.lit("https://"), d)),
        F.transform(F.sequence(F.lit(1), F.lit(n)),
                    lambda i: F.concat(F.lit("https://"), d, path(F.concat(F.lit("p"), i.cast("string"))))),
        F.array(F.concat(F.lit("https://"), sub, F.lit("."), d),
                F.concat(F.lit("https://"), sub, F.lit("."), d, path(F.lit("subpath")))))
    return df.select("domain", F.posexplode(urls).alias("_p", "url")).select(
        "domain", (F.col("_p") + 1).alias("pos"), "url", F.lit(0).alias("label"))


def detect_squats(observed: DataFrame, names: DataFrame, domain: str = "domain_base") -> DataFrame:
    """Observed domains that equal a generated variant of a protected name.

    An equi-join of variants with distinct observed domains instead of an
    edit-distance loop, so it scales with the size of the brand table as well.
    Names that are themselves protected are not reported as variants.
    """
    from .joins import membership

    variants = of_families(names, ("swap", "omission", "duplication", "leet", "homograph", "bitsquat", "combo"))
    variants = variants.select("brand", "family", "variant").distinct()
    variants = membership(variants, names.select(F.col("brand").alias("variant")), "variant",
                          "left_anti")
    seen = observed.groupBy(F.col(domain).alias("variant")).agg(F.count(F.lit(1)).alias("n_urls"))
    return seen.join(variants, "variant")
