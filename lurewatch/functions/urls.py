"""URL decomposition as column expressions.

``parse_url_columns`` is a narrow map: one small regex (the scheme) plus
substring operations, so it stays in generated code and never shuffles.
Spark's own ``parse_url`` is not used because it drops user info and returns
NULL for hosts that phishing feeds are full of.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import constants as C
from .settle import settle
from .strings import any_of, in_list

#: Unicode white space stripped from both ends.
_EDGE_SPACE = r"^[\s\x1c-\x1f\x85\p{Z}]+|[\s\x1c-\x1f\x85\p{Z}]+$"
#: Schemes whose last path segment may carry ``;params``. Fixed values.
_PARAM_SCHEMES = ("", "ftp", "hdl", "prospero", "http", "imap", "https", "shttp",
                  "rtsp", "rtsps", "rtspu", "sip", "sips", "mms", "sftp", "tel")
IP_PATTERN = r"^\p{Nd}{1,3}(\.\p{Nd}{1,3}){3}$"
#: The first pair of brackets holds an address.
_BRACKETS = rf"^[^\[]*\[(?:{C.BRACKETED})\]"
PARSED_COLUMNS = ("u", "full_url", "scheme", "netloc", "host", "path", "query",
                  "is_malformed")


def strip(url: Column) -> Column:
    return F.regexp_replace(url, _EDGE_SPACE, "")


def normalise(stripped: Column) -> Column:
    """Prefix ``http://`` when no ``://`` occurs anywhere."""
    return F.when(stripped.contains("://"), stripped).otherwise(
        F.concat(F.lit("http://"), stripped))


def parse_url_columns(df: DataFrame, url: str = "url") -> DataFrame:
    """Add ``u, full_url, scheme, netloc, host, path, query, is_malformed``.

    ``netloc`` is lower-cased and keeps user info and port; ``host`` is the part
    of it before the first colon.
    """
    c = F.col
    out = df.withColumn("u", strip(c(url)))
    out = out.withColumn("full_url", normalise(c("u")))
    # Tabs and line breaks are dropped for splitting, kept in ``u``.
    out = out.withColumn("_t", F.substring_index(
        F.translate(c("full_url"), "\t\r\n", ""), "#", 1))
    out = out.withColumn("_b", F.substring_index(c("_t"), "?", 1))
    out = out.withColumn("_s", F.regexp_extract(c("_b"), r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    out = out.withColumn("_r", F.when(c("_s") != "", F.expr(
        "substr(_b, length(_s) + 2)")).otherwise(c("_b")))
    has_net = c("_r").startswith("//")
    out = out.withColumn("_n", F.when(has_net, F.substring_index(
        F.expr("substr(_r, 3)"), "/", 1)).otherwise(F.lit("")))
    raw_path = F.when(has_net, F.expr("substr(_r, length(_n) + 3)")).otherwise(c("_r"))
    out = out.withColumn("scheme", F.lower(c("_s")))
    out = out.withColumns({
        "netloc": F.lower(c("_n")),
        "path": F.when(raw_path.contains(";") & c("scheme").isin(*_PARAM_SCHEMES),
                       F.regexp_replace(raw_path, r";[^/]*$", "")).otherwise(raw_path),
        "query": F.expr("substr(_t, length(_b) + 2)"),
        # Unpaired brackets, brackets that hold no address, look-alikes of delimiters, no URL at all.
        "is_malformed": c(url).isNull() | F.coalesce(
            (c("_n").contains("[") != c("_n").contains("]"))
            | (c("_n").contains("[") & ~c("_n").rlike(_BRACKETS))
            | c("_n").rlike(f"[{C.DELIMITER_LIKE}]"), F.lit(False)),
    })
    out = out.withColumn("host", F.substring_index(c("netloc"), ":", 1))
    return out.drop("_t", "_b", "_s", "_r", "_n")


def is_ip(host: Column) -> Column:
    return host.rlike(IP_PATTERN)


def add_domain_parts(df: DataFrame) -> DataFrame:
    """Add ``is_ip, tld, domain_base, reg_domain, rule_domain`` from ``host``."""
    h = F.col("host")
    dotted = h.contains(".")
    labels = F.split(h, r"\.")
    out = df.withColumn("is_ip", is_ip(h))
    out = out.withColumns({
        "tld": F.when(dotted & ~F.col("is_ip"), F.substring_index(h, ".", -1)).otherwise(F.lit("")),
        # everything before the last label, sub-domains included
        "domain_base": F.when(dotted, F.expr(
            "substr(host, 1, length(host) - length(substring_index(host, '.', -1)) - 1)"))
        .otherwise(h),
        # second-last label from two dots on, else the first label
        "rule_domain": F.when(F.size(labels) >= 3, F.element_at(labels, -2))
        .otherwise(F.element_at(labels, 1)),
    })
    return out.withColumn("reg_domain", F.when(
        F.col("tld") != "", F.concat_ws(".", "domain_base", "tld")).otherwise(F.col("domain_base")))


DOMAIN_COLUMNS = ("is_ip", "tld", "domain_base", "rule_domain", "reg_domain")


def host_columns(df: DataFrame, url: str = "url") -> DataFrame:
    """All parsed and domain columns, computed once per row."""
    return settle(add_domain_parts(parse_url_columns(df, url)), *PARSED_COLUMNS, *DOMAIN_COLUMNS)


def encode_component(text: Column) -> Column:
    """Percent-encode for a query part; ``A-Za-z0-9-_.!~*'()`` stay as they are."""
    out = F.url_encode(text)
    for encoded, plain in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("),
                           ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(encoded), F.lit(plain))
    return out


def slug(url: Column) -> Column:
    """File-system name of a URL: non-alphanumerics to ``_``, 80 characters."""
    return F.substring(F.regexp_replace(url, "[^a-zA-Z0-9]", "_"), 1, 80)


def domain_words(domain_base: Column) -> Column:
    return F.filter(F.split(domain_base, "[^a-zA-Z]"), lambda w: F.length(w) >= 2)


def is_valid_request_url(url: Column) -> Column:
    """Request bounds: 1..2048 characters, not null."""
    return F.coalesce(F.length(url).between(1, 2048), F.lit(False))


def is_internal(url: Column) -> Column:
    """Browser-internal page."""
    return url.rlike("(?i)^(" + any_of(C.INTERNAL_SCHEMES) + ")://")


class Listed:
    """Marks a reputation table that has been joined: its answers are in ``COLUMNS``."""

    COLUMNS = ("_wl_host", "_wl_reg", "_wl_under")


def in_whitelist(name: str, domains) -> Column:
    """``host`` or ``reg_domain`` is itself in the reputation list."""
    if isinstance(domains, Listed):
        return F.col("_wl_host" if name == "host" else "_wl_reg")
    return in_list(name, domains)


def suffix_matches(host: str, domains) -> Column:
    """Column ``host`` equals one of ``domains`` or is a sub-domain of one.

    A domain with k labels can only match the last k labels of the host, so
    the test is one set lookup per distinct label count: no join, no loop over
    the dictionary.
    """
    if isinstance(domains, Listed):
        return F.col("_wl_under")
    by_labels: dict[int, list[str]] = {}
    for d in domains:
        by_labels.setdefault(d.count(".") + 1, []).append(d)
    hit = F.lit(False)
    for k, group in sorted(by_labels.items()):
        hit = hit | in_list(f"substring_index({host}, '.', -{k})", group)
    return hit


def host_suffixes(host: Column) -> Column:
    """All label suffixes of a host, longest first: a.b.c -> [a.b.c, b.c, c]."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.size(labels), F.lit(1), F.lit(-1)),
                       lambda k: F.array_join(F.slice(labels, -k, k), "."))
