"""Check SQL: the same results written a second time, for DuckDB.

The sub-queries follow the definitions literally (loops over word lists, one
URL regex), while the library uses closed forms, so agreement says something.
"""

from __future__ import annotations

from ..functions import constants as C
from .corpora import duck_corpora

URL_REGEX = (r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$")
PARAM_SCHEMES = ("", "ftp", "hdl", "prospero", "http", "imap", "https", "shttp", "rtsp", "rtsps",
                 "rtspu", "sip", "sips", "mms", "sftp", "tel")


def lst(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def tup(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


BR = lst(C.BRANDS)


def ascii_(s: str) -> str:
    """DuckDB's levenshtein counts bytes; brands are ASCII, so distances are kept."""
    return f"regexp_replace({s}, '[^\\x00-\\x7F]', '~', 'g')"


def lev(a: str, b: str) -> str:
    return f"levenshtein({a}, {b})"


def both(cond: str, costly: str) -> str:
    """``cond AND costly`` with the second part evaluated only where needed."""
    return f"(CASE WHEN {cond} THEN {costly} ELSE false END)"


def any_(values: str, var: str, cond: str) -> str:
    return f"(len(list_filter({values}, lambda {var}: {cond})) > 0)"


def chars(s: str) -> str:
    return f"regexp_extract_all({s}, '(?s).')"


def n_distinct(s: str) -> str:
    return f"len(list_distinct({chars(s)}))"


def entropy(s: str, v: str = "") -> str:
    p = f"(len(list_filter({chars(s)}, lambda y: y = x)) / length({s})::DOUBLE)"
    return (f"coalesce(list_sum(list_transform(list_distinct({chars(s)}), "
            f"lambda x: -{p} * log2({p}))), 0.0)::DOUBLE")


def count_re(s: str, pattern: str) -> str:
    return f"len(regexp_extract_all({s}, '{pattern}'))"


def longest(s: str, pattern: str) -> str:
    return (f"coalesce(list_max(list_transform(regexp_extract_all({s}, '{pattern}'), "
            f"lambda x: length(x))), 0)")


def count_char(s: str, ch: str) -> str:
    return f"(length({s}) - length(replace({s}, '{ch}', '')))"


def flag(cond: str) -> str:
    return f"(CASE WHEN {cond} THEN 1.0 ELSE 0.0 END)"


def per(num: str, s: str) -> str:
    return f"(({num})::DOUBLE / greatest(length({s}), 1))"


def suffix_in(host: str, domains) -> str:
    return any_(lst(domains), "wl", f"{host} = wl OR ends_with({host}, '.' || wl)")


_EDGE = r"[\s\x1c-\x1f\x{85}\p{Z}]+"


BRACKETS_SQL = (r"^[^\[]*\[(?:" + C.BRACKETED + r")\]").replace("'", "''")


def parsed(src: str) -> dict[str, str]:
    """Sub-queries turning ``src`` (any columns, ``url``) into parsed rows ``p_<src>``."""
    return {
        f"p1_{src}": (
            f"SELECT *, CASE WHEN contains(u, '://') THEN u ELSE 'http://' || u END AS full_url FROM "
            f"(SELECT *, regexp_replace(url, '^{_EDGE}|{_EDGE}$', '', 'g') AS u FROM {src})"),
        f"p2_{src}": (
            f"SELECT *, translate(full_url, chr(9) || chr(13) || chr(10), '') AS tt FROM p1_{src}"),
        f"p3_{src}": (
            f"SELECT *, lower(regexp_extract(tt, '{URL_REGEX}', 1)) AS scheme, "
            f"regexp_extract(tt, '{URL_REGEX}', 2) AS net0, "
            f"regexp_extract(tt, '{URL_REGEX}', 3) AS path0, "
            f"regexp_extract(tt, '{URL_REGEX}', 4) AS query FROM p2_{src}"),
        f"p4_{src}": (
            f"SELECT *, lower(net0) AS netloc, (url IS NULL OR contains(net0, '[') <> contains(net0, ']') "
            f"OR (contains(net0, '[') AND NOT regexp_matches(net0, '{BRACKETS_SQL}')) "
            f"OR regexp_matches(net0, '[{C.DELIMITER_LIKE}]')) AS is_malformed, "
            f"CASE WHEN scheme IN {tup(PARAM_SCHEMES)} THEN regexp_replace(path0, ';[^/]*$', '') "
            f"ELSE path0 END AS path, split_part(lower(net0), ':', 1) AS host FROM p3_{src}"),
        f"p5_{src}": (
            f"SELECT *, string_split(host, '.') AS labels, "
            f"regexp_full_match(host, '\\p{{Nd}}{{1,3}}(\\.\\p{{Nd}}{{1,3}}){{3}}') AS is_ip FROM p4_{src}"),
        f"p6_{src}": (
            f"SELECT *, CASE WHEN len(labels) > 1 AND NOT is_ip THEN labels[-1] ELSE '' END AS tld, "
            f"CASE WHEN len(labels) > 1 THEN array_to_string(labels[1:len(labels) - 1], '.') "
            f"ELSE host END AS domain_base, "
            f"CASE WHEN len(labels) >= 3 THEN labels[-2] ELSE labels[1] END AS rule_domain FROM p5_{src}"),
        f"p_{src}": (
            f"SELECT *, domain_base || CASE WHEN tld <> '' THEN '.' || tld ELSE '' END AS reg_domain, "
            f"{ascii_('domain_base')} AS da FROM p6_{src}"),
    }


def feature_sql() -> dict[str, str]:
    u, h, p, q, d, nl, tld = "u", "host", "path", "query", "domain_base", "netloc", "tld"
    wl = tup(C.KNOWN_DOMAINS)
    lp, lu = "lower(path)", "lower(u)"
    known = f"(host IN {wl} OR (contains(host, '.') AND NOT is_ip AND reg_domain IN {wl}))"
    segs = "len(list_filter(string_split(path, '/'), lambda s: s <> ''))"
    words = "list_filter(regexp_split_to_array(domain_base, '[^a-zA-Z]'), lambda w: length(w) >= 2)"
    longest_word = f"coalesce(list_max(list_transform({words}, lambda w: length(w))), 0)"
    vowels = count_re(d, "[aeiou]")
    bare = "replace(path, '/', '')"
    port = "list_extract(string_split(netloc, ':'), -1)"
    has_port = "contains(netloc, ':')"
    portnum = f"{has_port} AND regexp_full_match({port}, '\\p{{Nd}}+')"
    brand_in = any_(BR, "b", f"contains({d}, b)")
    match = f"contains({d}, b) AND length({d}) - length(b) <= 1"
    nodig = f"regexp_replace({d}, '\\p{{Nd}}', '', 'g')"
    near_at = (f"coalesce(nullif(list_position(list_transform({BR}, lambda b: {lev('da', 'b')} BETWEEN 1 AND 2),"
               f" true), 0), 9999)")
    match_at = f"coalesce(nullif(list_position(list_transform({BR}, lambda b: {match}), true), 0), 9999)"
    nodig_a = "regexp_replace(da, '[0-9]', '', 'g')"
    p0, p1 = "split_part(da, '-', 1)", "split_part(da, '-', 2)"

    def hyph(part: str) -> str:
        words_hit = any_(lst(C.COMBO_WORDS), "w", f"contains({p0}, w)")
        return any_(BR, "b", both(f"{part} = b OR {lev(part, 'b')} <= 1",
                                  f"(CASE WHEN {p0} <> b THEN {words_hit} ELSE {p1} <> '' END)"))

    def affix(words_, starts: bool) -> str:
        if starts:
            cond = f"starts_with({d}, w || '-') OR starts_with({d}, w || '.')"
            rest = "substr(da, length(w) + 2)"
        else:
            cond = f"ends_with({d}, '-' || w) OR ends_with({d}, '.' || w)"
            rest = "substr(da, 1, length(da) - length(w) - 1)"
        inner = any_(BR, "b", f"contains({rest}, b) OR {lev(rest, 'b')} <= 1")
        return any_(lst(words_), "w", both(cond, inner))

    e = {
        "url_length": "length(u)", "hostname_length": "length(host)", "path_length": "length(path)",
        "num_dots": count_char(u, "."), "num_hyphens": count_char(u, "-"),
        "num_underscores": count_char(u, "_"), "num_slashes": count_char(u, "/"),
        "num_question": count_char(u, "?"), "num_equal": count_char(u, "="),
        "num_at": count_char(u, "@"), "num_percent": count_char(u, "%"),
        "num_digits": count_re(u, "\\p{Nd}"),
        "num_subdomains": "greatest(len(labels) - 2, 0)",
        "has_ip_host": flag("is_ip"), "has_https": flag("scheme = 'https'"),
        "has_port": flag(has_port),
        "suspicious_keyword_count":
            f"len(list_filter({lst(C.SUSPICIOUS_KEYWORDS)}, lambda k: contains({lu}, k)))",
        "has_suspicious_tld": flag(f"tld IN {tup(C.SUSPICIOUS_TLDS)}"),
        "domain_entropy": entropy(d),
        "url_shortener": flag(f"host IN {tup(C.SHORTENERS)}"),
        "digit_ratio": per(count_re(u, "\\p{Nd}"), u),
        "hex_encoded_count": count_re(u, "%[0-9a-fA-F]{2}"),
        "max_consecutive_special": longest(u, "[^\\p{L}\\p{N}]+"),
        "brand_in_domain": flag(brand_in),
        "brand_domain_match": flag(any_(BR, "b", match)),
        "has_port_number": flag(f"{portnum} AND {port} NOT IN ('80', '443')"),
        "has_single_char_subdomain": flag(
            "len(labels) > 2 AND len(list_filter(labels[1:len(labels) - 2], lambda x: length(x) = 1)) > 0"),
        "path_depth": segs, "query_length": "length(query)",
        "has_encoded_chars": flag(f"contains(u, '%') OR contains({lu}, '&amp;')"),
        "domain_digit_count": count_re(d, "\\p{Nd}"),
        "hostname_hyphen_count": count_char(h, "-"),
        "tld_trust_score": f"CASE WHEN tld = '' THEN 0.0 WHEN tld IN {tup(C.TRUSTED_TLDS)} THEN 1.0 "
                           f"WHEN tld IN {tup(C.SUSPICIOUS_TLDS)} THEN 0.0 ELSE 0.5 END",
        "is_free_hosting": flag(suffix_in(h, C.FREE_HOSTING)),
        "domain_has_digit_insert": flag(
            both(f"regexp_matches({d}, '\\p{{Nd}}') AND length({nodig}) >= 3",
                 any_(BR, "b", f"{lev(nodig_a, 'b')} <= 2"))),
        "registered_domain_length": "length(reg_domain)",
        "vowel_ratio": per(vowels, d),
        "char_repetition_ratio": f"1.0 - {per(n_distinct(d), d)}",
        "has_admin_path": flag(any_(lst(C.ADMIN_PATHS), "x", f"contains({lp}, x)")),
        "has_suspicious_path": flag(any_(lst(C.SUSPICIOUS_PATHS), "x", f"contains({lp}, x)")),
        "brand_in_path": flag(f"{brand_in} AND " + any_(BR, "b", f"contains({lp}, b)")),
        "randomness_score": per(n_distinct(f"({d} || {bare})"), f"({d} || {bare})"),
        "host_to_url_ratio": per("length(host)", u), "path_to_url_ratio": per("length(path)", u),
        "num_query_params": "CASE WHEN query = '' THEN 0 ELSE len(string_split(query, '&')) END",
        "has_fragment": flag("contains(u, '#')"),
        "max_domain_word_length": longest_word, "num_domain_words": f"len({words})",
        "tld_length": "length(tld)", "path_has_numbers": count_re(p, "\\p{Nd}"),
        "has_double_slash_path": flag("contains(path, '//')"),
        "path_entropy": entropy(bare),
        "domain_vowel_consonant_ratio": f"({vowels})::DOUBLE / greatest(length({d}) - {vowels}, 1)",
        "num_special_in_path": count_re(p, "[^\\p{L}\\p{N}/.]"),
        "has_long_query": flag("length(query) > 100"),
        "is_known_legitimate": flag(known),
        "domain_name_in_whitelist": flag(f"NOT {known} AND {suffix_in(h, C.KNOWN_DOMAINS)}"),
        "brand_near_match": flag(f"length({d}) >= 3 AND {near_at} < 9999 AND {near_at} < {match_at}"),
        "brand_hyphenated_domain": flag(
            both(f"len(string_split({d}, '-')) = 2", f"({hyph(p0)} OR {hyph(p1)})")),
        "suspicious_prefix_suffix": flag(
            f"{affix(C.SUSPICIOUS_PREFIXES, True)} OR {affix(C.SUSPICIOUS_SUFFIXES, False)}"),
        "has_non_ascii_chars": flag(f"regexp_matches({d}, '[^\\x00-\\x7F]')"),
        "short_unknown_domain": flag(
            f"length({d}) < 12 AND host NOT IN {tup(C.SHORTENERS)} AND NOT {known} AND NOT is_ip AND "
            f"({per(vowels, d)} < 0.3::DOUBLE OR {entropy(d)} > 3.0)"),
        "domain_consonant_cluster_ratio": per(longest(d, "[^aeiou\\P{L}]+"), d),
        "url_encoding_density": per(count_re(u, "%[0-9a-fA-F]{2}"), u),
        "domain_starts_with_digit": flag(f"regexp_matches({d}, '^\\p{{Nd}}')"),
        "domain_ends_with_digit": flag(f"regexp_matches({d}, '\\p{{Nd}}$')"),
        "path_has_file_extension": flag(f"regexp_matches({p}, '\\.[a-zA-Z]{{2,5}}$')"),
        "has_suspicious_file_ext": flag(any_(lst(C.SUSPICIOUS_EXTENSIONS), "x", f"ends_with({lp}, x)")),
        "domain_has_repeated_chars": flag(f"length({d}) <> {n_distinct(d)}"),
        "domain_avg_word_length": longest_word,
        "path_to_domain_ratio": per("length(path)", d),
        "has_double_scheme": flag(f"contains({lu}, 'httphttp') OR contains({lu}, 'httpshttps')"),
        "brand_min_levenshtein": f"CASE WHEN {d} = '' THEN 10 ELSE least(10, list_min("
                                 f"list_transform({BR}, lambda b: {lev('da', 'b')}))) END",
        "domain_digit_ratio": per(count_re(d, "\\p{Nd}"), d),
        "path_segment_count": segs, "query_has_encoded": flag("contains(query, '%')"),
        "has_suspicious_port": flag(
            f"{portnum} AND ltrim({port}, '0') NOT IN ('80', '443', '8080', '8443')"),
    }
    return {n: f"round(({e[n]})::DOUBLE, 6)" for n in C.FEATURE_NAMES}


FEATURE_SQL = feature_sql()
RAW_FEATURE_SQL = {n: s[len("round("):-len(", 6)")] for n, s in FEATURE_SQL.items()}


def features(src: str, names) -> str:
    return ", ".join(f"{FEATURE_SQL[n]} AS {n}" for n in names)


HEURISTIC = ("url_length", "has_ip_host", "has_https", "suspicious_keyword_count", "has_suspicious_tld",
             "brand_in_domain", "brand_domain_match", "tld_trust_score", "is_free_hosting",
             "is_known_legitimate")
POSITIONAL = tuple(C.FEATURE_NAMES[i] for i in (0, 13, 14, 16, 17, 23, 24, 31, 32, 56))


def heuristic(names) -> str:
    f = [f"f{i}" for i in range(10)]
    return (f"CASE WHEN {f[9]} > 0 THEN 0.05e0 ELSE greatest(0e0, least(1e0, 0.5e0 "
            f"+ CASE WHEN {f[1]} > 0 THEN 0.3e0 ELSE 0e0 END + CASE WHEN {f[2]} = 0 THEN 0.05e0 ELSE 0e0 END "
            f"+ least({f[3]} * 0.05e0, 0.2e0) + CASE WHEN {f[4]} > 0 THEN 0.15e0 ELSE 0e0 END "
            f"+ CASE WHEN {f[6]} > 0 THEN 0.25e0 WHEN {f[5]} > 0 THEN 0.1e0 ELSE 0e0 END "
            f"+ CASE WHEN {f[7]} < 0.5e0 THEN 0.1e0 ELSE 0e0 END + CASE WHEN {f[8]} > 0 THEN 0.1e0 ELSE 0e0 END "
            f"+ CASE WHEN {f[0]} > 75 THEN 0.05e0 ELSE 0e0 END "
            f"+ CASE WHEN {f[0]} > 150 THEN 0.1e0 ELSE 0e0 END)) END")


def lex_scores(src: str, names=HEURISTIC, tag: str = "lex") -> dict[str, str]:
    cols = ", ".join(f"{RAW_FEATURE_SQL[n]} AS f{i}" for i, n in enumerate(names))
    return {f"{tag}_{src}": f"SELECT *, {heuristic(names)} AS lex_prob FROM (SELECT *, {cols} FROM p_{src})"}


def rules(src: str, base: str | None = None, browser: bool = False) -> dict[str, str]:
    """``r_<src>`` / ``rb_<src>``: rule columns, score and reason over ``base``."""
    base = base or f"p_{src}"
    tag = "rb" if browser else "r"
    hy_words = C.COMBO_WORDS[:20] if browser else C.COMBO_WORDS[:15]
    af_words = C.COMBO_WORDS[:20] if browser else C.COMBO_WORDS[:12]
    text = "edit(s) away from brand" if browser else "edit(s) from brand"
    dom = ("CASE WHEN rule_domain = '' THEN labels[1] ELSE rule_domain END" if browser else "rule_domain")
    p0, p1 = "split_part(dom_a, '-', 1)", "split_part(dom_a, '-', 2)"

    def hit(part: str) -> str:
        other = f"(CASE WHEN {p0} = b THEN {p1} ELSE {p0} END)"
        wordy = any_(lst(hy_words), "w", f"contains({other}, w) OR {lev(other, 'w')} <= 1")
        return any_(BR, "b", both(f"{part} = b OR {lev(part, 'b')} <= 1", wordy))

    rest_a, rest_b = "substr(dom_a, length(w) + 2)", "substr(dom_a, 1, length(dom_a) - length(w) - 1)"
    pre = (f"list_filter({lst(af_words)}, lambda w: " + both(
        "starts_with(dom, w || '-')", any_(BR, "b", f"contains({rest_a}, b) OR {lev(rest_a, 'b')} <= 1")) + ")")
    suf = (f"list_filter({lst(af_words)}, lambda w: " + both(
        "ends_with(dom, '-' || w)", any_(BR, "b", f"contains({rest_b}, b) OR {lev(rest_b, 'b')} <= 1")) + ")")
    out = {
        f"{tag}1_{src}": (
            f"SELECT *, CASE WHEN length(dom) >= 3 THEN nullif(list_position(list_transform({BR}, "
            f"lambda b: {lev('dom_a', 'b')} BETWEEN 1 AND 2), true), 0) END AS near_idx "
            f"FROM (SELECT *, {dom} AS dom, {ascii_(dom)} AS dom_a FROM {base})"),
        f"{tag}2_{src}": (
            f"SELECT *, list_extract({BR}, near_idx::BIGINT) AS near_brand, "
            + both("len(string_split(dom, '-')) = 2", f"({hit(p0)} OR (near_idx IS NULL AND {hit(p1)}))") + " AS hyphen, "
            f"{pre} AS pre, {suf} AS suf, "
            "length(dom) < 12 AND NOT contains(host, 'google.com') AND NOT contains(host, 'github.com') AND "
            + any_(BR, "b", f"contains(dom, b) OR {lev('dom_a', 'b')} <= 2") + " AS short_hit, "
            + any_(lst(C.BROWSER_FREE_HOSTS), "x", "ends_with(host, x)") + " AND "
            + any_(BR, "b", "contains(dom, b) OR contains(lower(path), b)") + " AS free_hit, "
            f"starts_with(u, 'data:') AS data_hit FROM {tag}1_{src}"),
    }
    extra_score = (" + CASE WHEN short_hit THEN 0.4e0 ELSE 0e0 END" if browser else "")
    tail_score = (" + CASE WHEN free_hit THEN 0.5e0 ELSE 0e0 END + CASE WHEN data_hit THEN 0.8e0 ELSE 0e0 END"
                  if browser else "")
    affix = (f"list_filter(flatten(list_transform({lst(af_words)}, lambda w: ["
             "CASE WHEN list_contains(pre, w) THEN 'Suspicious prefix ''' || w || ''' with brand in ''' || dom || '''' END, "
             "CASE WHEN list_contains(suf, w) THEN 'Suspicious suffix ''-' || w || ''' with brand in ''' || dom || '''' END"
             "])), lambda x: x IS NOT NULL)")
    short = "CASE WHEN short_hit THEN 'Short domain ''' || dom || ''' contains brand pattern' END" if browser else "NULL"
    tail = ("CASE WHEN free_hit THEN 'Free hosting ''' || host || ''' with brand reference' END, "
            "CASE WHEN data_hit THEN 'Data URI detected (potential XSS)' END" if browser else "NULL")
    reasons = (
        "list_filter(flatten([[CASE WHEN near_idx IS NOT NULL THEN 'Domain ''' || dom || ''' is ' || "
        f"{lev('dom_a', 'near_brand')} || ' {text} ''' || near_brand || '''' END, "
        "CASE WHEN hyphen THEN 'Hyphenated brand impersonation: ''' || dom || '''' END], "
        f"{affix}, [{short}, CASE WHEN is_ip THEN 'IP address used as hostname' END, {tail}]]), "
        "lambda x: x IS NOT NULL)")
    out[f"{tag}_{src}"] = (
        "SELECT *, CASE WHEN is_malformed THEN 0.3e0 ELSE least(1e0, CASE WHEN near_idx IS NOT NULL THEN 0.6e0 ELSE 0e0 END "
        "+ CASE WHEN hyphen THEN 0.7e0 ELSE 0e0 END + len(pre) * 0.6e0 + len(suf) * 0.6e0"
        f"{extra_score} + CASE WHEN is_ip THEN 0.5e0 ELSE 0e0 END{tail_score}) END AS rule_score, "
        "CASE WHEN is_malformed THEN 'Malformed URL' ELSE coalesce(nullif(array_to_string("
        f"{reasons}, '; '), ''), 'No rule triggered') END AS rule_reason FROM {tag}2_{src}")
    return out


CFG = {"w_lexical": "0.5e0", "w_vision": "0.5e0", "fast_path_safe": "0.15e0",
       "fast_path_malicious": "0.85e0", "vision_trigger_lo": "0.15e0", "vision_trigger_hi": "0.85e0",
       "safe_threshold": "0.33e0", "phishing_threshold": "0.66e0"}


def verdict_of(risk: str, cfg: dict[str, str] = CFG) -> str:
    return (f"CASE WHEN {risk} <= {cfg['safe_threshold']} THEN 'Safe' "
            f"WHEN {risk} >= {cfg['phishing_threshold']} THEN 'Phishing' ELSE 'Suspicious' END")


def verdicts(src: str, browser: bool = False, out: str | None = None, cfg: dict[str, str] = CFG,
             vision: bool = False) -> dict[str, str]:
    """``v_<src>``: the cascade over ``lex_<src>``; with ``vision`` a table ``s2`` is joined."""
    tag = "vb" if browser else "v"
    rtag = "rb" if browser else "r"
    out = out or f"{tag}_{src}"
    fast = (f"CASE WHEN comb <= {cfg['fast_path_safe']} THEN 'Safe' "
            f"WHEN comb >= {cfg['fast_path_malicious']} THEN 'Phishing' END")
    last = "threshold" if browser else "fused"
    wsum = f"CASE WHEN {cfg['w_lexical']} + {cfg['w_vision']} <= 0 THEN 1e0 ELSE {cfg['w_lexical']} + {cfg['w_vision']} END"
    fused = "comb" if browser else f"({cfg['w_lexical']} * comb + {cfg['w_vision']} * vis) / ({wsum})"
    if vision:
        vis = ("CASE WHEN routed AND coalesce(ok AND prob IS NOT NULL, false) THEN prob ELSE 0.5e0 END AS vis, "
               "routed AND coalesce(ok AND prob IS NOT NULL, false) AS vis_used")
        join = f" LEFT JOIN s2 ON s2.s2_url = c.url"
    else:
        vis, join = "0.5e0 AS vis, false AS vis_used", ""
    vis_cols = ", s2.prob AS prob, s2.ok AS ok, s2.error AS error, s2.screenshot AS shot" if vision else ""
    return {
        f"{out}_a": (
            f"SELECT c.*, greatest(lex_prob, rule_score * 0.8e0) AS comb, "
            f"NOT is_malformed AND {suffix_in('host', C.KNOWN_DOMAINS)} AS is_wl{vis_cols} "
            f"FROM {rtag}_{src} c{join}"),
        f"{out}_b": (
            f"SELECT *, CASE WHEN is_malformed THEN 'error' WHEN is_wl THEN 'whitelist' "
            f"WHEN rule_score >= 0.5e0 THEN 'rule' WHEN ({fast}) IS NOT NULL THEN 'fast_path' "
            f"ELSE '{last}' END AS stage, {fast} AS fast, "
            f"({fast}) IS NULL AND comb BETWEEN {cfg['vision_trigger_lo']} AND {cfg['vision_trigger_hi']} AS routed "
            f"FROM {out}_a"),
        f"{out}_c": f"SELECT *, {vis} FROM {out}_b",
        f"{out}_d": (
            f"SELECT *, CASE WHEN stage IN ('error', 'whitelist') THEN 0e0 WHEN stage = 'rule' THEN rule_score "
            f"WHEN stage = 'fast_path' THEN comb ELSE {fused} END AS risk FROM {out}_c"),
        out: (
            f"SELECT *, CASE stage WHEN 'error' THEN 'Error' WHEN 'whitelist' THEN 'Safe' "
            f"WHEN 'rule' THEN 'Phishing' WHEN 'fast_path' THEN fast ELSE {verdict_of('risk', cfg)} END AS verdict, "
            f"stage IN ('whitelist', 'rule', 'fast_path') AS fast_path FROM {out}_d"),
    }


def notes_text(browser: bool = False, vision: bool = False) -> str:
    """The notes of a verdict row, joined with `` | ``."""
    if browser:
        full = ("array_to_string(list_filter(['ML probability: ' || printf('%.3f', lex_prob), "
                "CASE WHEN rule_score > 0 THEN 'Rule score: ' || printf('%.2f', rule_score) || ' - ' || rule_reason END, "
                "'Combined risk: ' || printf('%.3f', risk) || ' -> ' || verdict], lambda x: x IS NOT NULL), ' | ')")
        tail = " fast-path."
    else:
        full = ("'ML prob=' || printf('%.3f', lex_prob) || ', rule score=' || printf('%.2f', rule_score) || "
                "', fused risk=' || printf('%.3f', risk) || ' -> ' || verdict || '.'")
        if vision:
            full = ("CASE WHEN routed AND NOT vis_used THEN CASE WHEN coalesce(ok, false) THEN "
                    "'Vision model unavailable -> neutral vision score.' ELSE 'Capture failed: ' || "
                    f"coalesce(error, 'no capture') END || ' | ' ELSE '' END || {full}")
        tail = " fast-path (no capture)."
    return ("CASE stage WHEN 'error' THEN 'Malformed URL' "
            "WHEN 'whitelist' THEN 'Domain is in known legitimate whitelist -> Safe.' "
            "WHEN 'rule' THEN 'Rule-based detection: ' || rule_reason "
            f"WHEN 'fast_path' THEN 'Combined score confident -> ' || verdict || '{tail}' ELSE {full} END")


def score_text(browser: bool = False) -> str:
    """Stage scores as ``name:prob:used`` joined with `` | ``."""
    lexi = "'Lexical:' || printf('%.6f', lex_prob) || ':true'"
    both = lexi if browser else (
        f"{lexi} || ' | Vision:' || printf('%.6f', vis) || ':' || vis_used::VARCHAR")
    return (f"CASE WHEN stage IN ('error', 'whitelist', 'rule') THEN '' "
            f"WHEN stage = 'fast_path' THEN {lexi} ELSE {both} END")


def sql(body: str, *parts: dict[str, str], corpora: bool = True) -> str:
    """``body`` with the named sub-queries it needs in front, in order."""
    ctes: dict[str, str] = dict(duck_corpora()) if corpora else {}
    for p in parts:
        ctes.update(p)
    # keep only what the body reaches
    needed: set[str] = set()
    todo = [body]
    while todo:
        text = todo.pop()
        for name, q in ctes.items():
            if name not in needed and _mentions(text, name):
                needed.add(name)
                todo.append(q)
    kept = [f"{n} AS ({q})" for n, q in ctes.items() if n in needed]
    return ("WITH " + ", ".join(kept) + " " if kept else "") + body


def _mentions(text: str, name: str) -> bool:
    return f" {name} " in f" {text} ".replace(")", " ").replace(",", " ").replace(".", " ")
