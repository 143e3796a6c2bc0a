"""Impersonation rules as column expressions over ``host_columns`` output.

Each rule has a weight and a reason; ``add_rule_score`` sums the weights (at
most 1) and joins the reasons.  A host label holds no dot, so at most one
prefix word and one suffix word can apply to it; that gives the affix rule a
closed form without a loop over words.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import brands as B
from ..functions import constants as C
from ..functions import strings as S


@dataclass(frozen=True)
class RuleSet:
    """Word lists and texts in which the two rule variants differ."""

    hyphen_words: tuple[str, ...]
    affix_words: tuple[str, ...]
    near_text: str
    browser: bool


SERVER_RULES = RuleSet(C.COMBO_WORDS[:15], C.COMBO_WORDS[:12], "edit(s) from brand", False)
BROWSER_RULES = RuleSet(C.COMBO_WORDS[:20], C.COMBO_WORDS[:20], "edit(s) away from brand", True)


def near_brand(dom: Column) -> Column:
    """Index of the first brand 1..2 edits away from ``dom`` (NULL if none)."""
    return B.first_near(dom)


def hyphen_hit(dom: Column, near_fired: Column, words) -> Column:
    """Brand and combination word joined by the only hyphen of ``dom``.

    The second part is looked at only while no earlier rule has fired.
    """
    first, second = F.substring_index(dom, "-", 1), F.substring_index(dom, "-", -1)

    def wordy(x: Column) -> Column:
        return x.rlike(S.any_of(words)) | S.near_any(x, words, 1)

    first_is_brand = S.in_list("substring_index(dom, '-', 1)", C.BRANDS)
    via_first = ((first_is_brand & wordy(second))
                 | (wordy(first) & B.other_brand_near([first], first, C.BRANDS)))
    via_second = ((first_is_brand & (F.levenshtein(second, first, 1) >= 0) & wordy(second))
                  | (wordy(first) & B.other_brand_near([second], first, C.BRANDS)))
    return (S.count_of(dom, "-") == 1) & (via_first | (~near_fired & via_second))


def affix_words(dom: Column, words) -> tuple[Column, Column]:
    """(prefix word, suffix word) that fire, NULL where none does."""
    head = F.when(dom.contains("-"), F.substring_index(dom, "-", 1))
    tail = F.when(dom.contains("-"), F.substring_index(dom, "-", -1))
    after = F.substr(dom, F.length(head) + 2)
    before = F.substr(dom, F.lit(1), F.length(dom) - F.length(tail) - 1)
    return (F.when(head.isin(*words) & B.brandish(after), head),
            F.when(tail.isin(*words) & B.brandish(before), tail))


def browser_label(dom: Column, host: Column) -> Column:
    """The browser variant falls back to the first label when ``dom`` is empty."""
    return F.when(dom == "", F.substring_index(host, ".", 1)).otherwise(dom)


def add_rule_columns(df: DataFrame, rules: RuleSet = SERVER_RULES) -> DataFrame:
    """Add one column per rule outcome (``rule_*``) to ``host_columns`` output."""
    c = F.col
    label = browser_label(c("rule_domain"), c("host")) if rules.browser else c("rule_domain")
    out = df.withColumn("dom", label)
    out = out.withColumn("rule_near_idx", near_brand(c("dom")))
    prefix, suffix = affix_words(c("dom"), rules.affix_words)
    out = out.withColumns({
        # the guard is needed: an ANSI element_at does not propagate a NULL index
        "rule_near_brand": F.when(c("rule_near_idx").isNotNull(), F.element_at(
            S.str_array(C.BRANDS), c("rule_near_idx"))),
        "rule_hyphen": F.coalesce(
            hyphen_hit(c("dom"), c("rule_near_idx").isNotNull(), rules.hyphen_words), F.lit(False)),
        "rule_prefix": prefix,
        "rule_suffix": suffix,
        "rule_ip": c("is_ip"),
    })
    out = out.withColumn("rule_near_dist", F.levenshtein("dom", "rule_near_brand"))
    if rules.browser:
        free = F.lit(False)
        for fh in C.BROWSER_FREE_HOSTS:
            free = free | c("host").endswith(fh)
        out = out.withColumns({
            "rule_short": (F.length("dom") < 12)
            & ~c("host").contains("google.com") & ~c("host").contains("github.com")
            & (B.contains_brand(c("dom")) | S.near_any(c("dom"), C.BRANDS, 2)),
            "rule_free_host": free & (B.contains_brand(c("dom"))
                                      | B.contains_brand(F.lower("path"))),
            "rule_data_uri": c("u").startswith("data:"),
        })
    return out


def score_and_reason(rules: RuleSet = SERVER_RULES) -> tuple[Column, Column]:
    """Score and reason expressions over ``add_rule_columns`` output."""
    c = F.col

    def weight(cond: Column, w: float) -> Column:
        return F.when(cond, F.lit(w)).otherwise(F.lit(0.0))

    score = (weight(c("rule_near_idx").isNotNull(), 0.6) + weight(c("rule_hyphen"), 0.7)
             + weight(c("rule_prefix").isNotNull(), 0.6)
             + weight(c("rule_suffix").isNotNull(), 0.6))
    quote = lambda col: F.concat(F.lit("'"), col, F.lit("'"))
    near = F.when(c("rule_near_idx").isNotNull(), F.concat(
        F.lit("Domain "), quote(c("dom")), F.lit(" is "), c("rule_near_dist").cast("string"),
        F.lit(f" {rules.near_text} "), quote(c("rule_near_brand"))))
    hyphen = F.when(c("rule_hyphen"), F.concat(
        F.lit("Hyphenated brand impersonation: "), quote(c("dom"))))
    pre = F.when(c("rule_prefix").isNotNull(), F.concat(
        F.lit("Suspicious prefix "), quote(c("rule_prefix")), F.lit(" with brand in "),
        quote(c("dom"))))
    suf = F.when(c("rule_suffix").isNotNull(), F.concat(
        F.lit("Suspicious suffix '-"), c("rule_suffix"), F.lit("' with brand in "),
        quote(c("dom"))))
    # Reasons follow word order; for the same word the prefix comes first.
    pos = lambda col: F.array_position(S.str_array(rules.affix_words), col)
    swap = F.coalesce(pos(c("rule_suffix")) < pos(c("rule_prefix")), F.lit(False))
    reasons = [near, hyphen, F.when(swap, suf).otherwise(pre), F.when(swap, pre).otherwise(suf)]
    if rules.browser:
        score = score + weight(c("rule_short"), 0.4)
        reasons.append(F.when(c("rule_short"), F.concat(
            F.lit("Short domain "), quote(c("dom")), F.lit(" contains brand pattern"))))
    score = score + weight(c("rule_ip"), 0.5)
    reasons.append(F.when(c("rule_ip"), F.lit("IP address used as hostname")))
    if rules.browser:
        score = score + weight(c("rule_free_host"), 0.5) + weight(c("rule_data_uri"), 0.8)
        reasons.append(F.when(c("rule_free_host"), F.concat(
            F.lit("Free hosting "), quote(c("host")), F.lit(" with brand reference"))))
        reasons.append(F.when(c("rule_data_uri"), F.lit("Data URI detected (potential XSS)")))
    text = F.concat_ws("; ", *reasons)
    bad = c("is_malformed")
    return (F.when(bad, F.lit(0.3)).otherwise(F.least(F.lit(1.0), score)),
            F.when(bad, F.lit("Malformed URL")).when(text == "", F.lit("No rule triggered"))
            .otherwise(text))


def add_rule_score(df: DataFrame, rules: RuleSet = SERVER_RULES) -> DataFrame:
    """Add ``rule_score`` and ``rule_reason`` to ``host_columns`` output."""
    keep = df.columns
    score, reason = score_and_reason(rules)
    return add_rule_columns(df, rules).select(
        *keep, score.alias("rule_score"), reason.alias("rule_reason"))
