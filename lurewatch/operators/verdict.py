"""The decision cascade: white list -> rules -> lexical score -> fused verdict.

With a column scorer the whole cascade is one narrow projection.  With a
``DataFrame -> DataFrame`` scorer (a Spark ML model, say) only rows no earlier
gate has decided are sent through it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import constants as C
from ..functions import urls as U
from ..functions.settle import settle
from .rules import BROWSER_RULES, SERVER_RULES, RuleSet, add_rule_columns, score_and_reason
from .scoring import heuristic_score

STAGE_SCORE_TYPE = "array<struct<name:string,probability:double,used:boolean,detail:string>>"


@dataclass(frozen=True)
class Config:
    """Weights and bounds of the cascade. Fixed default values."""

    w_lexical: float = 0.5
    w_vision: float = 0.5
    fast_path_safe: float = 0.15
    fast_path_malicious: float = 0.85
    vision_trigger_lo: float = 0.15
    vision_trigger_hi: float = 0.85
    safe_threshold: float = 0.33
    phishing_threshold: float = 0.66

    def columns(self) -> dict[str, Column]:
        return {k: F.lit(v) for k, v in asdict(self).items()}


DEFAULT_CONFIG = Config()


def config_columns(prefix: str = "") -> dict[str, Column]:
    """The same bounds taken from columns (configuration sweeps)."""
    return {k: F.col(prefix + k) for k in asdict(DEFAULT_CONFIG)}


def verdict_of(risk: Column, cfg: dict[str, Column]) -> Column:
    return (F.when(risk <= cfg["safe_threshold"], F.lit("Safe"))
            .when(risk >= cfg["phishing_threshold"], F.lit("Phishing"))
            .otherwise(F.lit("Suspicious")))


def combined_risk(lex: Column, rule: Column) -> Column:
    return F.greatest(lex, rule * 0.8)


def fast_path_verdict(combined: Column, cfg: dict[str, Column]) -> Column:
    """Safe / Phishing when the score is extreme, else NULL."""
    return (F.when(combined <= cfg["fast_path_safe"], F.lit("Safe"))
            .when(combined >= cfg["fast_path_malicious"], F.lit("Phishing")))


def needs_stage2(combined: Column, cfg: dict[str, Column]) -> Column:
    return fast_path_verdict(combined, cfg).isNull() & combined.between(
        cfg["vision_trigger_lo"], cfg["vision_trigger_hi"])


def fuse(combined: Column, vision: Column, cfg: dict[str, Column]) -> Column:
    total = cfg["w_lexical"] + cfg["w_vision"]
    return (cfg["w_lexical"] * combined + cfg["w_vision"] * vision) / F.when(
        total <= 0, F.lit(1.0)).otherwise(total)


def add_gates(df: DataFrame, url: str = "url", rules: RuleSet = SERVER_RULES,
              whitelist: Sequence[str] | U.Listed | DataFrame = C.KNOWN_DOMAINS) -> DataFrame:
    """Parsed URL plus ``is_whitelisted, rule_score, rule_reason``."""
    return _gates(df, url, rules, whitelist)[0]


def _gates(df: DataFrame, url: str, rules: RuleSet, whitelist) -> tuple[DataFrame, object]:
    """The gates and the whitelist as expressions can use it."""
    from .joins import with_reputation

    hosts, whitelist = with_reputation(U.host_columns(df, url), whitelist)
    base = hosts.withColumn(
        "is_whitelisted", ~F.col("is_malformed") & U.suffix_matches("host", whitelist))
    keep = base.columns
    score, reason = score_and_reason(rules)
    out = add_rule_columns(base, rules).select(
        *keep, score.alias("rule_score"), reason.alias("rule_reason"))
    return settle(out, "is_whitelisted", "rule_score", "rule_reason"), whitelist


def _fmt(col: Column, digits: int) -> Column:
    # format_number rounds the binary value; format_string rounds its decimal text.
    return F.format_number(col, digits)


def _decide(df: DataFrame, keep: list[str], cfg: dict[str, Column], stage2: bool,
            run_vision: bool) -> DataFrame:
    """Turn gates, ``lex_prob`` and (optionally) ``vis_*`` columns into verdict rows."""
    c = F.col
    out = settle(df.withColumn("_combined", combined_risk(c("lex_prob"), c("rule_score"))),
                 "lex_prob", "_combined")
    fast = fast_path_verdict(c("_combined"), cfg)
    stage = (F.when(c("is_malformed"), F.lit("error"))
             .when(c("is_whitelisted"), F.lit("whitelist"))
             .when(c("rule_score") >= 0.5, F.lit("rule"))
             .when(fast.isNotNull(), F.lit("fast_path"))
             .otherwise(F.lit("fused" if stage2 else "threshold")))
    out = out.withColumn("stage", stage)
    if stage2:
        routed = needs_stage2(c("_combined"), cfg) & F.lit(run_vision)
        have = c("vis_prob") if run_vision else F.lit(0.5)
        out = out.withColumns({
            "_routed": routed,
            "_vis": F.when(routed, F.coalesce(have, F.lit(0.5))).otherwise(F.lit(0.5)),
            "_vis_used": routed & (c("vis_used") if run_vision else F.lit(False)),
        })
        fused = fuse(c("_combined"), c("_vis"), cfg)
    else:
        fused = c("_combined")
    out = out.withColumn("risk", F.when(c("stage").isin("error", "whitelist"), F.lit(0.0))
                         .when(c("stage") == "rule", c("rule_score"))
                         .when(c("stage") == "fast_path", c("_combined"))
                         .otherwise(fused))
    out = out.withColumn("verdict", F.when(c("stage") == "error", F.lit("Error"))
                         .when(c("stage") == "whitelist", F.lit("Safe"))
                         .when(c("stage") == "rule", F.lit("Phishing"))
                         .when(c("stage") == "fast_path", fast)
                         .otherwise(verdict_of(c("risk"), cfg)))
    out = settle(out, "stage", "risk", "verdict")
    lexical = F.struct(F.lit("Lexical").alias("name"), c("lex_prob").alias("probability"),
                       F.lit(True).alias("used"),
                       F.lit("score over URL string features").alias("detail"))
    arrow = F.lit(" -> ")
    if stage2:
        vision = F.struct(
            F.lit("Vision").alias("name"), c("_vis").alias("probability"),
            c("_vis_used").alias("used"),
            F.when(c("_routed"), F.lit("visual score lookup"))
            .otherwise(F.lit("skipped (lexical outside trigger band)")).alias("detail"))
        problem = (F.when(c("_routed") & ~c("_vis_used"), c("vis_note"))
                   if run_vision else F.lit(None).cast("string"))
        summary = F.concat(F.lit("ML prob="), _fmt(c("lex_prob"), 3), F.lit(", rule score="),
                           _fmt(c("rule_score"), 2), F.lit(", fused risk="), _fmt(c("risk"), 3),
                           arrow, c("verdict"), F.lit("."))
        full_notes = F.array_compact(F.array(problem, summary))
        full_scores = F.array(lexical, vision)
        fast_tail = " fast-path (no capture)."
    else:
        rule_note = F.when(c("rule_score") > 0, F.concat(
            F.lit("Rule score: "), _fmt(c("rule_score"), 2), F.lit(" - "), c("rule_reason")))
        full_notes = F.array_compact(F.array(
            F.concat(F.lit("ML probability: "), _fmt(c("lex_prob"), 3)), rule_note,
            F.concat(F.lit("Combined risk: "), _fmt(c("risk"), 3), arrow, c("verdict"))))
        full_scores = F.array(lexical)
        fast_tail = " fast-path."
    notes = (F.when(c("stage") == "error", F.array(F.lit("Malformed URL")))
             .when(c("stage") == "whitelist", F.array(
                 F.lit("Domain is in known legitimate whitelist -> Safe.")))
             .when(c("stage") == "rule", F.array(
                 F.concat(F.lit("Rule-based detection: "), c("rule_reason"))))
             .when(c("stage") == "fast_path", F.array(F.concat(
                 F.lit("Combined score confident -> "), c("verdict"), F.lit(fast_tail))))
             .otherwise(full_notes))
    empty = F.array().cast(STAGE_SCORE_TYPE)
    scores = (F.when(c("stage").isin("error", "whitelist", "rule"), empty)
              .when(c("stage") == "fast_path", F.array(lexical).cast(STAGE_SCORE_TYPE))
              .otherwise(full_scores.cast(STAGE_SCORE_TYPE)))
    shot = (F.when(c("_vis_used"), c("vis_screenshot"))
            if stage2 and run_vision else F.lit(None).cast("string"))
    return out.select(
        *keep, "verdict", "risk",
        c("stage").isin("whitelist", "rule", "fast_path").alias("fast_path"), "stage",
        "rule_score", "lex_prob", scores.alias("stage_scores"), notes.alias("notes"),
        shot.alias("screenshot"))


Scorer = Callable[[DataFrame], DataFrame]


def hybrid_verdict(df: DataFrame, cfg: Config = DEFAULT_CONFIG, scorer: Scorer | Column | None = None,
                   stage2_scores: DataFrame | None = None, rules: RuleSet = SERVER_RULES,
                   whitelist: Sequence[str] | DataFrame = C.KNOWN_DOMAINS, url: str = "url",
                   final_stage2: bool = True) -> DataFrame:
    """Verdict rows for a table of URLs; input columns are kept.

    ``stage2_scores(url, prob, ok, error, screenshot)`` is the visual score
    table; without it the visual stage is off and counts as neutral 0.5.
    ``whitelist`` is a sequence or a table with a ``domain`` column of any size.
    A ``Column`` as ``scorer`` holds scores that the table brings along.
    """
    keep = df.columns
    gated, whitelist = _gates(df, url, rules, whitelist)
    undecided = ~F.col("is_malformed") & ~F.col("is_whitelisted") & (F.col("rule_score") < 0.5)
    if scorer is None or isinstance(scorer, Column):
        # Lazily evaluated only where it is read: decided rows never need it.
        score = heuristic_score(whitelist=whitelist) if scorer is None else scorer
        ready = gated.withColumn("lex_prob", F.when(undecided, score))
    else:
        # One pass decides; the model sees only the rest.
        rest = scorer(gated.filter(undecided))
        done = gated.filter(~undecided).withColumn("lex_prob", F.lit(None).cast("double"))
        ready = done.unionByName(rest)
    if stage2_scores is not None and final_stage2:
        from .joins import join_stage2

        ready = settle(ready, "lex_prob")
        ready = join_stage2(ready, stage2_scores, cfg, url, source=df)
        return _decide(ready, keep, cfg.columns(), True, True)
    return _decide(ready, keep, cfg.columns(), final_stage2, False)


def browser_verdict(df: DataFrame, cfg: Config = DEFAULT_CONFIG, url: str = "url",
                    whitelist: Sequence[str] | DataFrame = C.KNOWN_DOMAINS) -> DataFrame:
    """Browser variant: larger rule set, thresholds straight on the combined score."""
    return hybrid_verdict(df, cfg, rules=BROWSER_RULES, whitelist=whitelist, url=url,
                          final_stage2=False)


def config_sweep(df: DataFrame, configs: DataFrame, url: str = "url",
                 whitelist: Sequence[str] | DataFrame = C.KNOWN_DOMAINS) -> DataFrame:
    """Fused verdict of every URL under every configuration row.

    Scores are computed once per URL; the configurations (a handful of rows,
    bound checked) are broadcast and only the comparisons are repeated.
    """
    from .joins import broadcast_if_small

    keep = df.columns
    gated, whitelist = _gates(df, url, SERVER_RULES, whitelist)
    undecided = ~F.col("is_malformed") & ~F.col("is_whitelisted") & (F.col("rule_score") < 0.5)
    scored = gated.withColumn("lex_prob", F.when(undecided, heuristic_score(whitelist=whitelist)))
    scored = scored.select(*keep, "is_malformed", "is_whitelisted", "rule_score", "rule_reason",
                           "lex_prob")
    swept = scored.crossJoin(broadcast_if_small(configs))
    return _decide(swept, [*keep, "config_id"], config_columns(), True, False)


def batch_verdicts(requests: DataFrame, max_urls: int = 100, **kwargs) -> DataFrame:
    """Verdicts per request, in input order, one bad URL not harming the rest.

    Requests outside 1..``max_urls`` URLs are rejected by validation, which is
    also what bounds the regrouped array; they give a row whose ``rejected``
    says why and whose ``results`` are NULL.
    """
    n = F.coalesce(F.size("urls"), F.lit(-1))
    fits = n.between(1, max_urls)
    reason = (F.when(n < 0, F.lit("no list of URLs")).when(n == 0, F.lit("no URLs"))
              .otherwise(F.lit(f"more than {max_urls} URLs")))
    valid = requests.filter(fits)
    refused = requests.filter(~fits).select("request_id", F.greatest(n, F.lit(0)).cast("long").alias("n_urls"),
                                            reason.alias("rejected"))
    rows = valid.select("request_id", F.posexplode("urls").alias("pos", "url"))
    v = hybrid_verdict(rows, **kwargs)
    item = F.struct("pos", "url", "verdict", "risk", "fast_path")
    done = v.groupBy("request_id").agg(
        F.array_sort(F.collect_list(item)).alias("results"),
        F.count(F.lit(1)).alias("n_urls"), F.lit(None).cast("string").alias("rejected"))
    return done.unionByName(refused, allowMissingColumns=True)


def display_fields(df: DataFrame) -> DataFrame:
    """Badge, percentage, colour band and path label of verdict rows."""
    v, r = F.col("verdict"), F.col("risk")
    color = F.lit(C.BADGE_COLORS["Safe"])
    for name in ("Suspicious", "Phishing"):
        color = F.when(v == name, F.lit(C.BADGE_COLORS[name])).otherwise(color)
    return df.withColumns({
        "badge_color": color,
        "badge_text": F.when(v == "Safe", F.lit("")).otherwise(F.substring(v, 1, 1)),
        "risk_percent": F.floor(r * 100 + 0.5).cast("int"),
        "risk_color": F.when(r <= 0.33, F.lit(C.RISK_BAND_COLORS["low"]))
        .when(r >= 0.66, F.lit(C.RISK_BAND_COLORS["high"]))
        .otherwise(F.lit(C.RISK_BAND_COLORS["mid"])),
        "path_label": F.when(F.col("fast_path"), F.lit("Fast-path"))
        .otherwise(F.lit("Full analysis")),
    })


def response_actions(df: DataFrame, block_mode: Column | str = "both") -> DataFrame:
    """Block / alert decisions for verdict rows."""
    mode = F.lit(block_mode) if isinstance(block_mode, str) else block_mode
    bad = F.col("verdict").isin("Phishing", "Suspicious")
    block = bad & mode.isin("block", "both")
    return df.withColumns({
        "should_block": block,
        "should_alert": bad & mode.isin("alert", "both"),
        "warning_url": F.when(block, F.concat(
            F.lit("warning.html?url="), U.encode_component(F.col("url")),
            F.lit("&reasons="), U.encode_component(F.to_json("notes")))),
    })


def internal_verdict(df: DataFrame, url: str = "url") -> DataFrame:
    """Browser-internal pages are Safe without analysis; others get NULL."""
    internal = U.is_internal(F.col(url))
    return df.withColumns({
        "is_internal": internal,
        "verdict": F.when(internal, F.lit("Safe")),
        "risk": F.when(internal, F.lit(0.0)),
        "fast_path": F.when(internal, F.lit(True)),
    })
