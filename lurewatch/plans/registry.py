"""All registered queries with their check SQL.

``QUERIES[name]`` takes ``(spark, sf_dir)``; ``ORACLE[name]`` is the SQL twin.
Every query runs over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import brands as B
from ..functions import constants as C
from ..functions import features as FE
from ..functions import strings as S
from ..functions import urls as U
from ..operators import corpus as K
from ..operators import generators as G
from ..operators import joins as J
from ..operators import metrics as A
from ..operators import rules as R
from ..operators import scoring as M
from ..operators import verdict as V
from ..sources import dims, feeds
from ..streaming import nav as T
from . import corpora as P
from . import oracle as O

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, check: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if check is not None:
            ORACLE[name] = check
        return fn
    return register


def r6(col, name: str):
    return F.round(col, 6).alias(name)


def dec(col):
    """Exact, order-free sums: six decimals."""
    return F.round(col, 6).cast("decimal(38,6)")


KEY = ("source", "seq")
PC = O.parsed("corpus")
RC = O.rules("corpus")
LEX = O.lex_scores("corpus")
# verdict chains read rules on top of the lexical scores
RL = O.rules("corpus", base="lex_corpus")
RBL = O.rules("corpus", base="lex_corpus", browser=True)
VC = O.verdicts("corpus")
VB = O.verdicts("corpus", browser=True)


def hosts(spark: SparkSession, d: str) -> DataFrame:
    return U.host_columns(P.corpus(spark, d))


# --- sources and sinks -------------------------------------------------------

@query("scan_labelled_csv", O.sql(
    "SELECT trim(url) AS url, label, count(*) AS n FROM corpus GROUP BY ALL"))
def scan_labelled_csv(spark, d):
    path = feeds.work_dir(spark, "labelled")
    feeds.write_corpus(P.corpus(spark, d).withColumn("url", F.trim("url")), path)
    return feeds.read_labelled_csv(spark, path).groupBy("url", "label").agg(
        F.count(F.lit(1)).alias("n"))


@query("scan_fallback_sample", O.sql(
    "SELECT url, label FROM corpus WHERE source = 'page' "
    "UNION ALL SELECT * FROM (VALUES "
    + ", ".join(f"('{u}', {y})" for u, y in C.FALLBACK_FEED_ROWS) + ") v(url, label)"))
def scan_fallback_sample(spark, d):
    # A feed with rows is kept as it is; an empty one is replaced by the sample.
    pages = P.corpus(spark, d).filter("source = 'page'").select("url", "label")
    empty = pages.filter(F.col("label") == 1)
    return feeds.or_fallback(pages).unionByName(feeds.or_fallback(empty))


@query("feed_verified_csv", O.sql(
    "SELECT trim(url) AS url, 1 AS label FROM ev_urls WHERE label = 1 AND trim(url) <> ''"))
def feed_verified_csv(spark, d):
    path = feeds.work_dir(spark, "verified")
    ev = P.event_urls(P.load(spark, d, "events")).filter("label = 1")
    (ev.select(F.col("seq").alias("phish_id"), "url", F.lit("yes").alias("verified"))
     .write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path))
    return feeds.read_verified_csv(spark, path)


@query("feed_lines", O.sql(
    "SELECT trim(url) AS url, 1 AS label FROM corpus WHERE starts_with(trim(url), 'http')"))
def feed_lines(spark, d):
    path = feeds.work_dir(spark, "lines")
    P.corpus(spark, d).select("url").write.text(path)
    return feeds.read_lines(spark, path)


@query("feed_commented_csv", O.sql(
    "SELECT trim(url) AS url, 1 AS label FROM ev_urls WHERE label = 1 AND seq % 3 > 0"))
def feed_commented_csv(spark, d):
    path = feeds.work_dir(spark, "commented")
    ev = P.event_urls(P.load(spark, d, "events")).filter("label = 1")
    status = F.when(F.col("seq") % 3 > 0, "online").otherwise("offline")
    q = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    line = F.concat_ws(",", q(F.col("seq").cast("string")), q(F.lit("2024-01-01")), q(F.col("url")),
                       q(F.lit("phish")), q(status))
    rows = ev.select(F.when(F.col("seq") % 50 == 1, F.concat(
        F.lit("# note "), F.col("seq").cast("string"), F.lit("\n"), line)).otherwise(line).alias("value"))
    rows.write.text(path)
    return feeds.read_commented_csv(spark, path)


@query("feed_ranked_domains", O.sql(
    "SELECT page_id AS rank, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS domain, "
    "'https://' || regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS url, 0 AS label FROM pages"))
def feed_ranked_domains(spark, d):
    path = feeds.work_dir(spark, "ranked")
    domain = F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1)
    P.load(spark, d, "pages").select("page_id", domain).write.csv(path)
    return feeds.read_ranked(spark, path)


def _feeds(spark, d) -> dict[str, DataFrame]:
    c = P.corpus(spark, d)
    ev = c.filter("source = 'event'")
    return {"verified": ev.filter("label = 1 AND seq % 2 = 0"),
            "lines": ev.filter("label = 1 AND seq % 2 = 1"),
            "ranked": c.filter("source <> 'event'")}


UNION_FEEDS = {"feed_all": (
    "SELECT url, label, 'verified' AS source, 0 AS priority, seq FROM corpus WHERE source = 'event' AND label = 1 AND seq % 2 = 0 "
    "UNION ALL SELECT url, label, 'lines', 1, seq FROM corpus WHERE source = 'event' AND label = 1 AND seq % 2 = 1 "
    "UNION ALL SELECT url, label, 'ranked', 2, seq FROM corpus WHERE source <> 'event'")}


@query("feed_union", O.sql(
    "SELECT source, priority, label, count(*) AS n_rows, count(DISTINCT url) AS n_urls "
    "FROM feed_all GROUP BY ALL", UNION_FEEDS))
def feed_union(spark, d):
    return feeds.union_feeds(_feeds(spark, d)).groupBy("source", "priority", "label").agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("url").alias("n_urls"))


@query("sink_corpus_roundtrip", O.sql(
    "SELECT url, label, count(*) AS n FROM (SELECT DISTINCT trim(url) AS url, label FROM corpus) GROUP BY ALL"))
def sink_corpus_roundtrip(spark, d):
    path = feeds.work_dir(spark, "corpus")
    feeds.write_corpus(K.dedup_within_label(P.corpus(spark, d).withColumn("url", F.trim("url"))), path)
    return feeds.read_labelled_csv(spark, path).groupBy("url", "label").agg(F.count(F.lit(1)).alias("n"))


@query("dim_brands", O.sql(
    "SELECT i - 1 AS idx, b AS brand, (SELECT count(*) FROM ev_urls WHERE contains(lower(url), b)) AS n_urls "
    f"FROM (SELECT unnest({O.BR}) AS b, generate_subscripts({O.BR}, 1) AS i)"))
def dim_brands(spark, d):
    ev = P.event_urls(P.load(spark, d, "events"))
    hits = J.brand_contains(ev.withColumn("t", F.lower("url")), dims.brands(spark), "t")
    counts = hits.groupBy("idx").agg(F.count(F.lit(1)).alias("n_urls"))
    return dims.brands(spark).join(F.broadcast(counts), "idx", "left").select(
        "idx", "brand", F.coalesce("n_urls", F.lit(0)).alias("n_urls"))


@query("dim_tlds", O.sql(
    f"SELECT t.tld AS tld, t.trust AS trust, count(p.url) AS n_urls FROM ("
    f"SELECT unnest({O.lst(C.TRUSTED_TLDS)}) AS tld, 1.0::DOUBLE AS trust UNION ALL "
    f"SELECT unnest({O.lst(C.SUSPICIOUS_TLDS)}), 0.0) t LEFT JOIN p_corpus p ON p.tld = t.tld GROUP BY ALL", PC))
def dim_tlds(spark, d):
    counts = hosts(spark, d).groupBy("tld").agg(F.count(F.lit(1)).alias("n_urls"))
    return dims.tlds(spark).join(counts, "tld", "left").select(
        "tld", "trust", F.coalesce("n_urls", F.lit(0)).alias("n_urls"))


@query("dim_whitelist", O.sql(
    f"SELECT w.domain AS domain, count(p.url) AS n_urls FROM (SELECT unnest({O.lst(C.KNOWN_DOMAINS)}) AS domain) w "
    "LEFT JOIN p_corpus p ON p.host = w.domain GROUP BY ALL", PC))
def dim_whitelist(spark, d):
    counts = hosts(spark, d).groupBy(F.col("host").alias("domain")).agg(F.count(F.lit(1)).alias("n_urls"))
    wl = dims.whitelist(spark)
    return wl.join(counts.join(F.broadcast(wl), "domain", "left_semi"), "domain", "left").select(
        "domain", F.coalesce("n_urls", F.lit(0)).alias("n_urls"))


@query("sink_verdicts_roundtrip", O.sql(
    f"SELECT source, seq, url, verdict, round(risk, 6) AS risk, fast_path, stage, {O.notes_text()} AS notes, "
    f"{O.score_text()} AS stage_scores FROM v_corpus", PC, LEX, RL, VC))
def sink_verdicts_roundtrip(spark, d):
    path = feeds.work_dir(spark, "verdicts")
    rows = V.hybrid_verdict(P.corpus(spark, d))
    rows.write.parquet(path)
    return verdict_text(spark.read.schema(rows.schema).parquet(path))


def verdict_text(v: DataFrame, *extra: str) -> DataFrame:
    """Flat comparison form of verdict rows."""
    scores = F.transform("stage_scores", lambda s: F.concat_ws(
        ":", s["name"], F.format_number(s["probability"], 6), s["used"].cast("string")))
    return v.select(*KEY, "url", "verdict", r6(F.col("risk"), "risk"), "fast_path", "stage",
                    F.array_join("notes", " | ").alias("notes"),
                    F.array_join(scores, " | ").alias("stage_scores"), *extra)


# --- URL decomposition -----------------------------------------------------

@query("url_normalise", O.sql("SELECT source, seq, u AS stripped, full_url FROM p_corpus", PC))
def url_normalise(spark, d):
    u = U.strip(F.col("url"))
    return P.corpus(spark, d).select(*KEY, u.alias("stripped")).withColumn(
        "full_url", U.normalise(F.col("stripped")))


@query("url_parse", O.sql(
    "SELECT source, seq, scheme, netloc, host, path, query, is_malformed FROM p_corpus", PC))
def url_parse(spark, d):
    return U.parse_url_columns(P.corpus(spark, d)).select(
        *KEY, "scheme", "netloc", "host", "path", "query", "is_malformed")


@query("url_is_ip", O.sql("SELECT source, seq, host, is_ip FROM p_corpus", PC))
def url_is_ip(spark, d):
    return U.parse_url_columns(P.corpus(spark, d)).select(
        *KEY, "host", U.is_ip(F.col("host")).alias("is_ip"))


@query("url_domain_parts", O.sql(
    "SELECT source, seq, host, tld, domain_base, reg_domain, rule_domain FROM p_corpus", PC))
def url_domain_parts(spark, d):
    return hosts(spark, d).select(*KEY, "host", "tld", "domain_base", "reg_domain", "rule_domain")


@query("url_slug", O.sql(
    "SELECT source, seq, substr(regexp_replace(url, '[^a-zA-Z0-9]', '_', 'g'), 1, 80) AS slug FROM corpus"))
def url_slug(spark, d):
    return P.corpus(spark, d).select(*KEY, U.slug(F.col("url")).alias("slug"))


@query("domain_words", O.sql(
    "SELECT source, seq, array_to_string(list_filter(regexp_split_to_array(domain_base, '[^a-zA-Z]'), "
    "lambda w: length(w) >= 2), ',') AS words FROM p_corpus", PC))
def domain_words(spark, d):
    return hosts(spark, d).select(
        *KEY, F.array_join(U.domain_words(F.col("domain_base")), ",").alias("words"))


@query("url_validate", O.sql(
    "SELECT source, seq, n_chars, n_chars BETWEEN 1 AND 2048 AS is_valid FROM ("
    "SELECT source, seq, length(url) AS n_chars FROM corpus UNION ALL "
    "SELECT 'document', doc_id, length(text) FROM documents)"))
def url_validate(spark, d):
    c = P.corpus(spark, d).select(*KEY, "url")
    docs = P.load(spark, d, "documents").select(
        F.lit("document").alias("source"), F.col("doc_id").alias("seq"), F.col("text").alias("url"))
    return c.unionByName(docs).select(*KEY, F.length("url").alias("n_chars"),
                                      U.is_valid_request_url(F.col("url")).alias("is_valid"))


@query("url_internal_filter", O.sql(
    "SELECT source, seq, url, regexp_matches(url, '(?i)^(chrome|chrome-extension|about|edge|moz-extension|"
    "safari-extension)://') AS is_internal, CASE WHEN is_internal THEN 'Safe' END AS verdict, "
    "CASE WHEN is_internal THEN 0e0 END AS risk, CASE WHEN is_internal THEN true END AS fast_path FROM corpus"))
def url_internal_filter(spark, d):
    return V.internal_verdict(P.corpus(spark, d)).select(
        *KEY, "url", "is_internal", "verdict", "risk", "fast_path")


BARE = {"bare": (
    "SELECT DISTINCT rtrim(replace(url, 'https://', ''), '/') AS domain FROM corpus2 WHERE label = 0 "
    "AND starts_with(url, 'https://') AND length(url) - length(replace(url, '/', '')) <= 2 "
    "AND contains(domain, '.') AND length(domain) < 50")}
CORPUS2 = {"corpus2": (
    "SELECT url, label FROM corpus UNION ALL SELECT 'https://' || regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), 0 FROM pages")}


def _with_bare(spark, d) -> DataFrame:
    """Corpus plus a path-less URL per page host, as a ranked feed gives them."""
    pages = P.load(spark, d, "pages").select(F.concat(
        F.lit("https://"), F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1)).alias("url"),
        F.lit(0).alias("label"))
    return P.corpus(spark, d).select("url", "label").unionByName(pages)


@query("bare_domains", O.sql("SELECT domain FROM bare", CORPUS2, BARE))
def bare_domains(spark, d):
    return K.bare_domains(_with_bare(spark, d))


@query("verdict_error_rows", O.sql(
    "SELECT source, seq, url, verdict, risk, rule_score FROM v_corpus WHERE verdict = 'Error'",
    PC, LEX, RL, VC))
def verdict_error_rows(spark, d):
    return V.hybrid_verdict(P.corpus(spark, d)).filter("verdict = 'Error'").select(
        *KEY, "url", "verdict", "risk", "rule_score")


_LONG = {"feats": f"SELECT {O.features('', C.FEATURE_NAMES)} FROM p_corpus"}


@query("feature_long", O.sql(
    "SELECT feature, count(*) AS n_rows, count_if(value <> 0) AS n_nonzero, "
    "sum(value::DECIMAL(38,6)) AS total, max(value) AS top FROM "
    f"(UNPIVOT feats ON {', '.join(C.FEATURE_NAMES)} INTO NAME feature VALUE value) GROUP BY feature", PC, _LONG))
def feature_long(spark, d):
    rows = FE.feature_long(P.corpus(spark, d).select("source", "seq", "url"))
    v = F.round("value", 6)
    # The value of every URL is rounded, made a decimal and added up, in the task that made it.
    by_source = rows.groupBy("source", "feature").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(v != 0).alias("n_nonzero"),
        F.sum(dec(F.col("value"))).alias("total"), F.max(v).alias("top"))
    return by_source.groupBy("feature").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n_nonzero").alias("n_nonzero"),
        F.sum("total").cast("decimal(38,6)").alias("total"), F.max("top").alias("top"))


@query("feature_vector", O.sql(
    "SELECT source, seq, concat_ws(',', "
    + ", ".join(f"({O.FEATURE_SQL[n]})::DECIMAL(18,6)::VARCHAR" for n in C.FEATURE_NAMES)
    + ") AS features FROM p_corpus", PC))
def feature_vector(spark, d):
    rows = FE.feature_array(P.corpus(spark, d).select(*KEY, "url"))
    return rows.select(*KEY, F.array_join(F.transform(
        "features", lambda x: F.round(x, 6).cast("decimal(18,6)").cast("string")), ",").alias("features"))


# --- string kernels ----------------------------------------------------------

def kernel(name: str, text_sql: str, fn, cols: dict, checks: dict):
    body = ", ".join(f"{v} AS {k}" for k, v in checks.items())

    @query(name, O.sql(f"SELECT source, seq, {body} FROM p_corpus", PC))
    def run(spark, d):
        return hosts(spark, d).select(*KEY, *[e().alias(k) for k, e in cols.items()])
    return run


_host, _u, _d = (lambda: F.col("host")), (lambda: F.col("u")), (lambda: F.col("domain_base"))
kernel("str_entropy", "", None,
       {"h_host": lambda: F.round(S.entropy(_host()), 6), "h_url": lambda: F.round(S.entropy(_u()), 6)},
       {"h_host": f"round({O.entropy('host')}, 6)", "h_url": f"round({O.entropy('u')}, 6)"})
kernel("str_max_special_run", "", None, {"run": lambda: S.max_special_run(_u())},
       {"run": O.longest("u", "[^\\p{L}\\p{N}]+")})
kernel("str_consonant_run", "", None, {"run": lambda: S.max_consonant_run(_d())},
       {"run": O.longest("domain_base", "[^aeiou\\P{L}]+")})
kernel("str_distinct_chars", "", None,
       {"n_host": lambda: S.distinct_chars(_host()), "n_url": lambda: S.distinct_chars(_u())},
       {"n_host": O.n_distinct("host"), "n_url": O.n_distinct("u")})
kernel("str_char_counts", "", None,
       {"dots": lambda: S.count_of(_u(), "."), "hyphens": lambda: S.count_of(_u(), "-"),
        "slashes": lambda: S.count_of(_u(), "/"), "digits": lambda: S.count_match(_u(), r"\p{Nd}"),
        "escapes": lambda: S.count_match(_u(), "%[0-9a-fA-F]{2}")},
       {"dots": O.count_char("u", "."), "hyphens": O.count_char("u", "-"), "slashes": O.count_char("u", "/"),
        "digits": O.count_re("u", "\\p{Nd}"), "escapes": O.count_re("u", "%[0-9a-fA-F]{2}")})
kernel("keyword_count", "", None,
       {"n": lambda: S.keyword_hits("lower(u)", C.SUSPICIOUS_KEYWORDS)},
       {"n": f"len(list_filter({O.lst(C.SUSPICIOUS_KEYWORDS)}, lambda k: contains(lower(u), k)))"})


@query("str_levenshtein", O.sql(
    f"SELECT b AS brand, min(dist) AS nearest, count(*) FILTER (dist <= 2) AS n_close, CAST(sum(dist) AS BIGINT) AS total FROM "
    f"(SELECT b, {O.lev('da', 'b')} AS dist FROM (SELECT DISTINCT domain_base, da FROM p_corpus), "
    f"(SELECT unnest({O.BR}) AS b)) GROUP BY b", PC))
def str_levenshtein(spark, d):
    dom = hosts(spark, d).select("domain_base").distinct()
    pairs = dom.select("domain_base", F.explode(S.str_array(C.BRANDS)).alias("brand"))
    dist = F.levenshtein("domain_base", "brand")
    return pairs.groupBy("brand").agg(F.min(dist).alias("nearest"), F.count_if(dist <= 2).alias("n_close"),
                                      F.sum(dist).alias("total"))


# --- the 77 features, by family -------------------------------------------------

def family(tag: str, names):
    @query(f"features_{tag}", O.sql(f"SELECT source, seq, {O.features('', names)} FROM p_corpus", PC))
    def run(spark, d):
        rows = FE.extract_features(P.corpus(spark, d).select(*KEY, "url"), names)
        return rows.select(*KEY, *[r6(F.col(n), n) for n in names])


for _tag, _names in C.FEATURE_FAMILIES.items():
    family(_tag, _names)


# --- joins ---------------------------------------------------------------------

@query("join_whitelist_suffix", O.sql(
    f"SELECT source, seq, host FROM p_corpus WHERE {O.suffix_in('host', C.KNOWN_DOMAINS)}", PC))
def join_whitelist_suffix(spark, d):
    return J.suffix_semi(hosts(spark, d).select(*KEY, "host"), dims.whitelist(spark))


@query("join_whitelist_exact", O.sql(
    f"SELECT source, seq, host, (host IN {O.tup(C.KNOWN_DOMAINS)} OR (contains(host, '.') AND NOT is_ip "
    f"AND reg_domain IN {O.tup(C.KNOWN_DOMAINS)})) AS is_known FROM p_corpus", PC))
def join_whitelist_exact(spark, d):
    rows = hosts(spark, d).select(*KEY, "host", "is_ip", "reg_domain")
    return J.exact_match(rows, dims.whitelist(spark)).select(*KEY, "host", "is_known")


@query("join_free_hosting", O.sql(
    f"SELECT source, seq, host, list_filter({O.lst(C.FREE_HOSTING)}, lambda x: host = x OR ends_with(host, '.' || x))[1] "
    "AS matched_domain FROM p_corpus", PC))
def join_free_hosting(spark, d):
    return J.suffix_match(hosts(spark, d).select(*KEY, "host"), dims.free_hosting(spark)).select(
        *KEY, "host", "matched_domain")


@query("join_shorteners", O.sql(
    f"SELECT host, host IN {O.tup(C.SHORTENERS)} AS is_shortener, count(*) AS n FROM p_corpus GROUP BY ALL", PC))
def join_shorteners(spark, d):
    rows = hosts(spark, d).select("host")
    dim = dims.shorteners(spark)
    hit = J.membership(rows, dim, "host").withColumn("is_shortener", F.lit(True))
    rest = J.membership(rows, dim, "host", "left_anti").withColumn("is_shortener", F.lit(False))
    return hit.unionByName(rest).groupBy("host", "is_shortener").agg(F.count(F.lit(1)).alias("n"))


@query("join_tld_trust", O.sql(
    f"SELECT source, seq, tld, CASE WHEN tld = '' THEN 0e0 WHEN tld IN {O.tup(C.TRUSTED_TLDS)} THEN 1e0 "
    f"WHEN tld IN {O.tup(C.SUSPICIOUS_TLDS)} THEN 0e0 ELSE 0.5e0 END AS tld_trust FROM p_corpus", PC))
def join_tld_trust(spark, d):
    return J.tld_trust(hosts(spark, d).select(*KEY, "tld"), dims.tlds(spark)).select(*KEY, "tld", "tld_trust")


@query("join_brand_contains", O.sql(
    f"SELECT source, seq, domain_base, b AS brand FROM p_corpus, (SELECT unnest({O.BR}) AS b) "
    "WHERE contains(domain_base, b)", PC))
def join_brand_contains(spark, d):
    return J.brand_contains(hosts(spark, d).select(*KEY, "domain_base"), dims.brands(spark)).select(
        *KEY, "domain_base", "brand")


@query("join_brand_similarity", O.sql(
    f"SELECT domain_base, b AS brand, {O.lev('da', 'b')} AS dist FROM "
    f"(SELECT DISTINCT domain_base, da FROM p_corpus), (SELECT unnest({O.BR}) AS b) WHERE dist <= 2", PC))
def join_brand_similarity(spark, d):
    return J.brand_similarity(hosts(spark, d), dims.brands(spark)).select("domain_base", "brand", "dist")


@query("nearest_brand", O.sql(
    f"SELECT domain_base, {O.BR}[list_position(ds, list_min(ds))] AS brand, list_min(ds) AS dist FROM "
    f"(SELECT domain_base, list_transform({O.BR}, lambda b: {O.lev('da', 'b')}) AS ds FROM "
    "(SELECT DISTINCT domain_base, da FROM p_corpus))", PC))
def nearest_brand(spark, d):
    return J.nearest_brand(hosts(spark, d), dims.brands(spark))


# The names of the pages as the table to be near to, taken as too large for literals.
@query("nearest_brand_table", O.sql(
    f"SELECT domain_base, brand, dist FROM (SELECT domain_base, brand, idx, {O.lev('da', 'brand')} AS dist "
    "FROM (SELECT DISTINCT domain_base, da FROM p_corpus), "
    "(SELECT brand, ('0x' || substr(md5(brand), 1, 15))::BIGINT AS idx FROM names)) "
    "QUALIFY row_number() OVER (PARTITION BY domain_base ORDER BY dist, idx) = 1", PC))
def nearest_brand_table(spark, d):
    return J.nearest_brand(hosts(spark, d), P.names(spark, d).select(
        "brand", F.conv(F.substr(F.md5("brand"), F.lit(1), F.lit(15)), 16, 10).cast("long").alias("idx")), literal=0)


@query("antijoin_existing_urls", O.sql(
    "SELECT seq, url, label FROM corpus WHERE source = 'event' AND url NOT IN "
    "(SELECT url FROM corpus WHERE source = 'event' AND label = 0)"))
def antijoin_existing_urls(spark, d):
    ev = P.event_urls(P.load(spark, d, "events"))
    return J.anti_existing(ev, ev.filter("label = 0")).select("seq", "url", "label")


def stage2_table(c: DataFrame) -> DataFrame:
    """A visual score table derived from the corpus: some rows missing, some failed."""
    k = S.md5_bucket(F.col("url"), 100)
    rows = c.select("url").distinct().withColumn("k", k).filter("k < 80")
    return rows.select(
        "url", F.when(F.col("k") % 9 != 0, F.col("k") / 80.0).alias("prob"),
        (F.col("k") % 7 != 0).alias("ok"),
        F.when(F.col("k") % 7 == 0, F.lit("timeout")).alias("error"),
        F.concat(U.slug(F.col("url")), F.lit(".png")).alias("screenshot"))


S2 = {"s2": (
    "SELECT url AS s2_url, CASE WHEN k % 9 <> 0 THEN k / 80e0 END AS prob, k % 7 <> 0 AS ok, "
    "CASE WHEN k % 7 = 0 THEN 'timeout' END AS error, "
    "substr(regexp_replace(url, '[^a-zA-Z0-9]', '_', 'g'), 1, 80) || '.png' AS screenshot FROM "
    "(SELECT url, ('0x' || substr(md5(url), 1, 8))::BIGINT % 100 AS k FROM (SELECT DISTINCT url FROM corpus)) WHERE k < 80")}
VS = O.verdicts("corpus", out="vs_corpus", vision=True)


@query("join_stage2_scores", O.sql(
    f"SELECT source, seq, url, verdict, round(risk, 6) AS risk, fast_path, stage, {O.notes_text(vision=True)} AS notes, "
    f"{O.score_text()} AS stage_scores, CASE WHEN stage = 'fused' AND vis_used THEN shot END AS screenshot "
    "FROM vs_corpus", PC, LEX, RL, S2, VS))
def join_stage2_scores(spark, d):
    c = P.corpus(spark, d)
    return verdict_text(V.hybrid_verdict(c, stage2_scores=stage2_table(c)), "screenshot")


SWEEP_ROWS = ((0, 0.5, 0.5, 0.33, 0.66), (1, 1.0, 0.0, 0.33, 0.66), (2, 0.8, 0.2, 0.5, 0.6),
              (3, 0.0, 0.0, 0.33, 0.66))
CFGS = {"cfgs": "SELECT * FROM (VALUES " + ", ".join(
    f"({i}, {a}::DOUBLE, {b}::DOUBLE, {s}::DOUBLE, {p}::DOUBLE)" for i, a, b, s, p in SWEEP_ROWS)
    + ") c(config_id, cw_l, cw_v, c_safe, c_phish)"}
_SW_CFG = {**O.CFG, "w_lexical": "cw_l", "w_vision": "cw_v", "safe_threshold": "c_safe",
           "phishing_threshold": "c_phish"}
SWEEP_SRC = {"r_sweep": "SELECT * FROM r_corpus, cfgs"}
VSW = O.verdicts("sweep", out="v_sweep", cfg=_SW_CFG)


@query("config_sweep", O.sql(
    "SELECT source, seq, config_id, verdict, round(risk, 6) AS risk FROM v_sweep",
    PC, LEX, RL, CFGS, SWEEP_SRC, VSW))
def config_sweep(spark, d):
    rows = [(i, a, b, 0.15, 0.85, 0.15, 0.85, s, p) for i, a, b, s, p in SWEEP_ROWS]
    cfgs = spark.createDataFrame(rows, "config_id int, w_lexical double, w_vision double, "
                                 "fast_path_safe double, fast_path_malicious double, vision_trigger_lo double, "
                                 "vision_trigger_hi double, safe_threshold double, phishing_threshold double")
    return V.config_sweep(P.corpus(spark, d), cfgs).select(
        *KEY, "config_id", "verdict", r6(F.col("risk"), "risk"))


# --- rules -----------------------------------------------------------------------

def rule(name: str, cols: dict, check: str, rules=R.SERVER_RULES):
    src = O.rules("corpus", browser=rules.browser)
    tag = "rb" if rules.browser else "r"

    @query(name, O.sql(f"SELECT source, seq, {check} FROM {tag}_corpus", PC, src))
    def run(spark, d):
        out = R.add_rule_columns(hosts(spark, d), rules)
        return out.select(*KEY, *[e.alias(k) for k, e in cols().items()])


rule("rule_brand_near", lambda: {"dom": F.col("dom"), "brand": F.col("rule_near_brand"),
                                 "dist": F.col("rule_near_dist")},
     f"dom, near_brand AS brand, {O.lev('dom_a', 'near_brand')} AS dist")
rule("rule_brand_hyphen", lambda: {"dom": F.col("dom"), "hit": F.col("rule_hyphen")}, "dom, hyphen AS hit")
rule("rule_affix", lambda: {"dom": F.col("dom"), "prefix": F.col("rule_prefix"),
                            "suffix": F.col("rule_suffix")},
     "dom, pre[1] AS prefix, suf[1] AS suffix")
rule("rule_ip_host", lambda: {"host": F.col("host"), "hit": F.col("rule_ip")}, "host, is_ip AS hit")
rule("rule_short_brand", lambda: {"dom": F.col("dom"), "hit": F.col("rule_short")},
     "dom, short_hit AS hit", R.BROWSER_RULES)
rule("rule_free_host_brand", lambda: {"host": F.col("host"), "hit": F.col("rule_free_host")},
     "host, free_hit AS hit", R.BROWSER_RULES)
rule("rule_data_uri", lambda: {"hit": F.col("rule_data_uri")}, "data_hit AS hit", R.BROWSER_RULES)


def rule_total(name: str, rules):
    src = O.rules("corpus", browser=rules.browser)
    tag = "rb" if rules.browser else "r"

    @query(name, O.sql(f"SELECT source, seq, round(rule_score, 6) AS rule_score, rule_reason FROM {tag}_corpus",
                       PC, src))
    def run(spark, d):
        return R.add_rule_score(hosts(spark, d), rules).select(
            *KEY, r6(F.col("rule_score"), "rule_score"), "rule_reason")


rule_total("rule_score", R.SERVER_RULES)
rule_total("rule_score_extended", R.BROWSER_RULES)


# --- cascade -----------------------------------------------------------------------

@query("verdict_whitelist_gate", O.sql(
    "SELECT source, seq, host, verdict, risk, fast_path FROM v_corpus WHERE stage = 'whitelist'", PC, LEX, RL, VC))
def verdict_whitelist_gate(spark, d):
    gated = V.add_gates(P.corpus(spark, d)).filter("is_whitelisted")
    return gated.select(*KEY, "host", F.lit("Safe").alias("verdict"), F.lit(0.0).alias("risk"),
                        F.lit(True).alias("fast_path"))


@query("verdict_rule_gate", O.sql(
    "SELECT source, seq, host, verdict, round(risk, 6) AS risk, rule_reason FROM v_corpus WHERE stage = 'rule'",
    PC, LEX, RL, VC))
def verdict_rule_gate(spark, d):
    gated = V.add_gates(P.corpus(spark, d)).filter("not is_whitelisted and rule_score >= 0.5")
    return gated.select(*KEY, "host", F.lit("Phishing").alias("verdict"), r6(F.col("rule_score"), "risk"),
                        "rule_reason")


def _combined(spark, d) -> DataFrame:
    gated = V.add_gates(P.corpus(spark, d)).withColumn("lex_prob", M.heuristic_score())
    return gated.withColumn("combined", V.combined_risk(F.col("lex_prob"), F.col("rule_score")))


@query("combined_risk", O.sql(
    "SELECT source, seq, round(lex_prob, 6) AS lex_prob, round(comb, 6) AS combined FROM v_corpus", PC, LEX, RL, VC))
def combined_risk(spark, d):
    return _combined(spark, d).select(*KEY, r6(F.col("lex_prob"), "lex_prob"), r6(F.col("combined"), "combined"))


@query("verdict_fast_path", O.sql(
    "SELECT source, seq, round(comb, 6) AS combined, fast AS verdict FROM v_corpus", PC, LEX, RL, VC))
def verdict_fast_path(spark, d):
    return _combined(spark, d).select(*KEY, r6(F.col("combined"), "combined"), V.fast_path_verdict(
        F.col("combined"), V.DEFAULT_CONFIG.columns()).alias("verdict"))


@query("stage2_routing", O.sql(
    "SELECT source, seq, url FROM v_corpus WHERE stage = 'fused' AND routed", PC, LEX, RL, VC))
def stage2_routing(spark, d):
    rows = _combined(spark, d).filter("not is_malformed and not is_whitelisted and rule_score < 0.5")
    return rows.filter(V.needs_stage2(F.col("combined"), V.DEFAULT_CONFIG.columns())).select(*KEY, "url")


@query("fused_risk", O.sql(
    "SELECT source, seq, round((0.5e0 * comb + 0.5e0 * coalesce(k / 100e0, 0.5e0)) / 1e0, 6) AS fused, "
    "round((0e0 * comb + 0e0 * (k / 100e0)) / 1e0, 6) AS unweighted FROM ("
    "SELECT *, ('0x' || substr(md5(url), 1, 8))::BIGINT % 100 AS k FROM v_corpus)", PC, LEX, RL, VC))
def fused_risk(spark, d):
    vis = S.md5_bucket(F.col("url"), 100) / 100.0
    zero = V.Config(w_lexical=0.0, w_vision=0.0).columns()
    return _combined(spark, d).select(
        *KEY, r6(V.fuse(F.col("combined"), vis, V.DEFAULT_CONFIG.columns()), "fused"),
        r6(V.fuse(F.col("combined"), vis, zero), "unweighted"))


@query("verdict_thresholds", O.sql(
    f"SELECT doc_id, score, {O.verdict_of('score')} AS verdict FROM scored"))
def verdict_thresholds(spark, d):
    return P.scored(spark, d).select("doc_id", "score", V.verdict_of(
        F.col("score"), V.DEFAULT_CONFIG.columns()).alias("verdict"))


@query("verdict_explain", O.sql(
    f"SELECT source, seq, {O.notes_text()} AS notes, {O.score_text()} AS stage_scores FROM v_corpus", PC, LEX, RL, VC))
def verdict_explain(spark, d):
    return verdict_text(V.hybrid_verdict(P.corpus(spark, d))).select(*KEY, "notes", "stage_scores")


VERDICT_COLS = "source, seq, url, verdict, round(risk, 6) AS risk, fast_path, stage"


@query("hybrid_verdict", O.sql(f"SELECT {VERDICT_COLS} FROM v_corpus", PC, LEX, RL, VC))
def hybrid_verdict(spark, d):
    return V.hybrid_verdict(P.corpus(spark, d)).select(
        *KEY, "url", "verdict", r6(F.col("risk"), "risk"), "fast_path", "stage")


@query("hybrid_verdict_no_stage2", O.sql(
    f"SELECT {VERDICT_COLS}, {O.notes_text(browser=True)} AS notes, {O.score_text(browser=True)} AS stage_scores "
    "FROM vb_corpus", PC, LEX, RBL, VB))
def hybrid_verdict_no_stage2(spark, d):
    return verdict_text(V.browser_verdict(P.corpus(spark, d)))


REQ = {"reqs": (
    "SELECT request_id, list(url ORDER BY seq) AS urls FROM ("
    "SELECT CAST(floor(n / 110) AS BIGINT) AS request_id, url, seq FROM ("
    "SELECT url, seq, CASE WHEN seq % 7 = 0 THEN CAST(floor(seq / 770) AS BIGINT) * 770 ELSE seq END AS n FROM ev_urls)) GROUP BY request_id"),
    "req_rows": (
    "SELECT request_id, unnest(urls) AS url, generate_subscripts(urls, 1) - 1 AS pos FROM reqs WHERE len(urls) BETWEEN 1 AND 100")}
PR, RR, VR = (O.parsed("req_rows"), O.rules("req_rows", base="lex_req_rows"), O.verdicts("req_rows"))
LR = O.lex_scores("req_rows")


@query("batch_verdicts", O.sql(
    "SELECT request_id, string_agg(pos::VARCHAR || ':' || verdict || ':' || printf('%.6f', risk) || ':' || fast_path::VARCHAR, ' ' "
    "ORDER BY pos) AS results, count(*) AS n_urls, NULL::VARCHAR AS rejected FROM v_req_rows GROUP BY request_id "
    "UNION ALL SELECT request_id, NULL, len(urls), 'more than 100 URLs' FROM reqs WHERE len(urls) > 100", REQ, PR, LR, RR, VR))
def batch_verdicts(spark, d):
    ev = P.event_urls(feeds.spread(P.load(spark, d, "events")))
    # requests of about 94 URLs; every seventh block collects more and is rejected
    n = F.when(F.col("seq") % 7 == 0, F.floor(F.col("seq") / 770) * 770).otherwise(F.col("seq"))
    reqs = ev.withColumn("request_id", F.floor(n / 110)).groupBy("request_id").agg(
        F.array_sort(F.collect_list(F.struct("seq", "url"))).alias("_r"))
    reqs = reqs.select("request_id", F.col("_r.url").alias("urls"))
    out = V.batch_verdicts(reqs)
    text = F.transform("results", lambda x: F.concat_ws(
        ":", x["pos"].cast("string"), x["verdict"], F.format_number(x["risk"], 6), x["fast_path"].cast("string")))
    return out.select("request_id", F.array_join(text, " ").alias("results"), "n_urls", "rejected")


@query("verdict_display_fields", O.sql(
    "SELECT source, seq, verdict, CASE verdict WHEN 'Phishing' THEN '#e53935' WHEN 'Suspicious' THEN '#fb8c00' "
    "ELSE '#43a047' END AS badge_color, CASE WHEN verdict = 'Safe' THEN '' ELSE substr(verdict, 1, 1) END AS badge_text, "
    "CAST(floor(risk * 100 + 0.5e0) AS INT) AS risk_percent, CASE WHEN risk <= 0.33e0 THEN '#66bb6a' WHEN risk >= 0.66e0 "
    "THEN '#ef5350' ELSE '#ffa726' END AS risk_color, CASE WHEN fast_path THEN 'Fast-path' ELSE 'Full analysis' END AS path_label "
    "FROM vb_corpus", PC, LEX, RBL, VB))
def verdict_display_fields(spark, d):
    return V.display_fields(V.browser_verdict(P.corpus(spark, d))).select(
        *KEY, "verdict", "badge_color", "badge_text", "risk_percent", "risk_color", "path_label")


def _js(s: str) -> str:
    out = f"url_encode({s})"
    for a, b in (("%21", "!"), ("%27", "''"), ("%28", "("), ("%29", ")"), ("%2A", "*")):
        out = f"replace({out}, '{a}', '{b}')"
    return out


_MODES = "CASE seq % 3 WHEN 0 THEN 'both' WHEN 1 THEN 'block' ELSE 'alert' END"
_NOTES_LIST = f"string_split({O.notes_text(browser=True)}, ' | ')"


@query("response_actions", O.sql(
    "SELECT source, seq, url, mode, verdict IN ('Phishing', 'Suspicious') AND mode IN ('block', 'both') AS should_block, "
    "verdict IN ('Phishing', 'Suspicious') AND mode IN ('alert', 'both') AS should_alert, "
    "CASE WHEN verdict IN ('Phishing', 'Suspicious') AND mode IN ('block', 'both') THEN "
    f"'warning.html?url=' || {_js('url')} || '&reasons=' || {_js('to_json(notes)::VARCHAR')} END AS warning_url FROM ("
    f"SELECT *, {_MODES} AS mode, {_NOTES_LIST} AS notes FROM vb_corpus)", PC, LEX, RBL, VB))
def response_actions(spark, d):
    v = V.browser_verdict(P.corpus(spark, d)).withColumn("mode", F.expr(_MODES))
    return V.response_actions(v, F.col("mode")).select(
        *KEY, "url", "mode", "should_block", "should_alert", "warning_url")


# --- scoring ----------------------------------------------------------------------

POS = O.lex_scores("corpus", O.POSITIONAL, "lexpos")


@query("score_heuristic", O.sql("SELECT source, seq, round(lex_prob, 6) AS score FROM lex_corpus", PC, LEX))
def score_heuristic(spark, d):
    return FE.prepare(P.corpus(spark, d)).select(*KEY, r6(M.heuristic_score(), "score"))


@query("score_heuristic_positional", O.sql("SELECT source, seq, round(lex_prob, 6) AS score FROM lexpos_corpus", PC, POS))
def score_heuristic_positional(spark, d):
    return FE.prepare(P.corpus(spark, d)).select(*KEY, r6(M.heuristic_score("positional"), "score"))


@query("ml_hard_label", O.sql(
    "SELECT source, seq, label, CASE WHEN lex_prob >= 0.6e0 THEN 1 ELSE 0 END AS pred FROM lex_corpus", PC, LEX))
def ml_hard_label(spark, d):
    return FE.prepare(P.corpus(spark, d)).select(
        *KEY, "label", M.hard_label(M.heuristic_score(), 0.6).alias("pred"))


@query("model_feature_check", O.sql(
    "SELECT source, model, count(*) AS n_rows, model = 'same' AS accepted FROM corpus, "
    "(VALUES ('same'), ('short'), ('reordered')) v(model) GROUP BY source, model"))
def model_feature_check(spark, d):
    # The feature lists of three saved models: as fitted, one feature short, two features swapped.
    table, names = FE.extract_features(P.corpus(spark, d)), list(C.FEATURE_NAMES)
    path = feeds.work_dir(spark, "feature-lists")
    spark.createDataFrame([("same", names), ("short", names[:-1]), ("reordered", [names[1], names[0], *names[2:]])],
                          "model string, features array<string>").write.parquet(path)
    outcomes = []
    for saved in spark.read.parquet(path).collect():
        try:
            M.check_feature_columns(list(saved["features"]), table.columns)
            outcomes.append((saved["model"], True))
        except ValueError:
            outcomes.append((saved["model"], False))
    models = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.lit(a).alias("accepted")) for m, a in outcomes]))
    return table.groupBy("source").agg(F.count(F.lit(1)).alias("n_rows")).select("source", "n_rows", models.alias("_m")).select(
        "source", "_m.model", "n_rows", "_m.accepted")


@query("split_exact", O.sql(
    "SELECT source, seq, c.label, n > (total * 200 + 500) // 1000 AS is_train FROM corpus c JOIN ("
    "SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(url || '|' || label || '|42')) AS n, "
    "count(*) OVER (PARTITION BY label) AS total FROM (SELECT DISTINCT url, label FROM corpus)) r "
    "ON c.url = r.url AND c.label = r.label"))
def split_exact(spark, d):
    return K.split_exact(P.corpus(spark, d)).select(*KEY, "label", "is_train")


@query("split_stratified", O.sql(
    "SELECT source, seq, label, ('0x' || substr(md5(url || '|' || label || '|42'), 1, 8))::BIGINT % 1000 < 800 AS is_train FROM corpus"))
def split_stratified(spark, d):
    return K.split_stratified(P.corpus(spark, d)).select(*KEY, "label", "is_train")


@query("class_weights", O.sql(
    "SELECT label, count(*) AS n_rows, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)::DOUBLE), 6) AS weight "
    "FROM corpus GROUP BY label"))
def class_weights(spark, d):
    return K.class_weights(P.corpus(spark, d)).select("label", "n_rows", r6(F.col("weight"), "weight"))


@query("sample_capped", O.sql(
    "SELECT source, seq, url, label FROM corpus ORDER BY md5(source || '|' || seq || '|42'), source, seq LIMIT 20000"))
def sample_capped(spark, d):
    return K.sample_capped(P.corpus(spark, d), by=KEY).select(*KEY, "url", "label")


# --- metrics ------------------------------------------------------------------------

@query("corpus_stats", O.sql(
    "SELECT count(*) AS n_total, count_if(label = 1) AS n_phishing, count_if(label = 0) AS n_legit, "
    "round(count_if(label = 1) / count_if(label = 0)::DOUBLE, 6) AS ratio, "
    "count(*) - count_if(source <> 'event') AS n_added FROM corpus"))
def corpus_stats(spark, d):
    c = P.corpus(spark, d)
    return K.corpus_stats(c, c.filter("source <> 'event'"))


PRED = {"pred": "SELECT *, CASE WHEN lex_prob >= 0.6e0 THEN 1 ELSE 0 END AS pred FROM lex_corpus"}


def _pred(spark, d) -> DataFrame:
    return FE.prepare(P.corpus(spark, d)).select("label", M.hard_label(M.heuristic_score(), 0.6).alias("pred"))


@query("confusion_matrix", O.sql("SELECT label, pred, count(*) AS n FROM pred GROUP BY ALL", PC, LEX, PRED))
def confusion_matrix(spark, d):
    return A.confusion_matrix(_pred(spark, d))


REPORT = {
    "cls": "SELECT c, count_if(label = c) AS support, count_if(pred = c) AS predicted, "
           "count_if(label = c AND pred = c) AS tp FROM pred, (VALUES (0), (1)) v(c) GROUP BY c",
    "cls2": "SELECT c, support, tp, CASE WHEN predicted = 0 THEN 0e0 ELSE tp / predicted::DOUBLE END AS precision, "
            "CASE WHEN support = 0 THEN 0e0 ELSE tp / support::DOUBLE END AS recall FROM cls",
    "cls3": "SELECT *, CASE WHEN precision + recall = 0 THEN 0e0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM cls2"}


@query("classification_report", O.sql(
    "SELECT c::VARCHAR AS name, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM cls3 "
    "UNION ALL SELECT 'accuracy', round(sum(tp) / sum(support)::DOUBLE, 6), round(sum(tp) / sum(support)::DOUBLE, 6), "
    "round(sum(tp) / sum(support)::DOUBLE, 6), sum(support)::BIGINT FROM cls3 "
    "UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), sum(support)::BIGINT FROM cls3 "
    "UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6), "
    "round(sum(f1 * support) / sum(support), 6), sum(support)::BIGINT FROM cls3", PC, LEX, PRED, REPORT))
def classification_report(spark, d):
    out = A.classification_report(_pred(spark, d))
    return out.select("name", *[r6(F.col(n), n) for n in ("precision", "recall", "f1")], "support")


@query("roc_auc", O.sql(
    "SELECT round(sum(CASE WHEN p.score > n.score THEN 1e0 * p.c * n.c WHEN p.score = n.score THEN 0.5e0 * p.c * n.c ELSE 0e0 END) "
    "/ sum(1e0 * p.c * n.c), 6) AS auc, (SELECT count(*) FROM scored WHERE label = 1) AS n_pos, "
    "(SELECT count(*) FROM scored WHERE label = 0) AS n_neg FROM "
    "(SELECT score, count(*) AS c FROM scored WHERE label = 1 GROUP BY score) p, "
    "(SELECT score, count(*) AS c FROM scored WHERE label = 0 GROUP BY score) n"))
def roc_auc(spark, d):
    return A.roc_auc(P.scored(spark, d)).select(r6(F.col("auc"), "auc"), "n_pos", "n_neg")


CURVE = {"curve": (
    "SELECT t.score AS threshold, count_if(s.label = 1)::DOUBLE / count(*) AS precision, "
    "count_if(s.label = 1)::DOUBLE / (SELECT count(*) FROM scored WHERE label = 1) AS recall "
    "FROM (SELECT DISTINCT score FROM scored) t JOIN scored s ON s.score >= t.score GROUP BY t.score")}
_F1 = "2 * precision * recall / greatest(precision + recall, 1e-9)"


@query("pr_curve", O.sql(
    "SELECT threshold, round(precision, 6) AS precision, round(recall, 6) AS recall FROM curve", CURVE))
def pr_curve(spark, d):
    return A.pr_curve(P.scored(spark, d)).select(
        "threshold", r6(F.col("precision"), "precision"), r6(F.col("recall"), "recall"))


_MAXF1 = f"(SELECT min(threshold) FROM curve WHERE {_F1} = (SELECT max({_F1}) FROM curve))"


@query("threshold_for_recall", O.sql(
    "SELECT CASE WHEN t = 0.5e0 THEN " + _MAXF1 + " ELSE t END AS threshold FROM "
    "(SELECT coalesce(max(CASE WHEN recall >= 0.99e0 THEN threshold END), 0.5e0) AS t FROM curve)", CURVE))
def threshold_for_recall(spark, d):
    return A.threshold_for_recall(P.scored(spark, d))


@query("threshold_max_f1", O.sql(
    f"SELECT {_MAXF1} AS threshold, (SELECT round(max({_F1}), 6) FROM curve) AS f1", CURVE))
def threshold_max_f1(spark, d):
    return A.threshold_max_f1(P.scored(spark, d)).select("threshold", r6(F.col("f1"), "f1"))


@query("acceptance_rates", O.sql(
    "SELECT round(avg(CASE WHEN label = 0 THEN CASE WHEN verdict <> 'Phishing' THEN 1e0 ELSE 0e0 END END), 6) AS legit_accepted, "
    "round(avg(CASE WHEN label = 1 THEN CASE WHEN verdict = 'Phishing' THEN 1e0 ELSE 0e0 END END), 6) AS phish_recall, "
    "count_if(label = 0) AS n_legit, count_if(label = 1) AS n_phishing FROM v_corpus", PC, LEX, RL, VC))
def acceptance_rates(spark, d):
    return A.acceptance_rates(V.hybrid_verdict(P.corpus(spark, d))).select(
        r6(F.col("legit_accepted"), "legit_accepted"), r6(F.col("phish_recall"), "phish_recall"),
        "n_legit", "n_phishing")


@query("verdict_stage_counts", O.sql(
    "SELECT stage, verdict, count(*) AS n FROM v_corpus GROUP BY ALL", PC, LEX, RL, VC))
def verdict_stage_counts(spark, d):
    return A.verdict_stage_counts(V.hybrid_verdict(P.corpus(spark, d)))


# --- corpus operations ------------------------------------------------------------------

@query("union_corpora", O.sql(
    "SELECT source, label, count(*) AS n, sum(length(url)) AS n_chars FROM corpus GROUP BY ALL"))
def union_corpora(spark, d):
    c = P.corpus(spark, d)
    parts = [c.filter(F.col("source") == s) for s in ("page", "link", "event")]
    return K.union_corpora(*parts).groupBy("source", "label").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("url")).alias("n_chars"))


@query("dedup_keep_first", O.sql(
    "SELECT url, label, priority, seq FROM corpus QUALIFY row_number() OVER (PARTITION BY url ORDER BY priority, seq) = 1"))
def dedup_keep_first(spark, d):
    return K.dedup_keep_first(P.corpus(spark, d))


@query("dedup_within_label", O.sql("SELECT DISTINCT url, label FROM corpus"))
def dedup_within_label(spark, d):
    return K.dedup_within_label(P.corpus(spark, d))


@query("label_conflicts", O.sql(
    "SELECT url, count_if(label = 1) AS n_phishing, count_if(label = 0) AS n_legit FROM "
    "(SELECT url, label FROM corpus UNION ALL SELECT url, 1 FROM pages WHERE contains(url, '?')) GROUP BY url "
    "HAVING count(DISTINCT label) > 1"))
def label_conflicts(spark, d):
    # Pages with a query, reported by a second feed as phishing.
    reported = P.load(spark, d, "pages").filter(F.col("url").contains("?")).select("url", F.lit(1).alias("label"))
    return K.label_conflicts(P.corpus(spark, d).select("url", "label").unionByName(reported))


@query("shuffle_seeded", O.sql(
    "SELECT source, seq, url, row_number() OVER (ORDER BY md5(source || '|' || seq || '|42'), source, seq) AS position FROM corpus"))
def shuffle_seeded(spark, d):
    return K.shuffled_position(P.corpus(spark, d).select(*KEY, "url"), by=KEY).select(*KEY, "url", "position")


# --- generators ---------------------------------------------------------------------------

def positions(n: str) -> str:
    return f"range(1, ({n}) + 1)"


def gen(name: str, fn, variants_sql: str, family: str, from_names: str = "names"):
    ctes = {"g": (f"SELECT brand, unnest(vs) AS variant, generate_subscripts(vs, 1) AS pos FROM "
                  f"(SELECT brand, {variants_sql} AS vs FROM {from_names})")}

    @query(name, O.sql(f"SELECT brand, '{family}' AS family, pos, variant FROM g", ctes))
    def run(spark, d):
        return fn(P.names(spark, d))
    return run


_OM = "substr(brand, 1, i - 1) || substr(brand, i + 1)"
_DU = "substr(brand, 1, i) || substr(brand, i)"
_SW = "substr(brand, 1, i - 1) || substr(brand, i + 1, 1) || substr(brand, i, 1) || substr(brand, i + 2)"
SQL_OM = f"list_transform({positions('length(brand)')}, lambda i: {_OM})"
SQL_DU = f"list_transform({positions('length(brand)')}, lambda i: {_DU})"
SQL_SW = f"list_transform({positions('length(brand) - 1')}, lambda i: {_SW})"


def sql_subs(table) -> str:
    cases: dict[str, list[str]] = {}
    for a, b in table:
        cases.setdefault(a, []).append(b)
    images = "CASE substr(brand, i, 1) " + " ".join(
        f"WHEN '{a}' THEN {O.lst(bs)}" for a, bs in cases.items()) + " ELSE []::VARCHAR[] END"
    return (f"flatten(list_transform({positions('length(brand)')}, lambda i: list_transform({images}, "
            f"lambda r: substr(brand, 1, i - 1) || r || substr(brand, i + 1))))")


BITS = [(c, r) for c, images in C.BITFLIPS for r in images]
SQL_LEET, SQL_HOMO, SQL_BIT = sql_subs(C.LEET), sql_subs(C.HOMOGRAPHS), sql_subs(BITS)


def sql_templates(ts) -> str:
    return f"list_transform({O.lst(ts)}, lambda t: replace(t, '{{brand}}', brand))"


COMBO_T = [t for w in C.COMBO_SQUAT_WORDS for t in ("{brand}" + w, "{brand}-" + w, w + "{brand}", w + "-{brand}")]
HYPH_T = [t for w in C.COMBO_WORDS[:15] for t in (w + "-{brand}", "{brand}-" + w)]
AFF_T = ([t for w in C.AFFIX_PREFIXES for t in (w + "{brand}", w + "-{brand}")]
         + [t for w in C.AFFIX_SUFFIXES for t in ("{brand}" + w, "{brand}-" + w)])
SUB_T = [t for w in C.SUBDOMAIN_PREFIXES for t in (w + ".{brand}", w + "-{brand}")]
ABUSE_T = [t for s in C.SUBDOMAIN_ABUSE_SUBS for tld in C.SUBDOMAIN_ABUSE_TLDS
           for t in (f"{s}.{{brand}}.{tld}", f"{{brand}}.{s}.{tld}")]
PATH_T = [f"http://{dom}.{tld}{p}" for dom in C.PATH_PHISH_DOMAINS for tld in C.SUSPICIOUS_TLDS[:5]
          for p in C.PATH_PHISH_PATHS]

gen("gen_swaps", G.swaps, SQL_SW, "swap")
gen("gen_omissions", G.omissions, SQL_OM, "omission")
gen("gen_duplications", G.duplications, SQL_DU, "duplication")
gen("gen_leet", G.leet, SQL_LEET, "leet")
gen("gen_homographs", G.homographs, SQL_HOMO, "homograph")
gen("gen_bitsquat", G.bitsquats, SQL_BIT, "bitsquat")
gen("gen_combo", G.combos, sql_templates(COMBO_T), "combo")
gen("gen_hyphenated", G.hyphenated, sql_templates(HYPH_T), "hyphenated")
gen("gen_affixes", G.affixes, sql_templates(AFF_T), "affix")
gen("gen_paths", G.paths, sql_templates(PATH_T), "path")


@query("gen_char_variants", O.sql(
    f"SELECT DISTINCT brand, unnest(list_concat({SQL_OM}, {SQL_DU}, {SQL_SW}, {sql_subs(C.LEET_SHORT)})) AS variant FROM names"))
def gen_char_variants(spark, d):
    return G.char_variants(P.names(spark, d)).select("brand", "variant")


@query("gen_subdomains", O.sql(
    f"SELECT brand, 'subdomain' AS family, unnest({sql_templates(SUB_T)}) AS variant FROM names UNION ALL "
    f"SELECT brand, 'subdomain_abuse', unnest({sql_templates(ABUSE_T)}) FROM names"))
def gen_subdomains(spark, d):
    n = P.names(spark, d)
    return G.subdomains(n).unionByName(G.subdomain_abuse(n)).select("brand", "family", "variant")


URG_T = [t for w in C.URGENCY_WORDS for tld in C.SUSPICIOUS_TLDS[:8]
         for t in (f"http://{w}-{{brand}}.{tld}/verify", f"http://{{brand}}-{w}.{tld}/confirm")]
CRY_T = [t for p in C.CRYPTO_PATTERNS for tld in C.SUSPICIOUS_TLDS[:6]
         for t in (f"http://{p.replace('{coin}', '{brand}')}.{tld}/claim",
                   f"https://{p.replace('{coin}', '{brand}')}.{tld}/connect")]


def capped(name: str, fn, templates, per_word: int, family: str):
    """Uncapped expansion over all names, and the first 200 flagged."""
    ctes = {"g": (f"SELECT brand, unnest(vs) AS variant, generate_subscripts(vs, 1) AS pos FROM "
                  f"(SELECT brand, {sql_templates(templates)} AS vs FROM names)"),
            "top": f"SELECT brand, pos FROM g ORDER BY floor((pos - 1) / {per_word}), brand, pos LIMIT 200"}

    @query(name, O.sql(
        f"SELECT g.brand AS brand, '{family}' AS family, g.pos AS pos, g.variant AS variant, t.brand IS NOT NULL AS in_cap "
        "FROM g LEFT JOIN top t ON t.brand = g.brand AND t.pos = g.pos", ctes))
    def run(spark, d):
        n = P.names(spark, d)
        top = fn(n, cap=200).select("brand", "pos", F.lit(True).alias("in_cap"))
        return fn(n).join(F.broadcast(top), ["brand", "pos"], "left").select(
            "brand", "family", "pos", "variant", F.coalesce("in_cap", F.lit(False)).alias("in_cap"))


capped("gen_urgency", G.urgency, URG_T, 16, "urgency")
capped("gen_crypto", G.crypto, CRY_T, 12, "crypto")


def sql_pick(values, key: str) -> str:
    return (f"list_extract({O.lst(values)}, ('0x' || substr(md5({key}), 1, 8))::BIGINT % {len(values)} + 1)")


_FH_HOST = sql_pick(C.FREE_HOSTING, "brand || '|host|42'")
_FH_WORD = sql_pick(C.COMBO_WORDS[:10], "brand || '|word|42'")
SQL_FREE = (f"['https://' || brand || '-' || {_FH_WORD} || '.' || {_FH_HOST} || '/login', "
            f"'https://' || {_FH_WORD} || '-' || brand || '.' || {_FH_HOST} || '/verify']")
SQL_FREE3 = (f"list_transform(list_sort(list_transform({O.lst(C.FREE_HOSTING)}, "
             "lambda h: md5(brand || '|' || h || '|42') || h))[1:3], "
             "lambda x: 'https://' || brand || '-secure.' || substr(x, 33) || '/login')")


@query("gen_free_hosting", O.sql(
    f"SELECT brand, 'free_hosting' AS family, unnest({SQL_FREE}) AS variant FROM names UNION ALL "
    f"SELECT brand, 'free_hosting_sampled', unnest({SQL_FREE3}) FROM names"))
def gen_free_hosting(spark, d):
    n = P.names(spark, d)
    return G.free_hosting(n).unionByName(G.free_hosting_sampled(n)).select("brand", "family", "variant")


# By family: how often a variant of a name may repeat is part of the result, so lists keep their order. The character-level
# union alone is distinct, first occurrence first.
SQL_CHAR0 = f"list_concat({SQL_OM}, {SQL_DU}, {SQL_SW}, {sql_subs(C.LEET_SHORT)})"
SQL_CHAR = f"list_filter({SQL_CHAR0}, lambda v, i: list_position({SQL_CHAR0}, v) = i)"
FAMS = {"swap": SQL_SW, "omission": SQL_OM, "duplication": SQL_DU, "leet": SQL_LEET, "homograph": SQL_HOMO,
        "bitsquat": SQL_BIT, "char": SQL_CHAR, "combo": sql_templates(COMBO_T), "hyphenated": sql_templates(HYPH_T),
        "affix": sql_templates(AFF_T), "subdomain": sql_templates(SUB_T), "subdomain_abuse": sql_templates(ABUSE_T),
        "path": sql_templates(PATH_T), "free_hosting": SQL_FREE, "free_hosting_sampled": SQL_FREE3}
ALLF = {"allf0": " UNION ALL ".join(
    f"SELECT brand, '{f}' AS family, unnest(vs) AS variant, generate_subscripts(vs, 1) AS pos FROM (SELECT brand, {q} AS vs FROM names)"
    for f, q in FAMS.items()),
    "allf": "SELECT * FROM allf0 WHERE pos <= CASE family "
    + " ".join(f"WHEN '{f}' THEN {n}" for f, n in G.FAMILY_CAPS.items()) + " ELSE 2147483647 END"}
_AKEY = "brand || '|' || family || '|' || pos || '|42'"
_URL = "CASE " + " ".join(
    f"WHEN family = '{f}' THEN '{scheme}://' || variant || '.' || {sql_pick(tlds, _AKEY)}"
    for f, (scheme, tlds) in G.ASSEMBLY.items()) + (
    " WHEN starts_with(variant, 'http') THEN variant WHEN family = 'subdomain' THEN 'https://' || variant || '.com' "
    "ELSE 'http://' || variant END AS url")
ASSEMBLED = {"assembled": f"SELECT brand, family, pos, variant, {_URL}, 1 AS label FROM allf0"}
GENERATED = {"generated": "SELECT family, url, label FROM assembled" + "".join(
    f" UNION ALL SELECT '{family}', unnest({sql_templates(ts)}), 1 FROM (SELECT unnest({O.lst(words)}) AS brand)"
    for family, ts, words in (("urgency", URG_T, C.URGENCY_TARGETS), ("crypto", CRY_T, C.CRYPTO_COINS)))}


@query("cap_per_group", O.sql("SELECT brand, family, pos, variant FROM allf", ALLF))
def cap_per_group(spark, d):
    return G.all_families(P.names(spark, d), G.FAMILY_CAPS)


@query("gen_assemble", O.sql("SELECT brand, family, pos, variant, url, label FROM assembled", ALLF, ASSEMBLED))
def gen_assemble(spark, d):
    return G.assemble(G.all_families(P.names(spark, d)))


# Rows and different URLs of each of the 17 generated families of the corpus.
@query("generated_family_counts", O.sql(
    "SELECT family, count(*) AS n_rows, count(DISTINCT url) AS n_urls FROM generated GROUP BY family", ALLF, ASSEMBLED, GENERATED))
def generated_family_counts(spark, d):
    by_url = G.generated_corpus(P.names(spark, d)).groupBy("family", "url").agg(F.count(F.lit(1)).alias("n"))
    return by_url.groupBy("family").agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_urls"))


def _path_pick(tag: str) -> str:
    return sql_pick(C.LEGIT_PATHS, f"domain || '|{tag}|42'")


_SUBPICK = sql_pick(C.LEGIT_SUBDOMAINS, "domain || '|sub|42'")
SQL_LEGIT = (f"['https://' || domain, 'https://' || domain || {_path_pick('p1')}, 'https://' || domain || {_path_pick('p2')}, "
             f"'https://' || {_SUBPICK} || '.' || domain, 'https://' || {_SUBPICK} || '.' || domain || {_path_pick('subpath')}]")
LEGITV = {"legitv": (
    "SELECT domain, unnest(vs) AS url, generate_subscripts(vs, 1) AS pos, 0 AS label FROM "
    f"(SELECT domain, {SQL_LEGIT} AS vs FROM bare)")}


@query("gen_legit_variations", O.sql("SELECT domain, pos, url, label FROM legitv", CORPUS2, BARE, LEGITV))
def gen_legit_variations(spark, d):
    return G.legit_variations(K.bare_domains(_with_bare(spark, d)))


def build_corpus(spark, d) -> DataFrame:
    """Feeds + new generated phishing + legitimate variations, first label wins."""
    base = feeds.union_feeds(_feeds(spark, d))
    # Generated URLs that a feed has already lose to it by priority.
    new = G.generated_corpus(P.names(spark, d)).select(
        "url", "label", F.lit("generated").alias("source"), F.lit(3).alias("priority"))
    legit = G.legit_variations(K.bare_domains(_with_bare(spark, d))).select(
        "url", "label", F.lit("variation").alias("source"), F.lit(4).alias("priority"))
    # Inside a source the first row wins, too: ``seq`` is its place there.
    both = K.union_corpora(base, new.withColumn("seq", F.lit(0).cast("long")),
                           legit.withColumn("seq", F.lit(0).cast("long")))
    return K.dedup_keep_first(both)


BUILD = {"built": (
    "SELECT url, label, priority FROM (SELECT url, label, priority, seq FROM feed_all UNION ALL "
    "SELECT url, label, 3, 0 FROM generated UNION ALL "
    "SELECT url, label, 4, 0 FROM legitv) QUALIFY row_number() OVER (PARTITION BY url ORDER BY priority, seq, label) = 1")}


@query("corpus_build", O.sql(
    "SELECT url, label, priority, md5(url || '|' || label || '|42') AS shuffle_key FROM built",
    UNION_FEEDS, CORPUS2, BARE, LEGITV, ALLF, ASSEMBLED, GENERATED, BUILD))
def corpus_build(spark, d):
    return K.shuffle_seeded(build_corpus(spark, d).select("url", "label", "priority"))


NAMES2 = {"names2": f"SELECT unnest({O.BR}) AS brand UNION SELECT brand FROM names",
          "vars": " UNION ALL ".join(
              f"SELECT brand, '{f}' AS family, unnest({FAMS[f]}) AS variant FROM names2"
              for f in ("swap", "omission", "duplication", "leet", "homograph", "bitsquat", "combo"))}


@query("detect_generated_squats", O.sql(
    "SELECT o.domain_base AS variant, v.brand AS brand, v.family AS family, o.n AS n_urls FROM "
    "(SELECT domain_base, count(*) AS n FROM p_corpus GROUP BY 1) o JOIN "
    "(SELECT DISTINCT brand, family, variant FROM vars WHERE variant NOT IN (SELECT brand FROM names2)) v "
    "ON v.variant = o.domain_base", PC, NAMES2))
def detect_generated_squats(spark, d):
    protected = dims.brands(spark).select("brand").unionByName(P.names(spark, d)).distinct()
    return G.detect_squats(hosts(spark, d), protected).select("variant", "brand", "family", "n_urls")


# --- navigation -------------------------------------------------------------------------------

NAVF = {"navf": "SELECT row_number() OVER () AS rid, * FROM nav WHERE frame_id = 0 AND regexp_matches(url, '(?i)^https?:')"}
PN, LN = O.parsed("navf"), O.lex_scores("navf")
RN, VN = O.rules("navf", base="lex_navf", browser=True), O.verdicts("navf", browser=True)


@query("nav_filter", O.sql("SELECT ts, tab_id, url FROM navf", NAVF))
def nav_filter(spark, d):
    return T.nav_filter(P.nav(spark, d)).select("ts", "tab_id", "url")


@query("nav_verdicts", O.sql(
    f"SELECT ts, tab_id, url, verdict, round(risk, 6) AS risk, stage, {O.notes_text(browser=True)} AS notes FROM vb_navf",
    NAVF, PN, LN, RN, VN))
def nav_verdicts(spark, d):
    return T.nav_verdicts(P.nav(spark, d)).select(
        "ts", "tab_id", "url", "verdict", r6(F.col("risk"), "risk"), "stage",
        F.array_join("notes", " | ").alias("notes"))


@query("nav_ttl_dedup", O.sql(
    "SELECT url, ts FROM chain",
    {"keyed": "SELECT DISTINCT regexp_extract(url, '^[a-z]+://[^/.]*', 0) AS url, ts FROM nav "
              "WHERE frame_id = 0 AND regexp_matches(url, '(?i)^https?:')",
     "chain": "SELECT url, min(ts) AS ts FROM keyed GROUP BY url UNION ALL "
              "SELECT url, ts FROM (SELECT c.url AS url, (SELECT min(k.ts) FROM keyed k WHERE k.url = c.url AND k.ts >= c.ts + INTERVAL 5 MINUTE) AS ts "
              "FROM chain c) WHERE ts IS NOT NULL"}).replace("WITH ", "WITH RECURSIVE ", 1))
def nav_ttl_dedup(spark, d):
    # Keyed by site so that keys repeat inside the TTL.
    nav = T.nav_filter(P.nav(spark, d)).withColumn(
        "url", F.regexp_extract("url", "^[a-z]+://[^/.]*", 0))
    return T.ttl_dedup(nav.select("url", "ts"))


@query("config_merge", O.sql(
    "SELECT u AS config_id, coalesce(p_enabled, true) AS enabled, true AS real_time_check, coalesce(p_mode, 'both') AS block_mode, "
    "true AS show_badge, 0.15e0 AS fast_path_safe, 0.85e0 AS fast_path_malicious, coalesce(p_safe, 0.33e0) AS safe_threshold, "
    "0.66e0 AS phishing_threshold FROM (SELECT user_id AS u, CASE WHEN max(event_id) % 2 = 0 THEN max(event_id) % 4 = 0 END AS p_enabled, "
    "CASE WHEN max(event_id) % 3 = 0 THEN 'block' END AS p_mode, CASE WHEN max(event_id) % 5 = 0 THEN 0.4e0 END AS p_safe "
    "FROM events GROUP BY user_id)", corpora=False))
def config_merge(spark, d):
    last = P.load(spark, d, "events").groupBy(F.col("user_id").alias("config_id")).agg(
        F.max("event_id").alias("e"))
    no_bool, no_num = F.lit(None).cast("boolean"), F.lit(None).cast("double")
    patch = last.select(
        "config_id", F.when(F.col("e") % 2 == 0, F.col("e") % 4 == 0).alias("enabled"),
        no_bool.alias("real_time_check"), F.when(F.col("e") % 3 == 0, "block").alias("block_mode"),
        no_bool.alias("show_badge"),
        F.struct(no_num.alias("fast_path_safe"), no_num.alias("fast_path_malicious"),
                 F.when(F.col("e") % 5 == 0, 0.4).alias("safe_threshold"),
                 no_num.alias("phishing_threshold")).alias("thresholds"))
    cfg = T.ResponseConfig()
    current = last.select(
        "config_id", *[F.lit(getattr(cfg, f)).alias(f) for f in T.CONFIG_FIELDS],
        F.struct(*[F.lit(cfg.thresholds[f]).alias(f) for f in T.THRESHOLD_FIELDS]).alias("thresholds"))
    return T.merge_config(current, patch).select("config_id", *T.CONFIG_FIELDS, "thresholds.*")


_PATCH = {"enabled": "CASE WHEN event_id % 4 = 0 THEN event_id % 8 = 0 END", "real_time_check": "CASE WHEN event_id % 36 = 0 THEN event_id % 72 = 0 END",
          "block_mode": "CASE WHEN event_id % 6 = 0 THEN CASE WHEN event_id % 12 = 0 THEN 'block' ELSE 'alert' END END",
          "show_badge": "CASE WHEN event_id % 10 = 0 THEN event_id % 20 = 0 END", "fast_path_safe": "CAST(NULL AS DOUBLE)",
          "fast_path_malicious": "CASE WHEN event_id % 14 = 0 THEN 0.9e0 END",
          "safe_threshold": "CASE WHEN event_id % 22 = 0 THEN 0.2e0 + event_id % 7 / 100e0 END", "phishing_threshold": "CASE WHEN event_id % 26 = 0 THEN 0.7e0 END"}
_START = {"enabled": "true", "real_time_check": "true", "block_mode": "'both'", "show_badge": "true", "fast_path_safe": "0.15e0",
          "fast_path_malicious": "0.85e0", "safe_threshold": "0.33e0", "phishing_threshold": "0.66e0"}


@query("nav_config_asof", O.sql(
    "SELECT event_id, " + ", ".join(f"coalesce(w_{f}, {_START[f]}) AS {f}" for f in _PATCH) + " FROM ("
    "SELECT *, " + ", ".join(f"last_value({f} IGNORE NULLS) OVER w AS w_{f}" for f in _PATCH) + " FROM ("
    "SELECT user_id % 5 AS k, ts, 0 AS kind, event_id, " + ", ".join(f"{x} AS {f}" for f, x in _PATCH.items())
    + " FROM events WHERE event_id % 2 = 0 UNION ALL "
    "SELECT user_id % 5, ts, 1, event_id, " + ", ".join("NULL" for _ in _PATCH) + " FROM events) "
    "WINDOW w AS (PARTITION BY k ORDER BY ts, kind, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) WHERE kind = 1",
    corpora=False))
def nav_config_asof(spark, d):
    events = P.load(spark, d, "events").select("event_id", "ts", (F.col("user_id") % 5).alias("config_id"))
    patches = events.filter("event_id % 2 = 0").select(
        "config_id", "ts", F.col("event_id").alias("patch_id"), *[F.expr(x).alias(f) for f, x in _PATCH.items()])
    return T.config_as_of(events, patches).select("event_id", *T.PATCH_FIELDS)


PL, LL = O.parsed("links"), O.lex_scores("links")
RLK, VL = O.rules("links", base="lex_links"), O.verdicts("links")


@query("verdict_site_reputation", O.sql(
    "SELECT source, seq, verdict, stage FROM (SELECT c.source, c.seq, CASE WHEN k.host IS NOT NULL THEN 'Safe' ELSE c.verdict END AS verdict, "
    "CASE WHEN k.host IS NOT NULL THEN 'whitelist' ELSE c.stage END AS stage FROM v_corpus c LEFT JOIN "
    "(SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host FROM pages) k "
    "ON k.host = c.host AND NOT c.is_malformed) WHERE stage = 'whitelist'", PC, LEX, RL, VC))
def verdict_site_reputation(spark, d):
    # The reputation table is the built-in list and the hosts of all pages.
    hosts_ = P.load(spark, d, "pages").select(F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("domain"))
    table = dims.whitelist(spark).unionByName(hosts_).distinct()
    return V.hybrid_verdict(P.corpus(spark, d), whitelist=table).filter("stage = 'whitelist'").select(*KEY, "verdict", "stage")


@query("page_link_verdicts", O.sql(
    "SELECT page_id, pos, url, verdict, round(risk, 6) AS risk, stage FROM v_links", PL, LL, RLK, VL))
def page_link_verdicts(spark, d):
    links = T.page_links(feeds.spread(P.load(spark, d, "pages"), P.PAGES))
    return V.hybrid_verdict(links).select("page_id", "pos", "url", "verdict", r6(F.col("risk"), "risk"), "stage")
