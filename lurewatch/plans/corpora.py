"""URL corpora derived from the given tables.

``corpus`` has a row per page, per page link and per event, so everything built
on it grows with ``pages`` and ``events``.  Event rows become URLs through fixed
templates that cover the cases the engine is about (look-alikes, free hosting,
shorteners, user info, ports, malformed hosts, missing schemes, ...).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import constants as C
from ..functions.settle import settle
from ..sources.feeds import spread
from ..streaming.nav import page_links

TABLES = ("pages", "events", "documents", "labels", "customer", "supplier", "embeddings")
TLDS = C.TRUSTED_TLDS + C.SUSPICIOUS_TLDS

#: One SQL expression per template; valid in Spark and in ANSI-style engines.
#: Names: b brand, t TLD, w / w2 words, h free host, n event id, uid, et, m md5.
TEMPLATES = (
    ("'https://www.' || b || '.com/' || et", 0),
    ("'http://' || b || '-login.top/signin?u=' || uid", 1),
    ("'http://secure-' || b || '.' || t || '/account'", 1),
    ("'http://' || substr(b, 1, k - 1) || substr(b, k + 1) || '.com/' || et || '/' || n", 1),
    ("'http://192.168.' || (uid % 256) || '.' || (n % 256) || ':8080/admin'", 1),
    ("'https://' || b || uid || '.netlify.app/login'", 1),
    ("'http://bit.ly/' || (n % 500)", None),
    ("'https://x.shop.' || b || '.co.uk/a%20b/index.php?x=1&y=' || uid", 0),
    ("'http://' || replace(replace(b, 'o', '0'), 'a', '4') || '.com//' || et", 1),
    ("'http://' || replace(replace(b, 'a', 'а'), 'o', 'о') || '.com/' || (n % 100)", 1),
    ("b || '.com'", 0),
    ("'http://evil' || uid || '.com@' || b || '.com/login'", 1),
    ("'HTTP://WWW.' || upper(b) || '.COM:443/' || upper(et) || ';jsessionid=' || uid", 0),
    ("'http://[abc' || (n % 1000) || '/x'", 1),
    ("'https://' || substr(m, 1, 10) || '.' || t || '/' || m || '?q=' || m || m || m || m", 1),
    ("'chrome://settings/' || uid", 0),
    ("'  https://news.' || b || '.com/a.b?x=%41%zz#frag  '", 0),
    ("'data:text/html,' || n", 1),
    ("'foo?x=http://' || b || '.com/' || uid", 1),
    ("'https://' || b || '-' || w || '.' || h || '/verify'", 1),
    ("'http://' || w || '-' || b || '-' || w2 || '.com/wp-admin/'", 1),
    ("'http://' || substr(b, 1, k - 1) || substr(b, k + 1, 1) || substr(b, k, 1) || substr(b, k + 2)"
     " || '-' || w || '.' || t", 1),
    ("'http://' || b || '.' || w || '.' || t || ':8443/reset/' || n || '.exe'", 1),
    ("'https://' || substr(b, 1, k) || substr(b, k) || '.' || t || '/' || w", 1),
)
N_TEMPLATES = len(TEMPLATES)
#: Pages of a task: they come with their html.
PAGES = 20_000


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _sql_list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _event_fields(at) -> list[str]:
    """Template inputs of one event; ``at(values, i)`` indexes a constant list."""
    big = "CAST(floor(event_id / {}) AS BIGINT)"
    q = big.format(N_TEMPLATES)
    q2 = big.format(N_TEMPLATES * len(C.BRANDS))
    return [
        "event_id AS n", "user_id AS uid", "event_type AS et", f"event_id % {N_TEMPLATES} AS tmpl",
        f"{q} AS q", "md5(CAST(event_id AS STRING)) AS m",
        f"{at(C.BRANDS, f'{q} % {len(C.BRANDS)}')} AS b",
        f"{at(TLDS, f'({q} * 7) % {len(TLDS)}')} AS t",
        f"{at(C.COMBO_WORDS, f'({q} * 3 + {q2}) % {len(C.COMBO_WORDS)}')} AS w",
        f"{at(C.COMBO_WORDS, f'({q} * 11 + {q2}) % {len(C.COMBO_WORDS)}')} AS w2",
        f"{at(C.FREE_HOSTING, f'{q} % {len(C.FREE_HOSTING)}')} AS h", f"{q2} AS q2"]


def _event_url_sql() -> tuple[str, str]:
    url = "CASE tmpl " + " ".join(
        f"WHEN {i} THEN {e}" for i, (e, _) in enumerate(TEMPLATES)) + " END"
    label = "CASE tmpl " + " ".join(
        f"WHEN {i} THEN {'CAST(q % 2 AS INT)' if lab is None else lab}"
        for i, (_, lab) in enumerate(TEMPLATES)) + " END"
    return url, label


#: 1-based edit position inside the brand, running over all of them.
_K = "CAST(q2 % length(b) AS INT) + 1 AS k"


def _spark_at(values, i):
    return f"element_at(array({_sql_list(values)}), CAST({i} AS INT) + 1)"


def event_urls(events: DataFrame) -> DataFrame:
    """(seq, url, label) per event."""
    fields = events.selectExpr(*_event_fields(_spark_at)).selectExpr("*", _K)
    url, label = _event_url_sql()
    return settle(fields.selectExpr("n AS seq", f"{url} AS url", f"{label} AS label"), "url", "label")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, priority, seq, url, label): pages, their links, event URLs."""
    pages = spread(load(spark, sf_dir, "pages"), PAGES)
    own = pages.select(F.lit("page").alias("source"), F.lit(0).alias("priority"),
                       F.col("page_id").alias("seq"), "url", F.lit(0).alias("label"))
    links = page_links(pages).select(
        F.lit("link").alias("source"), F.lit(1).alias("priority"),
        (F.col("page_id") * 100000 + F.col("pos")).alias("seq"), "url", F.lit(0).alias("label"))
    ev = event_urls(spread(load(spark, sf_dir, "events"))).select(
        F.lit("event").alias("source"), F.lit(2).alias("priority"), "seq", "url", "label")
    return own.unionByName(links).unionByName(ev)


def nav_events(events: DataFrame) -> DataFrame:
    """(ts, tab_id, frame_id, url) per event, batch or stream; views are main-frame."""
    fields = events.selectExpr("ts", *_event_fields(_spark_at)).selectExpr("*", _K)
    url, _ = _event_url_sql()
    return settle(fields.selectExpr(
        "ts", "uid AS tab_id", "CASE WHEN et = 'view' THEN 0 ELSE 1 END AS frame_id",
        f"{url} AS url"), "url")


def nav(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nav_events(spread(load(spark, sf_dir, "events")))


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Protected names: the site label of every page host."""
    host = F.regexp_extract("url", r"^[a-z]+://([^/?#:]*)", 1)
    labels = F.split(host, r"\.")
    label = F.coalesce(F.try_element_at(labels, F.lit(-3)), F.try_element_at(labels, F.lit(-2)),
                       F.try_element_at(labels, F.lit(-1)))
    return load(spark, sf_dir, "pages").select(label.alias("brand")).distinct()


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, label, score) with many ties: documents joined with labels."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "n_chars")
    labs = load(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return docs.join(labs, "doc_id").select(
        "doc_id", "label", F.round(F.pmod("n_chars", F.lit(1000)) / 1000.0, 3).alias("score"))


# --- the same corpora for the comparison engine -----------------------------

def _duck_at(values, i):
    return f"list_extract([{_sql_list(values)}], CAST({i} AS INT) + 1)"


def duck_corpora() -> dict[str, str]:
    """Named sub-queries (insertion order is dependency order)."""
    url, label = _event_url_sql()
    return {
        "ev_urls": (
            f"SELECT n AS seq, {url} AS url, {label} AS label FROM (SELECT *, {_K} FROM "
            f"(SELECT {', '.join(_event_fields(_duck_at))} FROM events))"),
        "links": (
            "SELECT page_id, pos, CASE "
            "WHEN href LIKE '//%' THEN regexp_extract(o, '^([^:]*:)', 1) || href "
            "WHEN href LIKE '/%' THEN o || href ELSE href END AS url FROM ("
            "SELECT page_id, o, unnest(hrefs) AS href, generate_subscripts(hrefs, 1) - 1 AS pos FROM ("
            "SELECT page_id, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*)', 1) AS o, "
            "regexp_extract_all(html, 'href=\"([^\"]+)\"', 1) AS hrefs FROM pages))"),
        "corpus": (
            "SELECT 'page' AS source, 0 AS priority, page_id AS seq, url, 0 AS label FROM pages "
            "UNION ALL SELECT 'link', 1, page_id * 100000 + pos, url, 0 FROM links "
            "UNION ALL SELECT 'event', 2, seq, url, label FROM ev_urls"),
        "nav": (
            "SELECT e.ts AS ts, e.user_id AS tab_id, "
            "CASE WHEN e.event_type = 'view' THEN 0 ELSE 1 END AS frame_id, u.url AS url "
            "FROM events e JOIN ev_urls u ON u.seq = e.event_id"),
        "names": (
            "SELECT DISTINCT coalesce(list_extract(l, -3), list_extract(l, -2), list_extract(l, -1)) AS brand FROM "
            "(SELECT string_split(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1), '.') AS l FROM pages)"),
        "scored": (
            "SELECT d.doc_id, l.quality AS label, round((d.n_chars % 1000) / 1000.0::DOUBLE, 3) "
            "AS score FROM documents d JOIN labels l ON l.doc_id = d.doc_id"),
    }
