"""Registered queries that train models, read images or run streams."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from ..functions import features as FE
from ..functions import urls as U
from ..functions.settle import settle
from ..functions.constants import FEATURE_NAMES
from ..operators import training as TR
from ..operators import verdict as V
from ..operators import vision as VI
from ..operators.joins import salted_join
from ..operators.scoring import score_equal
from ..sources import feeds
from ..streaming import nav as T
from . import corpora as P
from . import images
from . import oracle as O
from .registry import KEY, LN, NAVF, ORACLE, PC, PN, RN, VN, query, r6


@lru_cache(maxsize=4)
def _featured(spark, d) -> DataFrame:
    """Well-formed URLs and their features, computed once for the fits and the scoring of a session and kept on disk.

    Other columns stay out: rows are dealt out by their content, and a forest draws them by their place.
    """
    parsed = U.parse_url_columns(P.corpus(spark, d)).select("url", "label", "is_malformed")
    rows = settle(parsed, "is_malformed").filter("not is_malformed").select("url", "label")
    return TR.featured(rows).persist(StorageLevel.DISK_ONLY)


def _labelled(spark, d) -> DataFrame:
    return _featured(spark, d)


@lru_cache(maxsize=4)
def _fitted(spark, d, kind: str) -> TR.TrainResult:
    """One fit of a kind serves all queries of a session on the same tables."""
    return TR.train(_labelled(spark, d), kind)


def _summary(result) -> DataFrame:
    """What is exact about a fit, and whether it ranks well enough."""
    return result.summary.select("n_samples", "n_features", "model_type", (F.col("auc") >= 0.9).alias("ranks_well"),
                                 F.col("threshold").between(0, 1).alias("threshold_in_range"))


def _summary_sql(kind: str) -> str:
    return O.sql(f"SELECT count(*) AS n_samples, {len(FEATURE_NAMES)} AS n_features, '{kind}' AS model_type, true AS ranks_well, "
                 "true AS threshold_in_range FROM p_corpus WHERE NOT is_malformed", PC)


@query("ml_train_gbt", _summary_sql("gbt"))
def ml_train_gbt(spark, d):
    return _summary(_fitted(spark, d, "gbt"))


@query("ml_train_rf", _summary_sql("random_forest"))
def ml_train_rf(spark, d):
    return _summary(_fitted(spark, d, "random_forest"))


@query("feature_importance_topk")
def feature_importance_topk(spark, d):
    return _fitted(spark, d, "random_forest").top_features


@query("train_report")
def train_report(spark, d):
    return _fitted(spark, d, "gbt").report


@query("ml_score_batch")
def ml_score_batch(spark, d):
    model = _fitted(spark, d, "random_forest").model
    urls = _featured(spark, d).select("url", "features")
    scores = score_equal(urls, model).groupBy("url").agg(F.max("lex_prob").alias("score"))
    scored = salted_join(P.corpus(spark, d).select(*KEY, "url"), scores, "url", keys=urls)
    return V.hybrid_verdict(scored, scorer=F.col("score")).select(
        *KEY, "url", "verdict", r6(F.col("risk"), "risk"), r6(F.col("lex_prob"), "lex_prob"), "stage")


@query("model_metadata", O.sql(
    f"SELECT {len(FEATURE_NAMES)} AS n_features, 'random_forest' AS model_type, true AS ranks_well, {len(FEATURE_NAMES)} AS n_names, "
    f"'{FEATURE_NAMES[0]}' AS first_name, '{FEATURE_NAMES[-1]}' AS last_name, {len(FEATURE_NAMES)} AS n_importances"))
def model_metadata(spark, d):
    path = feeds.work_dir(spark, "model")
    TR.save_model(_fitted(spark, d, "random_forest"), path)
    TR.load_scorer(spark, path)  # refuses a model with other features
    meta = TR.load_metadata(spark, path)
    return meta.select("n_features", "model_type", (F.col("auc") >= 0.9).alias("ranks_well"),
                       F.size("features").alias("n_names"), F.element_at("features", 1).alias("first_name"),
                       F.element_at("features", -1).alias("last_name"), F.size("feature_importances").alias("n_importances"))


# --- images ------------------------------------------------------------------

#: Pictures that a task writes.
PICTURES = 5_000


def _shots(spark, d) -> str:
    root = feeds.work_dir(spark, "shots")
    images.write_pngs(feeds.spread(P.load(spark, d, "embeddings"), PICTURES), root).write.format("noop").mode(
        "overwrite").save()
    return root


_SHOT = "CASE WHEN vec_id % 2 = 0 THEN 'legit/' ELSE 'phish/' END || vec_id || '.png' AS path"


@query("scan_screenshots", O.sql(f"SELECT {_SHOT}, vec_id % 2 AS label, true AS has_bytes FROM embeddings", corpora=False))
def scan_screenshots(spark, d):
    shots = feeds.read_screenshots(spark, _shots(spark, d))
    return shots.select(F.regexp_extract("path", "/((?:legit|phish)/[^/]*)$", 1).alias("path"),
                        "label", (F.col("length") > 57).alias("has_bytes"))


# Every picture has a darkest and a lightest point, so the ends of its values are known.
@query("image_prep", O.sql(
    f"SELECT {_SHOT}, vec_id % 2 AS label, 150528 AS n_values, -2.1179e0 AS low, 2.4286e0 AS high FROM embeddings", corpora=False))
def image_prep(spark, d):
    shots = VI.read_images(spark, _shots(spark, d))
    ready = VI.prepare_images(shots)
    return ready.select(
        F.regexp_extract("path", "/((?:legit|phish)/[^/]*)$", 1).alias("path"), "label",
        F.size("tensor").alias("n_values"), F.round(F.array_min("tensor").cast("double"), 4).alias("low"),
        F.round(F.array_max("tensor").cast("double"), 4).alias("high"))


def _brightness(x):
    """A stand-in for a visual model: the mean of the normalised values, squashed."""
    return 1 / (1 + np.exp(-x.mean(axis=(1, 2, 3), dtype=np.float64)))


@query("score_screenshots", O.sql(
    f"SELECT {_SHOT}, round(1 / (1 + exp(-list_avg(list_transform(g, lambda p: ((p / 255 - 0.485e0) / 0.229e0 + "
    "((255 - p) / 255 - 0.456e0) / 0.224e0 + (floor(p / 2) / 255 - 0.406e0) / 0.225e0) / 3)))), 2) AS prob, true AS ok FROM ("
    "SELECT vec_id, list_transform(v, lambda x: floor((x - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1 END * 255)) AS g FROM ("
    "SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v, CAST(list_min(embedding) AS DOUBLE) AS lo, "
    "CAST(list_max(embedding) AS DOUBLE) AS hi FROM embeddings))", corpora=False))
def score_screenshots(spark, d):
    scored = VI.score_images(VI.read_images(spark, _shots(spark, d)), _brightness)
    return scored.select(F.regexp_extract("path", "/((?:legit|phish)/[^/]*)$", 1).alias("path"),
                         F.round("prob", 2).alias("prob"), "ok")


# --- streams --------------------------------------------------------------------

def _nav_stream(spark, d) -> DataFrame:
    schema = P.load(spark, d, "events").schema
    events = T.read_nav_stream(spark, d, schema, glob="events.parquet")
    return P.nav_events(events).withColumn("ts", F.col("ts").cast("timestamp"))


def _run(stream: DataFrame, name: str) -> DataFrame:
    spark = stream.sparkSession
    base = feeds.work_dir(spark, name)
    q = T.run_to_table(stream, f"{base}/out", f"{base}/checkpoint")
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


@query("stream_nav_source", O.sql("SELECT ts, tab_id, frame_id, url FROM nav"))
def stream_nav_source(spark, d):
    return _run(_nav_stream(spark, d), "nav-source")


@query("stream_nav_filter", ORACLE["nav_filter"])
def stream_nav_filter(spark, d):
    return _run(T.nav_filter(_nav_stream(spark, d)), "nav-filter").select("ts", "tab_id", "url")


@query("stream_verdicts", ORACLE["nav_verdicts"])
def stream_verdicts(spark, d):
    return _run(T.nav_verdicts(_nav_stream(spark, d)), "nav-verdicts").select(
        "ts", "tab_id", "url", "verdict", r6(F.col("risk"), "risk"), "stage",
        F.array_join("notes", " | ").alias("notes"))


@query("stream_ttl_dedup", ORACLE["nav_ttl_dedup"])
def stream_ttl_dedup(spark, d):
    sites = T.nav_filter(_nav_stream(spark, d)).withColumn(
        "url", F.regexp_extract("url", "^[a-z]+://[^/.]*", 0))
    return _run(T.ttl_dedup_stream(sites), "nav-ttl")


def _actions(spark, d, ttl_seconds=None, **switches) -> str:
    base = feeds.work_dir(spark, "nav-actions")
    T.run_actions(_nav_stream(spark, d), f"{base}/verdicts", f"{base}/alerts", f"{base}/checkpoint",
                  lambda: T.ResponseConfig(**switches), ttl_seconds).awaitTermination()
    return base


@query("stream_actions_without_badge", O.sql(
    "SELECT ts, tab_id, url, verdict, false AS should_block, false AS should_alert FROM vb_navf", NAVF, PN, LN, RN, VN))
def stream_actions_without_badge(spark, d):
    return spark.read.parquet(f"{_actions(spark, d, show_badge=False)}/verdicts").select(
        "ts", "tab_id", "url", "verdict", "should_block", "should_alert")


@query("stream_actions_alert_only", O.sql(
    "SELECT ts, tab_id, url, verdict, false AS should_block, verdict IN ('Phishing', 'Suspicious') AS should_alert FROM vb_navf",
    NAVF, PN, LN, RN, VN))
def stream_actions_alert_only(spark, d):
    return spark.read.parquet(f"{_actions(spark, d, block_mode='alert')}/verdicts").select(
        "ts", "tab_id", "url", "verdict", "should_block", "should_alert")


@query("stream_actions", O.sql(
    "SELECT ts, tab_id, url, verdict, true AS should_block, true AS should_alert FROM vb_navf "
    "WHERE verdict IN ('Phishing', 'Suspicious')", NAVF, PN, LN, RN, VN))
def stream_actions(spark, d):
    base = feeds.work_dir(spark, "nav-actions")
    q = T.run_actions(_nav_stream(spark, d), f"{base}/verdicts", f"{base}/alerts", f"{base}/checkpoint")
    q.awaitTermination()
    return spark.read.parquet(f"{base}/alerts").select(
        "ts", "tab_id", "url", "verdict", "should_block", "should_alert")


# A day between analyses, so that the TTL holds back many events of the table.
@query("stream_actions_ttl", O.sql(
    "SELECT c.ts, t.tab_id, c.url, v.verdict, v.verdict IN ('Phishing', 'Suspicious') AS should_block, "
    "v.verdict IN ('Phishing', 'Suspicious') AS should_alert FROM chain c JOIN times t ON t.url = c.url AND t.ts = c.ts "
    "JOIN (SELECT DISTINCT url, verdict FROM vb_navf) v ON v.url = c.url", NAVF, PN, LN, RN, VN,
    {"times": "SELECT url, ts, min(tab_id) AS tab_id FROM navf GROUP BY url, ts",
     "chain": "SELECT url, min(ts) AS ts FROM times GROUP BY url UNION ALL "
              "SELECT url, ts FROM (SELECT c.url AS url, (SELECT min(k.ts) FROM times k WHERE k.url = c.url AND k.ts >= c.ts + INTERVAL 1 DAY) AS ts "
              "FROM chain c) WHERE ts IS NOT NULL"}).replace("WITH ", "WITH RECURSIVE ", 1))
def stream_actions_ttl(spark, d):
    """Filter, TTL, verdicts and actions of the live checker in their order."""
    return spark.read.parquet(f"{_actions(spark, d, ttl_seconds=86_400)}/verdicts").select(
        "ts", "tab_id", "url", "verdict", "should_block", "should_alert")
