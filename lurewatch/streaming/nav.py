"""Navigation events: filters, verdicts, TTL re-analysis and response actions.

Everything but the TTL state is a narrow expression shared by batch and
stream.  Event schema: ``ts timestamp, tab_id bigint, frame_id int, url string``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import partial, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.verdict import DEFAULT_CONFIG, Config, browser_verdict, display_fields, response_actions

NAV_SCHEMA = "ts timestamp, tab_id bigint, frame_id int, url string"
TTL_SECONDS = 300


@dataclass(frozen=True)
class ResponseConfig:
    """Switches of the live checker. Fixed default values."""

    enabled: bool = True
    real_time_check: bool = True
    block_mode: str = "both"
    show_badge: bool = True
    thresholds: dict = field(default_factory=lambda: {
        "fast_path_safe": 0.15, "fast_path_malicious": 0.85,
        "safe_threshold": 0.33, "phishing_threshold": 0.66})

    def cascade(self) -> Config:
        return Config(**{**DEFAULT_CONFIG.__dict__, **self.thresholds})


CONFIG_FIELDS = ("enabled", "real_time_check", "block_mode", "show_badge")
THRESHOLD_FIELDS = ("fast_path_safe", "fast_path_malicious", "safe_threshold", "phishing_threshold")


def read_nav_stream(spark: SparkSession, path: str, schema: str = NAV_SCHEMA,
                    glob: str | None = None, max_files: int = 100) -> DataFrame:
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path)


def nav_filter(df: DataFrame, cfg: ResponseConfig = ResponseConfig()) -> DataFrame:
    """Main-frame http/https navigations while live checking is on."""
    if not (cfg.enabled and cfg.real_time_check):
        return df.filter(F.lit(False))
    return df.filter((F.col("frame_id") == 0) & F.col("url").isNotNull()
                     & F.col("url").rlike("(?i)^https?:"))


def nav_verdicts(df: DataFrame, cfg: ResponseConfig = ResponseConfig(), **kwargs) -> DataFrame:
    return browser_verdict(nav_filter(df, cfg), cfg.cascade(), **kwargs)


def nav_actions(df: DataFrame, cfg: ResponseConfig = ResponseConfig()) -> DataFrame:
    """Badge and block / alert columns for verdict rows; without a badge no row acts, none is lost."""
    out = response_actions(display_fields(df), cfg.block_mode)
    if cfg.show_badge:
        return out
    return out.withColumns({"should_block": F.lit(False), "should_alert": F.lit(False), "badge_text": F.lit(""),
                            "warning_url": F.lit(None).cast("string")})


def merge_config(current: DataFrame, patch: DataFrame, key: str = "config_id") -> DataFrame:
    """Apply partial updates: absent (NULL) fields keep their value.

    ``thresholds`` is merged field by field.  The patch has one row per key.
    """
    joined = current.alias("c").join(patch.alias("p"), key, "left")

    def pick(path: str):
        return F.coalesce(F.col(f"p.{path}"), F.col(f"c.{path}"))

    return joined.select(
        key, *[pick(f).alias(f) for f in CONFIG_FIELDS],
        F.struct(*[pick(f"thresholds.{f}").alias(f) for f in THRESHOLD_FIELDS]).alias("thresholds"))


#: Fields of a configuration patch as flat columns.
PATCH_FIELDS = CONFIG_FIELDS + THRESHOLD_FIELDS
BUCKET_SECONDS = 3600


def config_as_of(events: DataFrame, patches: DataFrame, start: ResponseConfig = ResponseConfig(),
                 key: str = "config_id", bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """``events`` with the configuration of their ``key`` in force at their ``ts``, one column for each field.

    ``patches`` has ``key``, ``patch_id``, ``ts`` and ``PATCH_FIELDS``, NULL where a patch leaves a field as it is.
    Of two patches at one time the one with the larger ``patch_id`` is the later; a patch at the time of an event holds for
    it.  Before the first patch of a field ``start`` holds; an event with a NULL time gets ``start``; patches with a NULL time are void.

    An as-of join by time buckets: a bucket's events and patches meet in one sorted pass (a running window, so that even a
    busy key holds no more than one bucket's rows in a task and keeps one row in memory), and what was in force when the bucket began is
    carried over a table with one row for each key and bucket.
    """
    def bucket() -> Column:
        return F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (bucket_seconds * 1_000_000)).cast("long")

    clash = [c for c in events.columns if c in PATCH_FIELDS]
    row = F.struct(*[F.col(f"`{c}`") for c in events.columns]).alias("_row")
    seen = events.select(F.col(key).alias("_k"), bucket().alias("_b"), F.col("ts").alias("_t"), row)
    given = patches.filter(F.col("ts").isNotNull()).select(
        F.col(key).alias("_k"), bucket().alias("_b"), F.col("ts").alias("_t"), F.col("patch_id").cast("long").alias("_p"), *PATCH_FIELDS)
    latest = given.groupBy("_k", "_b").agg(*[
        F.max(F.when(F.col(f).isNotNull(), F.struct("_t", "_p", f)))[f].alias(f) for f in PATCH_FIELDS])
    buckets = seen.select("_k", "_b").filter(F.col("_b").isNotNull()).distinct().unionByName(latest, allowMissingColumns=True)
    buckets = buckets.groupBy("_k", "_b").agg(*[F.max(f).alias(f) for f in PATCH_FIELDS])
    before = Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = buckets.select("_k", "_b", *[F.last(f, True).over(before).alias(f) for f in PATCH_FIELDS])
    parts = (carried.withColumn("_kind", F.lit(0)).unionByName(given.withColumn("_kind", F.lit(1)), allowMissingColumns=True)
             .unionByName(seen.withColumn("_kind", F.lit(2)), allowMissingColumns=True))
    upto = Window.partitionBy("_k", "_b").orderBy(F.col("_t").asc_nulls_first(), "_kind", "_p").rowsBetween(Window.unboundedPreceding, 0)
    first = {f: getattr(start, f) for f in CONFIG_FIELDS} | dict(start.thresholds)
    held = parts.select("_kind", "_row", *[
        F.coalesce(F.last(f, True).over(upto), F.lit(first[f])).alias(f"_in_{f}") for f in PATCH_FIELDS])
    return held.filter("_kind = 2").select(
        *[F.col(f"_row.`{c}`") for c in events.columns if c not in clash], *[F.col(f"_in_{f}").alias(f) for f in PATCH_FIELDS])


# --- TTL: a URL is analysed again only when its last analysis is old enough ---

def ttl_dedup_stream(df: DataFrame, ttl_seconds: int = TTL_SECONDS,
                     lateness: str = "10 minutes") -> DataFrame:
    """Analyses per URL on a stream; hits inside the TTL do not refresh it.

    State per URL is one timestamp, dropped by event-time timeout once no event
    in time could still fall inside the TTL.
    """
    ttl_us = ttl_seconds * 1_000_000

    def step(key, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        # Eight bytes for each event; the chain then hops from analysis to analysis.
        parts = [np.unique(pdf["ts"].to_numpy("datetime64[us]").astype("int64")) for pdf in batches]
        stamps = np.unique(np.concatenate(parts)) if parts else np.zeros(0, "int64")
        found, at = [], 0 if last is None else int(np.searchsorted(stamps, last + ttl_us))
        while at < len(stamps):
            last = int(stamps[at])
            found.append(last)
            at = int(np.searchsorted(stamps, last + ttl_us))
        state.update((last,))
        expiry = last // 1000 + ttl_seconds * 1000
        state.setTimeoutTimestamp(max(expiry, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"url": [key[0]] * len(found),
                            "ts": pd.to_datetime(pd.Series(found, dtype="int64"), unit="us")})

    watermarked = df.select("url", "ts").withWatermark("ts", lateness)
    return watermarked.groupBy("url").applyInPandasWithState(
        step, "url string, ts timestamp", "last bigint", "append",
        GroupStateTimeout.EventTimeTimeout)


def ttl_dedup(df: DataFrame, ttl_seconds: int = TTL_SECONDS, hot_rows: int = 2_000) -> DataFrame:
    """Batch twin of the TTL cache: one row per analysis (url, ts).

    URLs with at most ``hot_rows`` distinct times are folded as one sorted array
    each.  Busier URLs never meet in one task: every event gets a pointer to the
    first event at least one TTL later (a merge inside (url, TTL bucket)), and
    the chain from the first event is found by pointer doubling.
    """
    ttl_us = ttl_seconds * 1_000_000
    times = (df.filter(F.col("url").isNotNull() & F.col("ts").isNotNull())
             .select("url", F.unix_micros(F.col("ts").cast("timestamp")).alias("t")).distinct())
    as_times = partial(_as_times, ts_type=dict(df.dtypes)["ts"])
    sizes = times.groupBy("url").agg(F.count(F.lit(1)).alias("_n"))
    hot_urls = sizes.filter(F.col("_n") > hot_rows).select("url")
    if hot_urls.isEmpty():
        return as_times(_fold_chain(times, ttl_us))
    from ..operators.joins import broadcast_if_small

    hot_urls = broadcast_if_small(hot_urls)
    cold = times.join(hot_urls, "url", "left_anti")
    hot = times.join(hot_urls, "url", "left_semi")
    return as_times(_fold_chain(cold, ttl_us).unionByName(_double_chain(hot, ttl_us)))


def _as_times(df: DataFrame, ts_type: str) -> DataFrame:
    return df.select("url", F.timestamp_micros("t").cast(ts_type).alias("ts"))


def _fold_chain(times: DataFrame, ttl_us: int) -> DataFrame:
    last = F.element_at
    chain = F.aggregate(
        F.array_sort(F.collect_list("t")), F.array().cast("array<bigint>"),
        lambda acc, t: F.when((F.size(acc) == 0) | (t - last(acc, -1) >= ttl_us),
                              F.concat(acc, F.array(t))).otherwise(acc))
    return times.groupBy("url").agg(chain.alias("_c")).select("url", F.explode("_c").alias("t"))


def _double_chain(times: DataFrame, ttl_us: int) -> DataFrame:
    """Chain members of busy URLs by pointer doubling (``times`` is distinct)."""
    from ..sources.feeds import work_dir

    spark = times.sparkSession

    def saved(df: DataFrame, name: str) -> DataFrame:
        # Reused several times; a written table also cuts the lineage.
        path = work_dir(spark, f"ttl-{name}")
        df.write.parquet(path)
        return spark.read.parquet(path)

    events = times.withColumn("_b", F.floor(F.col("t") / ttl_us))
    # First event of the next non-empty bucket; rows per URL = buckets, not events.
    firsts = events.groupBy("url", "_b").agg(F.min("t").alias("_first"))
    w = Window.partitionBy("url").orderBy("_b")
    firsts = firsts.withColumn("_next_b", F.lead("_b").over(w)).withColumn(
        "_next_first", F.lead("_first").over(w))
    # Probe t + ttl lies in the following bucket: look for an event there ...
    probes = events.select("url", (F.col("_b") + 1).alias("_b"), (F.col("t") + ttl_us).alias("_k"),
                           F.col("t").alias("_probe"), F.lit(None).cast("bigint").alias("_e"))
    targets = events.select("url", "_b", F.col("t").alias("_k"),
                            F.lit(None).cast("bigint").alias("_probe"), F.col("t").alias("_e"))
    # ... events sort after a probe of the same time, so going down they come first.
    down = (Window.partitionBy("url", "_b")
            .orderBy(F.col("_k").desc(), F.col("_probe").isNotNull())
            .rowsBetween(Window.unboundedPreceding, 0))
    near = (probes.unionByName(targets).withColumn("_hit", F.min("_e").over(down))
            .filter(F.col("_probe").isNotNull()).select("url", "_b", "_probe", "_hit"))
    # ... else the first event of the first non-empty bucket after it.
    own = near.withColumn("_own", F.col("_b") - 1)
    step1 = own.join(firsts.select("url", F.col("_b").alias("_own"), "_next_b", "_next_first"),
                     ["url", "_own"])
    step2 = step1.join(firsts.select("url", "_b", F.col("_next_first").alias("_after")),
                       ["url", "_b"], "left")
    nxt = F.coalesce("_hit", F.when(F.col("_next_b") > F.col("_b"), F.col("_next_first"))
                     .otherwise(F.col("_after")))
    jump = saved(step2.select("url", F.col("_probe").alias("t"), nxt.alias("nxt")), "jump")
    span = jump.agg(F.max("t").alias("hi"), F.min("t").alias("lo")).first()
    hops = (span["hi"] - span["lo"]) // ttl_us + 1
    reached = jump.groupBy("url").agg(F.min("t").alias("t"))
    done = 1
    while done <= hops:
        ahead = reached.join(jump, ["url", "t"]).filter(F.col("nxt").isNotNull()).select(
            "url", F.col("nxt").alias("t"))
        reached = saved(reached.unionByName(ahead).distinct(), "reached")
        done *= 2
        if done <= hops:
            far = jump.select("url", F.col("t").alias("nxt"), F.col("nxt").alias("_far"))
            jump = saved(jump.join(far, ["url", "nxt"], "left").select(
                "url", "t", F.col("_far").alias("nxt")), "jump")
    return reached


# --- sinks -----------------------------------------------------------------

def configured(spark: SparkSession, patches: DataFrame | None = None,
               start: ResponseConfig = ResponseConfig()) -> ResponseConfig:
    """``start`` with one row of partial updates (``merge_config``) applied."""
    if patches is None:
        return start
    fields = ", ".join(["config_id int", *(f"{f} {'string' if f == 'block_mode' else 'boolean'}" for f in CONFIG_FIELDS),
                        "thresholds struct<" + ", ".join(f"{f}: double" for f in THRESHOLD_FIELDS) + ">"])
    current = spark.createDataFrame([(0, *(getattr(start, f) for f in CONFIG_FIELDS),
                                      tuple(start.thresholds[f] for f in THRESHOLD_FIELDS))], fields)
    row = merge_config(current, patches.withColumn("config_id", F.lit(0))).first()
    return ResponseConfig(*(row[f] for f in CONFIG_FIELDS), thresholds=row["thresholds"].asDict())


def due(batch: DataFrame, last: DataFrame | None, ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    """``(url, ts)`` of a batch whose last analysis is old enough; ``last`` has one ``ts`` for each URL.

    The last analysis opens the chain of its URL, so the batch twin of the TTL
    cache, with its split path for busy URLs, does the work.
    """
    times = batch.select("url", "ts")
    if last is None:
        return ttl_dedup(times, ttl_seconds)
    # Only what is known of the URLs of this batch takes part.
    last = last.select("url", "ts").join(times.select("url").distinct(), "url", "left_semi")
    known = last.select("url", F.col("ts").alias("_last"))
    fresh = times.join(known, "url", "left").filter(F.col("_last").isNull() | (F.col("ts") > F.col("_last"))).select("url", "ts")
    chain = ttl_dedup(fresh.unionByName(last), ttl_seconds)
    return chain.join(last, ["url", "ts"], "left_anti")


#: Micro-batches after which the analyses since the last folding become one table again.
FOLD = 32
LATENESS_SECONDS = 600


class LastAnalyses:
    """When each URL was last analysed, as tables below ``path`` that survive executors and restarts.

    A micro-batch writes its own analyses only.  Every ``fold`` batches the tables since the last folding are
    folded, one row for each URL, and URLs whose analysis is older than the TTL and ``lateness`` seconds before the latest one
    are dropped: no event in time could be inside their TTL.  An event that comes even later counts as that of an unknown
    URL.  Folders are overwritten when a batch is repeated.
    """

    SCHEMA = "url string, ts timestamp"

    def __init__(self, spark: SparkSession, path: str, ttl_seconds: int, fold: int = FOLD, lateness: int = LATENESS_SECONDS):
        self.spark, self.path, self.keep, self.fold = spark, path, ttl_seconds + lateness, fold

    def _since(self, first: int, batch_id: int) -> DataFrame:
        paths = [f"{self.path}/folded_id={first}"] * (first > 0) + [f"{self.path}/batch_id={i}" for i in range(first, batch_id)]
        rows = reduce(DataFrame.unionByName, [self.spark.read.schema(self.SCHEMA).parquet(p) for p in paths])
        return rows.groupBy("url").agg(F.max("ts").alias("ts"))

    def before(self, batch_id: int) -> DataFrame | None:
        """``(url, ts)`` as known before a batch; at a folding it is written first."""
        if batch_id == 0:
            return None
        first = batch_id // self.fold * self.fold
        if first == batch_id:
            rows = self._since(first - self.fold, batch_id)
            end = rows.agg(F.max(F.unix_micros("ts"))).first()[0] or 0
            alive = rows.filter(F.unix_micros("ts") > end - self.keep * 1_000_000)
            alive.write.mode("overwrite").parquet(f"{self.path}/folded_id={first}")
        return self._since(first, batch_id)

    def add(self, batch_id: int, analysed: DataFrame) -> None:
        analysed.groupBy("url").agg(F.max("ts").alias("ts")).write.mode("overwrite").parquet(f"{self.path}/batch_id={batch_id}")


def run_actions(stream: DataFrame, verdict_path: str, alert_path: str, checkpoint: str,
                read_config: Callable[[], ResponseConfig] = ResponseConfig,
                ttl_seconds: int | None = None, fold: int = FOLD, lateness: int = LATENESS_SECONDS):
    """Write verdicts and alerts per micro-batch, re-reading the config each time.

    Order of a batch: navigation filter, TTL, verdicts, actions.  With
    ``ttl_seconds`` a URL is analysed again only when its last analysis is that
    old; these times are kept next to ``checkpoint`` (``LastAnalyses``).
    Batches land in ``batch_id=n`` folders that are overwritten on a retry, so
    an executor or driver loss does not duplicate rows.
    """
    def sink(batch: DataFrame, batch_id: int) -> None:
        cfg, spark = read_config(), batch.sparkSession
        seen = nav_filter(batch, cfg)
        if ttl_seconds is not None:
            known = LastAnalyses(spark, f"{checkpoint}-last", ttl_seconds, fold, lateness)
            analysed = due(seen, known.before(batch_id), ttl_seconds)
            known.add(batch_id, analysed)
            first = seen.groupBy("url", "ts").agg(F.min(F.struct(*[c for c in seen.columns if c not in ("url", "ts")])).alias("_e"))
            seen = first.join(analysed, ["url", "ts"]).select("url", "ts", "_e.*").select(*seen.columns)
        rows = nav_actions(browser_verdict(seen, cfg.cascade()), cfg)
        path = f"{verdict_path}/batch_id={batch_id}"
        rows.write.mode("overwrite").parquet(path)
        done = batch.sparkSession.read.schema(rows.schema).parquet(path)
        done.filter("should_alert or should_block").write.mode("overwrite").parquet(
            f"{alert_path}/batch_id={batch_id}")

    return (stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def run_to_table(stream: DataFrame, path: str, checkpoint: str):
    """Append-only parquet sink for a whole stream (available data, then stop)."""
    return (stream.writeStream.format("parquet").option("path", path)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def resolve(href: Column, base: str) -> Column:
    """RFC 3986 resolution of a reference against the URL in column ``base``, the fragment dropped."""
    b = F.substring_index(F.substring_index(F.col(base), "#", 1), "?", 1)
    scheme = F.regexp_extract(b, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)
    origin = F.regexp_extract(b, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/]*)", 1)
    path = F.substr(b, F.length(origin) + 1)
    ref = F.substring_index(href, "#", 1)
    own_path, own_query = F.substring_index(ref, "?", 1), F.regexp_extract(ref, r"^[^?]*(\?.*)$", 1)
    query = F.regexp_extract(F.substring_index(F.col(base), "#", 1), r"^[^?]*(\?.*)$", 1)
    folder = F.when(path == "", F.lit("/")).otherwise(F.regexp_replace(path, "[^/]*$", ""))
    merged = _no_dots(F.when(own_path.startswith("/"), own_path).otherwise(F.concat(folder, own_path)))
    return (F.when(ref.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), ref)
            .when(ref.startswith("//"), F.concat(scheme, F.lit(":"), ref))
            .when(ref == "", F.concat(origin, path, query))
            .when(own_path == "", F.concat(origin, path, own_query))
            .otherwise(F.concat(origin, merged, own_query)))


def _no_dots(path: Column) -> Column:
    """Remove dot segments of an absolute path."""
    parts = F.split(F.substr(path, F.lit(2)), "/")
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, x: F.when(
        x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(x == ".", acc).otherwise(F.concat(acc, F.array(x))))
    # A path that ends in a dot segment names a folder.
    end = F.when(F.element_at(parts, -1).isin(".", "..") & (F.size(kept) > 0), F.lit("/")).otherwise(F.lit(""))
    return F.concat(F.lit("/"), F.array_join(kept, "/"), end)


def page_links(pages: DataFrame) -> DataFrame:
    """``page_id, pos, url``: the links of raw pages as a browser resolves them.

    Quoted in either way or not at all, in any case, with ``&amp;`` decoded.
    References inside the page (``#...``) and schemes other than http and https
    (``mailto:``, ``javascript:``, ...) are left out.  ``pos`` counts all links.
    """
    found = F.regexp_extract_all("html", F.lit(
        r"""(?is)<(?:a|area)\b[^>]*?\shref\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""), F.lit(1))
    rows = pages.select("page_id", F.col("url").alias("page_url"), F.posexplode(found).alias("pos", "_h"))
    href = F.regexp_replace("_h", r"""^["']|["']$""", "")
    for entity, plain in (("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"), ("&#38;", "&")):
        href = F.replace(href, F.lit(entity), F.lit(plain))
    rows = rows.withColumn("href", F.trim(href)).filter((F.col("href") != "") & ~F.col("href").startswith("#"))
    return rows.select("page_id", "pos", resolve(F.col("href"), "page_url").alias("url")).filter(
        F.col("url").rlike("(?i)^https?://"))
