"""Exact hold-out quotas, reputation tables on streams, configuration as of an event, images that cannot be read."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lurewatch.operators import corpus, joins, vision
from lurewatch.streaming import nav


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 1000])
def test_exact_quota(spark, n):
    rows = [(f"http://h{i}.com", y) for i in range(n) for y in ((0, 1) if i % 3 else (0,))]
    df = spark.createDataFrame(rows + rows[:5] * 3, "url string, label int").withColumn("key", F.lit(1))
    got = corpus.split_exact(df)
    assert got.columns == ["url", "label", "key", "is_train"] and got.count() == df.count()
    for y in (0, 1):
        own = {r.url: r.is_train for r in got.filter(F.col("label") == y).collect()}
        assert sum(not t for t in own.values()) == (200 * len(own) + 500) // 1000
    assert got.groupBy("url", "label").agg(F.countDistinct("is_train").alias("c")).filter("c > 1").isEmpty()


def test_exact_quota_of_missing_values(spark):
    df = spark.createDataFrame([(None, 1)] * 9 + [(f"u{i}", None) for i in range(10)], "url string, label int")
    got = corpus.split_exact(df).collect()
    assert sum(not r.is_train for r in got if r.label is None) == 2 and len(got) == 19


def test_reputation_table_on_a_stream(spark, tmp_path):
    rng = random.Random(1)
    names = [f"d{i}.example{i % 50}.{rng.choice(['com', 'co.uk', 'org'])}" for i in range(3000)] + ["known.com", "a.b.known.org"]
    table = spark.createDataFrame([(x,) for x in names], "domain string")
    hosts = ["known.com", "www.known.com", "notknown.com", "com", "x.a.b.known.org", "b.known.org", None, "", names[5], "w." + names[7]]
    rows = [(h, None if h is None else ".".join(h.split(".")[-2:])) for h in hosts]
    spark.createDataFrame(rows, "host string, reg_domain string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("host string, reg_domain string").parquet(str(tmp_path / "in"))
    flagged, mark = joins.with_reputation(stream, table, bound=100)
    assert flagged.isStreaming
    run = flagged.writeStream.format("memory").queryName("listed").trigger(availableNow=True).start()
    run.awaitTermination()
    streamed = {r.host: tuple(r[2:]) for r in spark.table("listed").collect()}
    known = set(names)

    def under(h):
        return h is not None and any(".".join(h.split(".")[i:]) in known for i in range(h.count(".") + 1))

    assert streamed == {h: (h in known, r in known, under(h)) for h, r in rows}
    still, _ = joins.with_reputation(spark.createDataFrame(rows, "host string, reg_domain string"), table, bound=100)
    assert {r["host"]: tuple(r[c] for c in mark.COLUMNS) for r in still.collect()} == streamed


def test_bad_images_do_not_end_the_job(spark):
    def brightness(x):
        if (x > 2.2).all(axis=(1, 2, 3)).any():
            raise RuntimeError("too bright")
        return 1 / (1 + np.exp(-x.mean(axis=(1, 2, 3))))

    def image(path, value, h=3, w=4, c=3, cut=0):
        return (path, 0, h, w, c, bytearray([value]) * max(0, h * w * c - cut))

    rows = [image("dark", 0), image("bright", 255), image("cut", 9, cut=1), ("unreadable", 1, -1, -1, -1, bytearray()),
            image("grey", 100, c=1), ("none", 1, 3, 3, 3, None)]
    df = spark.createDataFrame(rows, "path string, label int, height int, width int, n_channels int, data binary").coalesce(1)
    got = {r.path: r for r in vision.score_images(df, brightness, 8).collect()}
    assert {p for p, r in got.items() if r.ok} == {"dark", "grey"}
    assert all(r.prob == 0.5 and r.error for r in got.values() if not r.ok) and got["bright"].error == "too bright"
    assert got["dark"].prob < got["grey"].prob and got["dark"].error is None
    assert {r.path for r in vision.prepare_images(df, 8).filter("tensor is null").collect()} == {"cut", "unreadable", "none"}


def test_configuration_as_of_an_event(spark):
    rng = random.Random(4)
    day = 86_400

    def at(s):
        return None if s is None else f"2024-01-{1 + s // day:02d} {s % day // 3600:02d}:{s % 3600 // 60:02d}:{s % 60:02d}"

    def when():
        return rng.choice([rng.randrange(5 * day), 3600 * rng.randrange(40), None])

    patches = [(rng.choice([1, 2, None]), i, when(), rng.choice([None, True, False]), None, rng.choice([None, "block", "alert"]), None,
                rng.choice([None, rng.random()]), None, None, None) for i in range(60)]
    events = [(rng.choice([1, 2, 3, None]), i, when()) for i in range(400)]
    start = nav.ResponseConfig(block_mode="both")
    p = spark.createDataFrame([(*r[:2], at(r[2]), *r[3:]) for r in patches],
                              "config_id int, patch_id long, ts string, enabled boolean, real_time_check boolean, block_mode string, "
                              "show_badge boolean, fast_path_safe double, fast_path_malicious double, safe_threshold double, "
                              "phishing_threshold double").withColumn("ts", F.col("ts").cast("timestamp"))
    e = spark.createDataFrame([(*r[:2], at(r[2])) for r in events], "config_id int, event_id long, ts string").withColumn(
        "ts", F.col("ts").cast("timestamp")).withColumns({"enabled": F.lit("clash"), "_b": F.lit(1), "_k": F.lit(2), "_t": F.lit(3)})
    want = {}
    for k, i, t in events:
        known = sorted((x for x in patches if x[0] == k and x[2] is not None and t is not None and x[2] <= t), key=lambda x: (x[2], x[1]))
        last = lambda at, other: next((x[at] for x in reversed(known) if x[at] is not None), other)
        want[i] = (last(3, True), True, last(5, "both"), last(7, start.thresholds["fast_path_safe"]), 0.66)
    for bucket in (3600, 7, 10 ** 7):
        got = nav.config_as_of(e, p, start, bucket_seconds=bucket)
        assert got.columns == ["config_id", "event_id", "ts", "_b", "_k", "_t", *nav.PATCH_FIELDS]
        assert {r.event_id: (r.enabled, r.real_time_check, r.block_mode, r.fast_path_safe, r.phishing_threshold)
                for r in got.collect()} == want
    assert nav.config_as_of(e.limit(0), p, start).count() == 0
    assert {r.block_mode for r in nav.config_as_of(e, p.limit(0), start).collect()} == {"both"}


def test_last_analyses_fold_and_expire(spark, tmp_path):
    known = nav.LastAnalyses(spark, str(tmp_path / "last"), ttl_seconds=100, fold=2, lateness=50)

    def rows(*pairs):
        return spark.createDataFrame([(u, f"2024-01-01 00:{s // 60:02d}:{s % 60:02d}") for u, s in pairs],
                                     "url string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))

    def before(n):
        return {(r.url, r.ts.minute * 60 + r.ts.second) for r in known.before(n).collect()}

    assert known.before(0) is None
    known.add(0, rows(("a", 0), ("b", 5)))
    known.add(0, rows(("a", 0), ("b", 10)))  # a repeated batch replaces what it wrote
    assert before(1) == {("a", 0), ("b", 10)}
    known.add(1, rows(("c", 155), ("a", 120)))
    assert before(2) == {("a", 120), ("b", 10), ("c", 155)}
    known.add(2, rows(("d", 165)))
    known.add(3, rows())
    assert before(4) == before(4) == {("a", 120), ("c", 155), ("d", 165)}  # b is older than the TTL and the lateness


def test_actions_with_ttl_over_many_batches(spark, tmp_path):
    rng = random.Random(2)
    rows = sorted((rng.randrange(3000), i, 0, f"http://h{rng.randrange(6)}.com/") for i in range(240))
    made = spark.createDataFrame(rows, "s int, tab_id long, frame_id int, url string").withColumn(
        "ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("s"))).drop("s").select("ts", "tab_id", "frame_id", "url")
    start = 1_700_000_000
    for i in range(5):  # in the order of time, one file a batch
        part = made.filter(F.unix_seconds("ts").between(start + 600 * i, start + 600 * i + 599))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = nav.read_nav_stream(spark, str(tmp_path / "in"), max_files=1)
    out = str(tmp_path / "out")
    nav.run_actions(stream, out, str(tmp_path / "alerts"), str(tmp_path / "cp"), ttl_seconds=300, fold=2, lateness=60).awaitTermination()
    got = sorted((r.url, r.ts) for r in spark.read.parquet(out).collect())
    assert (tmp_path / "cp-last" / "folded_id=4").exists()
    assert got == sorted((r.url, r.ts) for r in nav.ttl_dedup(made, 300).collect())
