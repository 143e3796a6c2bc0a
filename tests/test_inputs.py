"""Inputs that are odd, large or switched off: links, malformed hosts, reputation tables, caps, live checks."""

import datetime as dt
from urllib.parse import urldefrag, urljoin, urlsplit

import pytest
from pyspark.sql import functions as F

from lurewatch.functions import urls as U
from lurewatch.operators import corpus as K
from lurewatch.operators import generators as G
from lurewatch.operators import joins as J
from lurewatch.operators import verdict as V
from lurewatch.sources import dims, feeds
from lurewatch.streaming import nav as T

BASE = "https://a.example/b/c/d;p?q#f"
REFERENCES = ["g", "./g", "g/", "/g", "//g.example/x", "?y", "g?y", "g#s", "g;x", ";x", "", ".", "./", "..", "../", "../g",
              "../..", "../../", "../../g", "../../../g", "/./g", "/../g", "g.", "..g", "./../g", "./g/.", "g/./h", "g/../h",
              "http://other.example/z", "HTTPS://other.example/Z?x#y"]


def test_references_resolve_by_the_standard(spark):
    df = spark.createDataFrame([(BASE, r) for r in REFERENCES], "base string, ref string")
    for r in df.select("ref", T.resolve(F.col("ref"), "base").alias("url")).collect():
        assert r.url == urldefrag(urljoin(BASE, r.ref))[0] or r.ref.startswith("HTTPS"), r


def test_links_of_all_forms(spark):
    page = ("<A HREF='next.html'>1</A><a class=x href=/abs?a=1&amp;b=2>2</a><a href=\"#top\">3</a><a href='mailto:x@y.z'>4</a>"
            "<a href=\"javascript:void(0)\">5</a><area href=\"//cdn.example/x\"><a data-href='no'>6</a><a\nhref = \"?q=1\">7</a>")
    df = spark.createDataFrame([(1, "https://s.example/dir/page.html?z", page), (2, "https://s.example", None)],
                               "page_id long, url string, html string")
    got = {r.pos: r.url for r in T.page_links(df).collect()}
    assert got == {0: "https://s.example/dir/next.html", 1: "https://s.example/abs?a=1&b=2", 5: "https://cdn.example/x",
                   6: "https://s.example/dir/page.html?q=1"}


@pytest.mark.parametrize("url", [
    "http://a\u2100b.com/", "http://[zz]/x", "http://[::1]/x", "http://[::1]:80/", "http://u@[1::2]/", "http://[1.2.3.4]/",
    "http://[1:2]/", "http://[v1.x]/", "http://x\uff0fy.com/", "http://ok.com/\u2100", "http://[::1/", "http://a]b/",
    "http://[::ffff:1.2.3.4]/", "http://x[::1]/", "http://[::1]x/"])
def test_malformed_as_the_standard_library_says(spark, url):
    try:
        urlsplit(url)
        bad = False
    except ValueError:
        bad = True
    row = U.parse_url_columns(spark.createDataFrame([(url,)], "url string")).first()
    assert row.is_malformed == bad


def test_null_url_is_an_error(spark):
    row = V.hybrid_verdict(spark.createDataFrame([(None,), ("https://www.google.com",)], "url string")).filter("url IS NULL").first()
    assert (row.verdict, row.stage, row.risk) == ("Error", "error", 0.0)


def test_reputation_table_of_any_size(spark, monkeypatch):
    urls = ["https://shop.one.example/x", "https://one.example", "http://dev/", "https://a.dev/", "https://two.example.org/login",
            "http://paypal-login.tk/verify", "https://three.co.uk/", None, "http://[zz]/"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    listed = ["one.example", "dev", "co.uk"]
    table = spark.createDataFrame([(x,) for x in listed], "domain string")
    want = sorted(map(str, V.hybrid_verdict(df, whitelist=listed).collect()))
    assert sorted(map(str, V.hybrid_verdict(df, whitelist=table).collect())) == want
    monkeypatch.setattr(J.with_reputation, "__defaults__", (1,))
    assert sorted(map(str, V.hybrid_verdict(df, whitelist=table).collect())) == want
    assert len([r for r in V.browser_verdict(df, whitelist=table).collect() if r.stage == "whitelist"]) == 5


@pytest.mark.parametrize("bound", [100_000, 1])
def test_suffix_lookup_has_one_answer(spark, bound):
    hosts = spark.createDataFrame([(h,) for h in ("localhost", "a.dev", "x.google.com", "google.com", "other.org", "notgoogle.com")], "host string")
    dim = spark.createDataFrame([(d,) for d in ("localhost", "dev", "google.com")], "domain string")
    got = {r.host for r in J.suffix_semi(hosts, dim, bound=bound).collect()}
    assert got == {"localhost", "a.dev", "x.google.com", "google.com"}


def test_brand_similarity_of_large_tables(spark, monkeypatch):
    df = spark.createDataFrame([(x,) for x in ("gogle", "google", "goggles", "amazn", "x", "amazoon1", "bing")], "domain_base string")
    few = J.brand_similarity(df, dims.brands(spark)).collect()
    monkeypatch.setattr(J, "LITERAL_BRANDS", 3)
    assert sorted(map(tuple, J.brand_similarity(df, dims.brands(spark)).select(*few[0].__fields__).collect())) == sorted(map(tuple, few))


def test_nothing_is_capped_by_default(spark, tmp_path):
    path = str(tmp_path / "lines")
    spark.range(12_000).select(F.concat(F.lit("\thttp://x"), F.col("id").cast("string"), F.lit(" "))).write.text(path)
    assert feeds.read_lines(spark, path).count() == 12_000
    assert feeds.read_lines(spark, path, cap=5).count() == 5
    legit = spark.range(6_000).select(F.concat(F.lit("https://d"), F.col("id").cast("string"), F.lit(".com")).alias("url"), F.lit(0).alias("label"))
    assert K.bare_domains(legit).count() == 6_000
    names = spark.createDataFrame([("abcdefgh",)], "brand string")
    assert G.all_families(names).count() > G.all_families(names, G.FAMILY_CAPS).count()
    assert G.urgency(spark.createDataFrame([(f"n{i}",) for i in range(20)], "brand string")).count() > 200


def test_known_domains():
    assert len(J.C.KNOWN_DOMAINS) == len(set(J.C.KNOWN_DOMAINS)) == 385


def test_actions_without_a_badge_keep_all_rows(spark):
    events = spark.createDataFrame([(1, 0, "http://paypal-login.tk/verify"), (2, 0, "https://www.google.com/")], "tab_id long, frame_id int, url string")
    for switches, block, alert in (({}, True, True), ({"show_badge": False}, False, False), ({"block_mode": "alert"}, False, True)):
        cfg = T.ResponseConfig(**switches)
        rows = {r.tab_id: r for r in T.nav_actions(T.nav_verdicts(events, cfg), cfg).collect()}
        assert len(rows) == 2 and (rows[1].should_block, rows[1].should_alert) == (block, alert)
        assert not rows[2].should_block and not rows[2].should_alert


def test_config_patches(spark):
    patch = spark.createDataFrame([(None, None, "alert", False, (None, None, 0.4, None))],
                                  "enabled boolean, real_time_check boolean, block_mode string, show_badge boolean, thresholds struct<"
                                  "fast_path_safe: double, fast_path_malicious: double, safe_threshold: double, phishing_threshold: double>")
    cfg = T.configured(spark, patch)
    assert cfg.enabled and cfg.block_mode == "alert" and not cfg.show_badge
    assert cfg.thresholds["safe_threshold"] == 0.4 and cfg.thresholds["fast_path_safe"] == 0.15
    assert T.configured(spark) == T.ResponseConfig()


def test_ttl_goes_on_from_the_last_analysis(spark):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    batch = spark.createDataFrame([("u", at(200)), ("u", at(301)), ("u", at(500)), ("u", at(700)), ("v", at(1)), ("v", at(2))], "url string, ts timestamp")
    last = spark.createDataFrame([("u", at(0)), ("w", at(0))], "url string, ts timestamp")
    assert {tuple(r) for r in T.due(batch, last).collect()} == {("u", at(301)), ("u", at(700)), ("v", at(1))}
    assert {tuple(r) for r in T.due(batch, None).collect()} == {("u", at(200)), ("u", at(500)), ("v", at(1))}


def test_live_order_with_ttl(spark, tmp_path):
    schema = "ts timestamp, tab_id long, frame_id int, url string"
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    for i, rows in enumerate([[(at(0), 1, 0, "http://paypal-login.tk/verify"), (at(9), 1, 1, "http://frame.tk/")],
                              [(at(100), 2, 0, "http://paypal-login.tk/verify"), (at(400), 3, 0, "http://paypal-login.tk/verify")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "verdicts")
    T.run_actions(stream, out, str(tmp_path / "alerts"), str(tmp_path / "cp"), ttl_seconds=300).awaitTermination()
    assert {r.tab_id for r in spark.read.parquet(out).collect()} == {1, 3}
