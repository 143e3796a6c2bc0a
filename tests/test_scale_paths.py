"""The paths taken only for large or skewed inputs give the same rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lurewatch.functions import urls as U
from lurewatch.operators import corpus as K
from lurewatch.operators import joins as J
from lurewatch.operators import metrics as A
from lurewatch.sources import dims
from lurewatch.streaming import nav as T


def same(a, b):
    cols = sorted(a.columns)
    key = lambda d: sorted(map(str, d.select(cols).collect()))
    return key(a) == key(b)


@pytest.fixture(scope="module")
def hosts(spark):
    rng = random.Random(1)
    pool = ["google.com", "www.google.com", "a.b.github.io", "github.io", "evilgoogle.com", "x.com.", "1.2.3.4",
            "co.uk", "www.bbc.co.uk", ""]
    urls = ["http://" + rng.choice(pool) + f"/{i % 7}" for i in range(300)] + ["http://hot.google.com/"] * 300
    return U.host_columns(spark.createDataFrame([(u,) for u in urls], "url string")).select(
        "url", "host", "is_ip", "reg_domain").cache()


def test_suffix_match_large_dictionary(spark, hosts):
    wl = dims.whitelist(spark)
    assert same(J.suffix_match(hosts, wl), J.suffix_match(hosts, wl, bound=0))
    small = J.suffix_semi(hosts, wl)
    assert same(small, J.suffix_semi(hosts, wl, bound=0))
    want = [r for r in hosts.collect() if any(
        r["host"] == d or r["host"].endswith("." + d) for d in J.C.KNOWN_DOMAINS)]
    assert small.count() == len(want)


def test_exact_match_large_dictionary(spark, hosts):
    wl = dims.whitelist(spark)
    assert same(J.exact_match(hosts, wl), J.exact_match(hosts, wl, bound=0))


def test_brand_contains_by_ngrams(spark, monkeypatch):
    df = spark.createDataFrame([("secure-paypal",), ("upstart",), ("google.paypal",), ("none",), ("up",)],
                               "domain_base string")
    small = J.brand_contains(df, dims.brands(spark))
    monkeypatch.setattr(J, "is_small", lambda *a: False)
    assert same(small, J.brand_contains(df, dims.brands(spark)).select(small.columns))
    assert small.count() == 4


def test_salted_join_keeps_every_row(spark):
    big = spark.range(1000).select("id", F.when(F.col("id") < 900, 1).otherwise(F.col("id")).alias("k"))
    small = spark.createDataFrame([(1, "a"), (950, "b")], "k long, v string")
    big = big.withColumn("k", F.when(F.col("id") % 10 != 7, F.col("k")))  # some NULL keys
    assert [r["k"] for r in J.hot_keys(big, "k", 100).collect()] == [1]
    for min_rows in (100, 100_000):
        assert same(J.salted_join(big, small, "k", min_rows=min_rows), big.join(small, "k", "left"))
        assert same(J.salted_join(big, small.select("k"), "k", "left_anti", min_rows=min_rows),
                    big.join(small, "k", "left_anti"))


def test_dedup_keeps_first_source(spark):
    df = spark.createDataFrame([("u", 1, 1, 5), ("u", 0, 0, 9), ("v", 1, 2, 3), ("v", 0, 2, 4)],
                               "url string, label int, priority int, seq long")
    got = {r["url"]: (r["label"], r["priority"], r["seq"]) for r in K.dedup_keep_first(df).collect()}
    assert got == {"u": (0, 0, 9), "v": (1, 2, 3)}


def test_metrics_fixture(spark):
    df = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.4, 1), (0.8, 1), (0.3, 1)], "score double, label int")
    assert A.roc_auc(df).first()["auc"] == pytest.approx(0.75)
    assert A.threshold_for_recall(df).first()["threshold"] == 0.3
    curve = A.cumulative(A.score_counts(df), ranges=2).orderBy("score").collect()
    assert [(r["cum_pos"], r["cum_neg"]) for r in curve] == [(3, 2), (3, 1), (2, 1), (1, 0)]


def test_auc_against_pairs(spark):
    rng = random.Random(3)
    rows = [(round(rng.random(), 2), int(rng.random() < 0.4)) for _ in range(400)]
    pos = [s for s, y in rows if y]
    neg = [s for s, y in rows if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert A.roc_auc(spark.createDataFrame(rows, "score double, label int")).first()["auc"] == pytest.approx(want)


def nav_rows(n, seed, span):
    rng = random.Random(seed)
    start = dt.datetime(2024, 1, 1)
    return [(f"u{rng.choice([0, 0, 0, 1, 2])}", start + dt.timedelta(seconds=rng.randrange(span)))
            for _ in range(n)]


def chain(rows, ttl=300):
    out, last = [], {}
    for u, t in sorted(rows, key=lambda r: r[1]):
        if u not in last or (t - last[u]).total_seconds() >= ttl:
            out.append((u, t))
            last[u] = t
    return sorted(out)


@pytest.mark.parametrize("n,span", [(400, 3600), (200, 40000), (60, 900)])
def test_ttl_chain_of_busy_urls(spark, n, span):
    rows = nav_rows(n, n, span)
    df = spark.createDataFrame(rows, "url string, ts timestamp")
    want = chain(rows)
    for hot in (50_000, 30, 0):
        got = sorted((r["url"], r["ts"]) for r in T.ttl_dedup(df, hot_rows=hot).collect())
        assert got == want


def test_ttl_trace(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(f"k{i % 3}", start + dt.timedelta(minutes=i)) for i in range(40)]
    df = spark.createDataFrame(rows, "url string, ts timestamp")
    assert T.ttl_dedup(df).count() == 21
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    for i in range(4):  # several micro-batches carry the state over
        spark.createDataFrame(rows[i * 10:(i + 1) * 10], "url string, ts timestamp").coalesce(1).write.mode(
            "append").parquet(src)
    stream = T.read_nav_stream(spark, src, "url string, ts timestamp", max_files=1)
    T.run_to_table(T.ttl_dedup_stream(stream), out, ck).awaitTermination()
    assert spark.read.parquet(out).count() == 21


def test_shuffled_position_is_a_permutation(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("url"), F.lit(0).alias("label"))
    pos = sorted(r["position"] for r in K.shuffled_position(df).collect())
    assert pos == list(range(1, 501))


def test_nearest_of_a_large_brand_table(spark, monkeypatch):
    rng = random.Random(8)
    word = lambda a, b: "".join(rng.choice("abcdefghij-0é") for _ in range(rng.randint(a, b)))
    brands = [(i, word(1, 9)) for i in range(300)] + [(300, "x" * 40), (301, None), (-1, "abab"), (302, "abab")]
    domains = [(word(0, 14),) for _ in range(150)] + [("",), (None,), ("abab",), ("abab",), ("z" * 30,), ("é😀",)]
    table = spark.createDataFrame(brands, "idx long, brand string")
    df = spark.createDataFrame(domains, "domain_base string")
    small = J.nearest_brand(df, table.filter("brand is not null"))
    many = J.nearest_brand(df, table, literal=0)
    assert many.columns == small.columns and same(small, many)
    assert same(small, J._nearest_of_many(df.distinct(), table, block=7))
    assert J.nearest_brand(df, table.limit(0), literal=-1).filter("brand is null and dist is null").count() == df.distinct().count()
    assert J.nearest_brand(df.limit(0), table, literal=0).isEmpty()


def test_families_are_those_of_the_single_generators(spark):
    from lurewatch.operators import generators as G

    names = spark.createDataFrame([("paypal",), ("a",), ("",), ("o0-l",)], "brand string")
    single = [G.swaps, G.omissions, G.duplications, G.leet, G.homographs, G.bitsquats, G.char_variants, G.combos, G.hyphenated,
              G.affixes, G.subdomains, G.subdomain_abuse, G.paths, G.free_hosting, G.free_hosting_sampled]
    assert len(single) == len(G.FAMILIES)
    assert same(G.all_families(names), K.union_corpora(*[f(names) for f in single]))
    urls = G.generated_corpus(names.limit(1))
    assert urls.select("family").distinct().count() == 17 and urls.filter("url is null or not url like 'http%'").isEmpty()
    assert urls.filter("family = 'subdomain' and not url like 'https://%.com'").isEmpty()
