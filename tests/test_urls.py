from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from lurewatch.functions import features as FE
from lurewatch.functions import urls as U

URLS = [
    "https://www.google.com", "google.com", "  http://a.b.c/x?y=1#z  ", "HTTP://WWW.Example.COM:443/P;x=1",
    "http://h/a;b/c;d?e;f", "http://evil.com@real.com/login", "google.com:x@evil.com",
    "foo?x=http://bar.com/a", "data:text/html,x", "http://192.168.1.1:8080/admin", "http://[::1]:80/x",
    "https://www timesofindia.com/", "http://аpple.com", "ftp://h/p;type=i", "x-y+z.1://h/p;q", "http://",
    "http:///path", "//host/path", "http://host?q", "http://host#f", "http://a..b./c//d", "",
    "https://example.com/" + "a" * 500, "http://h:80:90/x", "http://h/%41%zz?%20#%20", "http://h/x\ty\nz",
    "mailto:a@b.c", "a://b://c", "http://u:p@h:1/", "1http://h/p", "http://h;p/x",
]


def test_parse_matches_standard_library(spark):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "i int, url string")
    rows = U.parse_url_columns(df).orderBy("i").collect()
    for r in rows:
        raw = r["url"].strip()
        p = urlparse(raw if "://" in raw else "http://" + raw)
        got = (r["scheme"], r["netloc"], r["path"], r["query"])
        assert got == (p.scheme, p.netloc.lower(), p.path, p.query), raw
        assert r["host"] == p.netloc.lower().split(":")[0]
        assert not r["is_malformed"]


@pytest.mark.parametrize("url", ["http://[abc/x", "http://abc]/x"])
def test_malformed(spark, url):
    with pytest.raises(ValueError):
        urlparse(url)
    df = spark.createDataFrame([(url,)], "url string")
    assert U.parse_url_columns(df).first()["is_malformed"]


def test_request_bounds(spark):
    df = spark.createDataFrame([("",), ("a",), ("a" * 2048,), ("a" * 2049,), (None,)], "url string")
    got = [r[0] for r in df.select(U.is_valid_request_url(F.col("url"))).collect()]
    assert got == [False, True, True, False, False]


def features(spark, url):
    return FE.extract_features(spark.createDataFrame([(url,)], "url string")).first().asDict()


def test_feature_table_shape(spark):
    f = features(spark, "http://paypal-login.top/signin")
    assert list(f)[1:] == list(FE.C.FEATURE_NAMES) and len(f) == 78
    assert f["brand_hyphenated_domain"] == 1 and f["has_suspicious_tld"] == 1
    assert f["suspicious_keyword_count"] >= 2


def test_edge_features(spark):
    empty = features(spark, "")
    assert (empty["brand_min_levenshtein"], empty["brand_near_match"], empty["short_unknown_domain"]) == (10, 0, 1)
    www = features(spark, "https://www.google.com")
    assert (www["is_known_legitimate"], www["domain_name_in_whitelist"]) == (0, 1)
    ip = features(spark, "http://192.168.1.1:8080/admin")
    assert (ip["has_ip_host"], ip["has_port_number"], ip["has_suspicious_port"], ip["num_subdomains"]) == (1, 1, 0, 2)
    cyr = features(spark, "http://аpple.com")
    assert (cyr["has_non_ascii_chars"], cyr["brand_min_levenshtein"]) == (1, 1)


def test_vector_and_long_form(spark):
    df = spark.createDataFrame([("https://a.com",)], "url string")
    vec = FE.feature_vector(FE.extract_features(df)).first()["features"]
    assert vec.size == 77 and vec[0] == 13.0
    assert FE.feature_long(df).count() == 77


def test_unused_features_are_pruned(spark):
    df = FE.extract_features(spark.createDataFrame([("https://a.com",)], "url string"))
    plan = df.select("url_length")._jdf.queryExecution().optimizedPlan().toString()
    assert "levenshtein" not in plan
