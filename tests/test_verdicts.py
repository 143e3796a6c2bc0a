import pytest
from pyspark.sql import functions as F

from lurewatch.operators import scoring as M
from lurewatch.operators import verdict as V
from lurewatch.operators.rules import add_rule_score
from lurewatch.functions.urls import host_columns

# url, decided by the white list, rule score
CASES = [
    ("https://www.google.com", True, None), ("https://github.com/login", True, None),
    ("https://signal.org/", False, 0.0), ("https://news.ycombinator.com/", False, 0.0),
    ("https://my-app.netlify.app/", False, 0.0), ("http://192.168.1.1/login", False, 0.5),
    ("http://192.168.1.1:8080/admin", False, 0.5), ("http://paypa1.com/account/confirm", False, 0.6),
    ("http://n4tw3st.com/account", False, 0.6), ("http://amaz0n-secure.com/login", False, 0.6),
    ("http://hsbc-b4nk.com/account", False, 0.7), ("http://paypal-login.top/signin", False, 1.0),
    ("http://google-verify-account.com/signin", False, 0.6),
    ("http://micr0soft-secure-login.com/verify", False, 0.0), ("http://bit.ly/3xlogin-verify", False, 0.6),
    ("https://example.com", False, 0.0), ("http://evil.com@real.com/login", False, 0.0),
    ("google.com:x@evil.com", True, None), ("https://www.dell.com/", False, 0.6),
]


def table(spark, urls):
    return spark.createDataFrame([(u,) for u in urls], "url string")


def test_fixture_outcomes(spark):
    rows = {r["url"]: r for r in V.hybrid_verdict(table(spark, [c[0] for c in CASES])).collect()}
    for url, white, score in CASES:
        r = rows[url]
        assert (r["stage"] == "whitelist") == white, url
        if not white:
            assert r["rule_score"] == pytest.approx(score), url
            assert (r["stage"] == "rule") == (score >= 0.5), url
        if white:
            assert (r["verdict"], r["risk"], r["fast_path"]) == ("Safe", 0.0, True)


def test_reasons(spark):
    df = add_rule_score(host_columns(table(spark, ["http://paypa1.com/", "http://a.b"])))
    assert [r["rule_reason"] for r in df.collect()] == [
        "Domain 'paypa1' is 1 edit(s) from brand 'paypal'", "No rule triggered"]


def fixed(prob):
    return lambda df: df.withColumn("lex_prob", F.lit(prob))


@pytest.mark.parametrize("prob,verdict,stage", [
    (0.15, "Safe", "fast_path"), (0.85, "Phishing", "fast_path"), (0.16, "Safe", "fused"),
    # 0.5 * 0.82 + 0.25 is 0.6599999999999999 in doubles, just below the bound
    (0.82, "Suspicious", "fused"), (0.8201, "Phishing", "fused"), (0.5, "Suspicious", "fused")])
def test_cascade_bounds(spark, prob, verdict, stage):
    r = V.hybrid_verdict(table(spark, ["https://example.com"]), scorer=fixed(prob)).first()
    assert (r["verdict"], r["stage"]) == (verdict, stage)


def test_zero_weights(spark):
    cfg = V.Config(w_lexical=0.0, w_vision=0.0)
    r = V.hybrid_verdict(table(spark, ["https://example.com"]), cfg, scorer=fixed(0.5)).first()
    assert (r["risk"], r["verdict"]) == (0.0, "Safe")


def test_model_scorer_sees_only_undecided_rows(spark):
    seen = []

    def scorer(df):
        seen.append(df.count())
        return df.withColumn("lex_prob", F.lit(0.5))

    urls = ["https://www.google.com", "http://192.168.1.1/", "http://[x/", "https://example.com"]
    out = V.hybrid_verdict(table(spark, urls), scorer=scorer)
    assert out.count() == 4 and seen == [1]
    assert {r["url"]: r["verdict"] for r in out.collect()}["http://[x/"] == "Error"


def test_stage2_lookup(spark):
    urls = table(spark, ["https://examplesite.org/a", "https://examplesite.org/b", "https://examplesite.org/c"])
    s2 = spark.createDataFrame([("https://examplesite.org/a", 1.0, True, None, "a.png"),
                                ("https://examplesite.org/b", None, False, "timeout", None)],
                               "url string, prob double, ok boolean, error string, screenshot string")
    rows = {r["url"]: r for r in V.hybrid_verdict(urls, scorer=fixed(0.5), stage2_scores=s2).collect()}
    a, b, c = (rows[f"https://examplesite.org/{n}"] for n in "abc")
    assert (a["risk"], a["screenshot"], a["stage_scores"][1]["used"]) == (0.75, "a.png", True)
    assert b["notes"][0] == "Capture failed: timeout" and b["risk"] == 0.5
    assert c["notes"][0] == "Capture failed: no capture" and not c["stage_scores"][1]["used"]


def test_batch_bounds(spark):
    df = spark.createDataFrame([(0, []), (1, ["https://a.com"] * 100), (2, ["https://a.com"] * 101),
                                (3, ["http://[x/", "https://www.google.com"])], "request_id long, urls array<string>")
    rows = {r["request_id"]: r for r in V.batch_verdicts(df).collect()}
    assert set(rows) == {0, 1, 2, 3} and rows[1]["n_urls"] == 100
    assert rows[0]["rejected"] == "no URLs" and rows[2]["rejected"] == "more than 100 URLs" and rows[2]["results"] is None
    assert rows[1]["rejected"] is None and rows[3]["rejected"] is None
    assert [x["verdict"] for x in rows[3]["results"]] == ["Error", "Safe"]


def test_feature_guard():
    names = list(M.FEATURE_NAMES)
    M.check_feature_columns(names, ["url", *names])
    with pytest.raises(ValueError):
        M.check_feature_columns(names, names[:-1])
    with pytest.raises(ValueError):
        M.check_feature_columns(names, names[::-1])


def test_actions(spark):
    df = table(spark, ["http://192.168.1.1/a b", "https://www.google.com"])
    rows = V.response_actions(V.browser_verdict(df), "block").collect()
    assert (rows[0]["should_block"], rows[0]["should_alert"]) == (True, False)
    assert rows[0]["warning_url"].startswith("warning.html?url=http%3A%2F%2F192.168.1.1%2Fa%20b&reasons=%5B%22Rule")
    assert rows[1]["warning_url"] is None and not rows[1]["should_block"]
