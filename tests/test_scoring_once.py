import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from lurewatch.operators import corpus as K
from lurewatch.operators import training as TR
from lurewatch.operators import verdict as V
from lurewatch.operators.scoring import ml_scorer, score_equal
from lurewatch.plans import corpora as P
from lurewatch.plans import registry_jobs as J

URLS = [("http://paypal-login.top/signin", 1), ("https://www.google.com", 0), ("http://[abc/x", 1), (None, 0), ("", 0),
        ("http://a%d.example.com/login", 1), ("https://b%d.org/", 0), ("https://signal.org/", 0)]


@pytest.fixture(scope="module")
def urls(spark):
    rows = [("event", i * len(URLS) + j, u % i if u and "%d" in u else u, label) for i in range(40) for j, (u, label) in enumerate(URLS)]
    return spark.createDataFrame(rows, "source string, seq long, url string, label int")


@pytest.fixture(scope="module")
def fit(urls):
    return TR.train(urls.filter("url not like '%[%'"), "random_forest", trees=5, depth=3)


def test_equal_vectors_are_scored_once(spark):
    rows = [(i, Vectors.dense([float(i % 2), float(i % 3)])) for i in range(60)] + [(60, Vectors.dense([-0.0, 0.0]))]
    df = spark.createDataFrame(rows, ["id", "features"])
    model = RandomForestClassifier(numTrees=3, seed=1).fit(df.withColumn("label", (F.col("id") % 2).cast("double")))
    seen = []

    class Counted:
        def transform(self, table):
            seen.append(table.count())
            return model.transform(table)

    got = score_equal(df, Counted())
    assert got.columns == ["id", "lex_prob"] and 6 <= seen[0] <= 7
    plan = score_equal(df, model)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [features" in plan  # not planned away
    want = ml_scorer(model, features_ready=True)(df).select("id", "lex_prob")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_a_model_alone_scores_no_hold_out(urls, monkeypatch):
    def refused(*args):
        raise AssertionError("the hold-out was scored")

    monkeypatch.setattr(TR.A, "roc_auc", refused)
    result = TR.train(urls.filter("url not like '%[%'"), "random_forest", trees=2, depth=2)
    assert result.model.getNumTrees == 2 and result.top_features.count() > 0
    result.release()


def test_metrics_come_when_asked_for(urls, fit):
    n = urls.filter("url not like '%[%'").count()
    assert fit.summary.first()["n_samples"] == n and 0 <= fit.threshold <= 1
    assert fit.report.count() >= 4 and fit.confusion.count() >= 1 and fit.summary is fit.summary


def test_scores_of_a_column_decide_as_those_of_a_model(urls, fit, monkeypatch):
    monkeypatch.setattr(P, "corpus", lambda spark, d: urls)
    monkeypatch.setattr(J, "_fitted", lambda spark, d, kind: fit)
    J._featured.cache_clear()
    spark = urls.sparkSession
    got = J.ml_score_batch(spark, "made-up")
    want = V.hybrid_verdict(urls, scorer=ml_scorer(fit.model)).select(*[c for c in got.columns if c not in ("risk", "lex_prob")],
                                                                     F.round("risk", 6).alias("risk"), F.round("lex_prob", 6).alias("lex_prob"))
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
    assert urls.count() == got.count() and {r["stage"] for r in got.collect()} >= {"error", "whitelist", "rule"}
    J._featured(spark, "made-up").unpersist()
    J._featured.cache_clear()


def test_features_are_computed_once_for_fit_and_scores(urls, fit, monkeypatch):
    monkeypatch.setattr(P, "corpus", lambda spark, d: urls)
    monkeypatch.setattr(J, "_fitted", lambda spark, d, kind: fit)
    J._featured.cache_clear()
    spark = urls.sparkSession
    plan = J.ml_score_batch(spark, "made-up")._jdf.queryExecution().withCachedData().toString()
    assert "InMemoryRelation" in plan and "VectorAssembler" not in plan
    assert J._featured(spark, "made-up") is J._featured(spark, "made-up")
    J._featured(spark, "made-up").unpersist()
    J._featured.cache_clear()


def test_class_weights_read_their_table_once(spark):
    df = spark.createDataFrame([(0,), (0,), (0,), (1,), (None,)], "label int")
    weights = K.class_weights(df)
    assert {r["label"]: (r["n_rows"], round(r["weight"], 6)) for r in weights.collect()} == {
        0: (3, 0.555556), 1: (1, 1.666667), None: (1, 1.666667)}
    assert weights._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") <= 1
    assert "Join" not in weights._jdf.queryExecution().optimizedPlan().toString()
    assert K.class_weights(df.limit(0)).count() == 0
