from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lurewatch.llm import queries
from tests.llm.test_texts import encodings, repeats, texts, words

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    assert [len(s) for s in corpus_pipeline.STAGES] == [2] * 5
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, seen, SF)
        assert kept.columns == docs.columns and kept.dtypes == docs.dtypes, name
        kept = kept.cache()
        if name != "mixing":
            assert kept.join(seen, "doc_id", "left_anti").count() == 0
        if name == "substrings":
            rows = [(r.doc_id, r.text) for r in seen.collect()]
            want = repeats(rows, 13)
            assert Counter((r.doc_id, b" ".join(words(r.text)).decode()) for r in kept.collect()) == Counter(
                {(i, t): n for (i, _, _, t), n in want.items()})
            assert kept.filter(F.col("n_chars") != F.length("text")).count() == 0
        seen = kept
    rows = [(r.doc_id, r.text) for r in seen.collect()]
    found = corpus_pipeline.tokenise(spark, seen, SF).collect()
    assert Counter((r.doc_id, bytes(r.ids)) for r in found) == Counter(
        {k[:2]: n for k, n in encodings(rows).items()}) and all(r.n_tokens * 4 == len(r.ids) for r in found)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_take_odd_tables(spark, documents, name, stage):
    odd = documents([(1, None), (2, ""), (None, "x y"), (None, "x y"), (3, "z " * 70_000), (4, "a"), (4, "a")] + texts(20))
    assert stage(spark, odd, SF).count() >= 0
    assert stage(spark, odd.limit(0), SF).count() == 0


def test_registered():
    import __spark_entry__

    assert set(queries.QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())
    assert corpus_pipeline.ORACLE_SQL is None
