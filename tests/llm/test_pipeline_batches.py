from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lurewatch.llm import common
from tests.llm.test_texts import texts

SF, NAME = "/root/testdata/sf0.001", "spark.sql.execution.arrow.maxRecordsPerBatch"
STAGES = [s for s in corpus_pipeline.STAGES if s[0] != "mixing"]  # that one has no Arrow batches


@pytest.fixture(autouse=True)
def batches(spark):
    before = spark.conf.get(NAME)
    yield
    spark.conf.set(NAME, before)


def _largest(spark):
    def sizes(found):
        import pyarrow as pa

        for batch in found:
            yield pa.RecordBatch.from_arrays([pa.array([len(batch)], pa.int64())], ["n"])

    return spark.range(0, 3000, 1, 1).mapInArrow(sizes, "n long").agg(F.max("n")).first()[0]


@pytest.mark.parametrize("name,stage", STAGES)
def test_stages_send_few_texts_at_a_time(spark, documents, name, stage):
    spark.conf.set(NAME, "10000")
    stage(spark, documents(texts(20)), SF)
    assert _largest(spark) == corpus_pipeline.BATCH


def test_a_lower_bound_stays(spark):
    spark.conf.set(NAME, "7")
    common.small_batches(spark, 1000)
    assert spark.conf.get(NAME) == "7"
    spark.conf.set(NAME, "-1")
    common.small_batches(spark, 1000)
    assert spark.conf.get(NAME) == "1000"


@pytest.mark.parametrize("name,stage", STAGES)
def test_stages_are_the_same_in_batches_of_three_rows(spark, documents, name, stage):
    docs = documents(texts(40) + [(None, "x y"), (None, "x y"), (900, None)]).coalesce(1)
    found = []
    for rows in (1000, 3):
        spark.conf.set(NAME, str(rows))
        found.append(Counter(map(str, stage(spark, docs, SF).collect())))
    assert found[0] == found[1] and found[0]
