"""What grows with the documents is never sent to all executors by way of the driver."""

import random

import pytest

import corpus_pipeline
from lurewatch.llm import simhash

SF = "/root/testdata/sf0.01"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def plans(monkeypatch):
    """The plans of all tables that ``simhash`` stores, by name."""
    seen, stored = {}, simhash.stored

    def kept(df, name):
        seen[name] = _plan(df)
        return stored(df, name)

    monkeypatch.setattr(simhash, "stored", kept)
    return seen


def _rows():
    rng = random.Random(3)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(400)]
    rows = [(i, " ".join([*base[:200], f"x{i}", *base[200:]])) for i in range(60)]
    return rows + [(100 + i, f"a{i} b{i} c{i} d{i}") for i in range(30)]


@pytest.mark.parametrize("stage", ["op8", "pipeline"])
def test_near_duplicates_send_no_exploded_table_to_all(spark, documents, plans, stage):
    # A limit far above these tables: Spark would take each join's side for small enough.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        if stage == "op8":
            plans["result"] = _plan(simhash.near_duplicates(documents(_rows())))
        else:
            corpus_pipeline.drop_near_duplicates(spark, documents(_rows()), SF)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Generate explode" in plans["simhash-cells"] and "Join" in plans["simhash-links"]
    assert not [name for name, plan in plans.items() if "Broadcast" in plan]


@pytest.mark.parametrize("distance", [1, 2])
def test_crowded_cells_send_nothing_to_all(spark, distance):
    fps = spark.createDataFrame([(1 << i,) for i in range(60)], "fp long")  # one cell holds them all
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        found = simhash.links(fps, distance)
        assert "Broadcast" not in _plan(found)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # All are two bits apart, none is one bit apart.
    nodes = {x for r in found.collect() for x in (r.a, r.b)}
    assert len(nodes) == (60 if distance == 2 else 0)
