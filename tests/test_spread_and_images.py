"""Even tasks over tables of few row groups, narrow suffix look-ups, and fast image preparation."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lurewatch.functions import features as FE
from lurewatch.operators import joins as J
from lurewatch.operators import training as TR
from lurewatch.operators import vision as VI
from lurewatch.plans import corpora as P
from lurewatch.plans import registry_jobs as R
from lurewatch.plans.registry import QUERIES
from lurewatch.sources import feeds


def _sizes(df):
    return [r["n"] for r in df.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]


def test_spread_deals_out_a_single_row_group(spark, tmp_path):
    n = 200_000
    pq.write_table(pa.table({"id": np.arange(n), "pad": np.random.default_rng(1).random(n)}), tmp_path / "t.parquet",
                   row_group_size=n)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        scan = spark.read.parquet(str(tmp_path / "t.parquet"))
        assert scan.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and max(_sizes(scan)) == n
        dealt = feeds.spread(scan, 10_000)
        assert max(_sizes(dealt)) < 12_000
        assert dealt.agg(F.count("*"), F.sum("id")).first()[:] == (n, n * (n - 1) // 2)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_spread_leaves_an_even_scan_alone(spark, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    spark.range(cores * 10, numPartitions=cores).write.parquet(str(tmp_path / "t"))
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "1g")  # a partition a file
    try:
        scan = spark.read.parquet(str(tmp_path / "t"))
        assert feeds.spread(scan) is scan
        assert feeds.spread(scan, 2) is not scan
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)


def test_spread_takes_an_empty_table(spark, tmp_path):
    spark.range(0).write.parquet(str(tmp_path / "t"))
    assert feeds.spread(spark.read.parquet(str(tmp_path / "t"))).count() == 0


def test_pictures_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    seen = []
    rows = spark.createDataFrame([(i, [float(i), 1.0, 2.0, 3.0]) for i in range(50)], "vec_id long, embedding array<float>")
    rows.coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    real = R.images.write_pngs
    monkeypatch.setattr(R.images, "write_pngs", lambda df, root: seen.append(df) or real(df, root))
    R._shots(spark, str(tmp_path))
    assert len(_sizes(seen[0])) > 1 and seen[0].count() == 50


def test_small_dictionary_needs_no_shuffle(spark):
    hosts = spark.createDataFrame([("a.github.io",), ("github.io",), ("x.a.github.io",), (None,), ("",), ("io",), ("xgithub.io",),
                                   ("github.io",)], "host string").withColumn("n", F.monotonically_increasing_id())
    dim = spark.createDataFrame([("github.io",), ("a.github.io",), ("github.io",), (None,)], "domain string")
    out = J.suffix_match(hosts, dim)
    assert out.columns == ["host", "n", "matched_domain"]
    got = sorted(("-" if r["host"] is None else r["host"], r["matched_domain"]) for r in out.collect())
    assert got == sorted([("a.github.io", "a.github.io"), ("github.io", "github.io"), ("x.a.github.io", "a.github.io"),
                          ("-", None), ("", None), ("io", None), ("xgithub.io", None), ("github.io", "github.io")])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [_host" not in plan and "_suffix" not in plan
    assert out.rdd.getNumPartitions() == hosts.rdd.getNumPartitions()


def _slow(data, h, w, c, size):
    px = np.frombuffer(data, dtype=np.uint8).reshape(h, w, c)
    px = px[:, :, 2::-1] if c >= 3 else np.repeat(px[:, :, :1], 3, axis=2)
    x = px[(np.arange(size) * h) // size][:, (np.arange(size) * w) // size].astype(np.float32) / 255.0
    return ((x - np.float32(VI.MEAN)) / np.float32(VI.STD)).transpose(2, 0, 1).ravel()


def test_tensors_are_as_computed_pixel_by_pixel():
    rng = np.random.default_rng(2)
    for h, w, c in ((1, 1, 3), (8, 8, 3), (5, 9, 4), (40, 3, 1), (30, 41, 3), (16, 16, 2)):
        data = rng.integers(0, 256, h * w * c, dtype=np.uint8).tobytes()
        assert np.array_equal(VI._tensor(data, h, w, c, 16), _slow(data, h, w, c, 16))


def test_tensors_leave_as_one_array(spark):
    rng = np.random.default_rng(3)
    rows = [(f"p{i}", i % 2 if i else None, 4, 5, 3, bytearray(rng.integers(0, 256, 60, dtype=np.uint8).tobytes())) for i in range(70)]
    rows += [("bad", 1, -1, -1, -1, bytearray()), ("cut", 0, 4, 5, 3, bytearray(b"xyz")), ("none", 0, 4, 5, 3, None)]
    df = spark.createDataFrame(rows, "path string, label int, height int, width int, n_channels int, data binary").coalesce(1)
    ready = VI.prepare_images(df, 6)
    assert "MapInArrow" in ready._jdf.queryExecution().optimizedPlan().toString()
    got = {r["path"]: r for r in ready.collect()}
    assert len(got) == 73 and all(got[p]["tensor"] is None for p in ("bad", "cut", "none"))
    for path, label, h, w, c, data in rows[:70]:
        assert got[path]["label"] == label
        assert np.array_equal(np.float32(got[path]["tensor"]), _slow(bytes(data), h, w, c, 6))


@pytest.fixture
def one_group(spark, tmp_path):
    """Tables of one row group over more splits than cores; some rows come twice, some values are NULL."""
    n = 6_000
    rng = np.random.default_rng(5)
    ids = [i if i % 10 else 7 for i in range(n)]
    pq.write_table(pa.table({
        "event_id": pa.array(ids, pa.int64()), "ts": pa.array([0] * n, pa.timestamp("us")),
        "user_id": pa.array([None if i % 97 == 5 else i % 300 for i in range(n)], pa.int64()),
        "event_type": pa.array([None if i % 89 == 3 else ("view", "click")[i % 2] for i in range(n)]),
        "value": rng.random(n), "props": [rng.bytes(20).hex() for _ in range(n)]}), tmp_path / "events.parquet")
    pq.write_table(pa.table({
        "page_id": pa.array(range(40), pa.int64()), "url": [f"https://www.site{i}.org/p" for i in range(40)],
        "html": ['<a href="/x">x</a><a href="https://paypa1.com/">y</a>'] * 40}), tmp_path / "pages.parquet")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    yield str(tmp_path), n
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_no_task_of_the_corpus_holds_a_whole_row_group(spark, one_group):
    d, n = one_group
    cores = spark.sparkContext.defaultParallelism
    assert spark.read.parquet(f"{d}/events.parquet").rdd.getNumPartitions() >= cores
    corpus = P.corpus(spark, d)
    assert corpus.filter("source = 'event'").count() == n and max(_sizes(corpus)) <= 1.2 * n / cores


def test_feature_long_makes_a_decimal_once_for_each_value(spark, one_group):
    d, _ = one_group
    got = QUERIES["feature_long"](spark, d)
    v = F.round("value", 6)
    want = FE.feature_long(P.corpus(spark, d).select("source", "seq", "url")).groupBy("feature").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(v != 0).alias("n_nonzero"),
        F.sum(v.cast("decimal(38,6)")).cast("decimal(38,6)").alias("total"), F.max(v).alias("top"))
    assert [(f.name, f.dataType) for f in got.schema] == [(f.name, f.dataType) for f in want.schema]
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "decimal" not in plan[plan.index("Expand"):] and plan.count("Aggregate") == 2


def test_feature_long_adds_up_the_decimal_of_every_url(spark, one_group):
    plan = QUERIES["feature_long"](spark, one_group[0])._jdf.queryExecution().optimizedPlan().toString()
    first = plan[plan.rindex("Aggregate ["):].splitlines()[0]  # the one that reads the rows
    keys, _, sums = first.partition("],")
    assert "value" not in keys and "decimal(38,6)" in sums and "round(value" in sums


def test_the_feature_table_leaves_memory_to_the_trees(spark, monkeypatch):
    class Kept(Exception):
        pass

    df = spark.createDataFrame([("http://a.com/", 0), ("http://b.com/", 1)], "url string, label int")

    def persist(self, *level):
        raise Kept(*level)

    monkeypatch.setattr(type(df), "persist", persist)
    with pytest.raises(Kept) as seen:
        TR.train(df)
    assert seen.value.args and not seen.value.args[0].useMemory and seen.value.args[0].useDisk
