"""Places and running totals of large keys against a plain sort."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quernstone.operators import index, ranking, sampling

N = 400_000


@pytest.fixture(params=["true", "false"])
def adaptive(spark, request):
    spark.conf.set("spark.sql.adaptive.enabled", request.param)
    yield request.param
    spark.conf.unset("spark.sql.adaptive.enabled")


def test_places_equal_a_plain_sort(spark, adaptive):
    rows = spark.range(0, N, 1, 4).select("id", F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.concat(F.lit("c"), F.pmod(F.xxhash64("id"), F.lit(3)))).alias("c"))
    got = sampling.placed_in(rows, "c", F.col("id").cast("string"), range_rows=10_000)
    assert got.columns == ["id", "c", "at"]
    want = rows.withColumn("want", F.row_number().over(Window.partitionBy("c").orderBy(F.col("id").cast("string"))) - 1)
    met = got.join(want, "id")
    assert met.count() == N
    assert met.where("at <> want").count() == 0


def test_stratified_equals_a_plain_sample(spark, adaptive, monkeypatch):
    rows = spark.range(0, N, 1, 4).select("id", F.when(F.col("id") % 7 < 5, "a").otherwise("b").alias("c"))
    monkeypatch.setattr(sampling, "running", lambda *a, **k: ranking.running(*a, **k, range_rows=10_000))
    got = {(r["id"], r["c"]) for r in sampling.stratified(rows, "c", "id", 200).collect()}
    want = set()
    for c in "ab":
        ids = sorted((i for i in range(N) if ("a" if i % 7 < 5 else "b") == c), key=str)
        quota = round(200 * len(ids) / N)
        step = max(1, len(ids) // quota)
        want |= {(i, c) for i in ids[::step][:quota]}
    assert got == want


def test_stratified_counts_repeated_ids(spark):
    draw = random.Random(5)
    rows = [(draw.randrange(40), draw.choice("xy")) for _ in range(300)]
    got = sorted(tuple(r) for r in sampling.stratified(spark.createDataFrame(rows, "id int, c string"), "c", "id", 30).collect())
    want = set()
    for c in "xy":
        ids = sorted((i for i, k in rows if k == c), key=str)
        quota = round(30 * len(ids) / 300)
        want |= {(i, c) for i in ids[:: max(1, len(ids) // quota)][:quota]}
    assert got == sorted(want)[:30]


def test_running_totals_of_a_hot_key(spark, adaptive):
    rows = spark.range(0, 60_000, 1, 4).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 50).alias("k"), "id", (F.col("id") % 11).alias("v"))
    got = rows.select("*", F.lit(1).alias("one"))
    got = ranking.running(got, ["k"], [F.col("id")], F.col("v"), range_rows=2_000)
    want = rows.withColumn("want", F.sum("v").over(Window.partitionBy("k").orderBy("id")))
    assert got.join(want, ["k", "id"]).where("running = want").count() == 60_000


def test_whole_table_is_one_key(spark):
    rows = spark.range(0, 30_000, 1, 4).select((F.pmod(F.xxhash64("id"), F.lit(100))).alias("s"), "id")
    got = ranking.running(rows, [], [-F.col("s"), F.col("id")], range_rows=500)
    want = rows.withColumn("want", F.row_number().over(Window.orderBy(F.desc("s"), "id")))
    assert got.join(want, "id").where("running = want").count() == 30_000
    assert ranking.running(rows.where("id < 0"), [], [F.col("id")]).count() == 0


def test_hot_key_is_in_many_tasks(spark):
    rows = spark.range(0, 40_000, 1, 4).select(F.lit(1).alias("k"), "id")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    got = ranking.running(rows, ["k"], [F.col("id")], range_rows=1_000).groupBy(F.spark_partition_id().alias("p")).count().collect()
    spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(got) == 4 and max(r["count"] for r in got) < 25_000


def test_running_column(spark):
    rows = spark.createDataFrame([(1, 1, 5), (1, 2, 6), (2, 1, 7)], "k int, o int, v int")
    assert sorted(tuple(r) for r in index.running(rows, "k", "o", "v", "t").collect()) == [(1, 1, 5, 5), (1, 2, 6, 11), (2, 1, 7, 7)]
