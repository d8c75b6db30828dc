"""The keyed index: what an upsert writes, its order, repeated batches, and streams."""

import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quernstone.operators import index
from quernstone.streaming import incremental

ROWS = "point_id string, text string, at long"


def folders(path):
    data = f"{path}/data"
    return {(d, b) for d in os.listdir(data) for b in os.listdir(f"{data}/{d}") if b.startswith(index.BUCKET)} if os.path.isdir(data) else set()


def rows_of(spark, path):
    return {r["point_id"]: r["text"] for r in index.load(spark, path).collect()}


def test_one_row_rewrites_one_bucket(spark, tmp_path):
    path = str(tmp_path / "index")
    many = spark.range(500).select(F.concat(F.lit("p"), "id").alias("point_id"), F.lit("old").alias("text"), F.col("id").alias("at"))
    assert index.upsert(spark, path, many, buckets=16) == 500
    before = folders(path)
    assert len(before) == 16
    assert index.upsert(spark, path, spark.createDataFrame([("p7", "new", 1)], ROWS)) == 1
    assert len(folders(path) - before) == 1
    got = rows_of(spark, path)
    assert len(got) == 500 and got["p7"] == "new" and got["p8"] == "old"
    assert index.vacuum(spark, path) == 1 and rows_of(spark, path) == got and len(folders(path)) == 16


def test_a_batch_counts_once(spark, tmp_path):
    path = str(tmp_path / "index")
    rows = spark.createDataFrame([("a", "one", 1), ("b", "two", 1)], ROWS)
    assert index.upsert(spark, path, rows, batch=("s", 0)) == 2
    assert index.upsert(spark, path, spark.createDataFrame([("a", "three", 2)], ROWS), batch=("s", 1)) == 1
    before = folders(path)
    assert index.upsert(spark, path, rows, batch=("s", 0)) == 0
    assert folders(path) == before and rows_of(spark, path) == {"a": "three", "b": "two"}
    assert index.upsert(spark, path, rows, batch=("t", 0)) == 2  # another source
    assert rows_of(spark, path)["a"] == "one"


def test_empty_and_null_and_further_columns(spark, tmp_path):
    path = str(tmp_path / "index")
    none = spark.createDataFrame([], ROWS)
    assert index.upsert(spark, path, none) == 0 and index.load(spark, path).count() == 0
    assert index.upsert(spark, path, spark.createDataFrame([("a", None, 1)], ROWS)) == 1
    wider = spark.createDataFrame([("b", "x", 1, 2.0)], ROWS + ", score double")
    assert index.upsert(spark, path, wider) == 1
    assert sorted(map(tuple, index.load(spark, path).select("point_id", "text", "score").collect())) == [("a", None, None), ("b", "x", 2.0)]


def test_second_writer_fails(spark, tmp_path):
    path = str(tmp_path / "index")
    index.upsert(spark, path, spark.createDataFrame([("a", "x", 1)], ROWS))
    found = index.manifest(spark, path)
    with pytest.raises(index.IndexError_, match="another writer"):
        index.swap(spark, path, found)
    assert rows_of(spark, path) == {"a": "x"}


def test_failed_write_leaves_the_old_index(spark, tmp_path):
    path = str(tmp_path / "index")
    index.upsert(spark, path, spark.createDataFrame([("a", "x", 1)], ROWS))
    bad = spark.createDataFrame([("a", "y", 1)], ROWS).withColumn("text", F.raise_error(F.lit("broken")))
    with pytest.raises(Exception, match="broken"):
        index.upsert(spark, path, bad)
    assert rows_of(spark, path) == {"a": "x"}


def test_last_row_of_a_batch_wins(spark, tmp_path):
    path, source = str(tmp_path / "index"), str(tmp_path / "in")
    rows = [(f"k{i}", f"old{i}", 1) for i in range(5)] + [(f"k{i}", f"new{i}", 2) for i in range(5)]
    spark.createDataFrame(rows, ROWS).repartition(4).write.parquet(source)
    incremental.keep_index(spark, incremental.file_stream(spark, source), path, str(tmp_path / "c"), order="at").awaitTermination()
    assert rows_of(spark, path) == {f"k{i}": f"new{i}" for i in range(5)}


def test_repeated_batch_of_a_stream(spark, tmp_path):
    path, source, checkpoint = str(tmp_path / "index"), str(tmp_path / "in"), str(tmp_path / "c")
    spark.createDataFrame([("a", "x", 1)], ROWS).write.parquet(source)
    incremental.keep_index(spark, incremental.file_stream(spark, source), path, checkpoint).awaitTermination()
    index.upsert(spark, path, spark.createDataFrame([("a", "later", 2)], ROWS))
    for name in os.listdir(f"{checkpoint}/commits"):  # as if the driver had died before the commit
        os.remove(f"{checkpoint}/commits/{name}")
    incremental.keep_index(spark, incremental.file_stream(spark, source), path, checkpoint).awaitTermination()
    assert rows_of(spark, path) == {"a": "later"}


def test_write_as_you_go(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "c"))
    for i in range(3):
        spark.createDataFrame([(f"a{i}", "x", i)], ROWS).write.mode("append").parquet(source)
        incremental.write_as_you_go(incremental.file_stream(spark, source, ROWS), out, checkpoint).awaitTermination()
        assert spark.read.parquet(out).count() == i + 1


EVENTS = "ts timestamp, event_type string, value double"


def test_activity_restarts_from_its_state(spark, tmp_path):
    source, path, checkpoint = (str(tmp_path / n) for n in ("in", "index", "c"))
    noon = datetime(2024, 1, 1, 12)
    at = lambda minutes: noon + timedelta(minutes=minutes)
    first = [(at(1), "view", 1.0), (at(50), "view", 2.0), (at(61), "click", 4.0), (at(65), "view", 8.0)]
    second = [(at(58), "view", 16.0), (at(64), "click", 32.0), (at(130), "view", 64.0)]  # 12:58 is late, but within 10 minutes of 13:05
    third = [(at(59), "view", 128.0), (at(125), "view", 256.0)]  # 12:59 is beyond the watermark now
    for rows in (first, second, third):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(source)
        incremental.keep_activity(spark, incremental.file_stream(spark, source, EVENTS), path, checkpoint).awaitTermination()
    got = {(r["start"].hour, r["event_type"]): (r["n"], r["total"]) for r in index.load(spark, path).collect()}
    assert got == {(12, "view"): (3, 19.0), (13, "click"): (2, 36.0), (13, "view"): (1, 8.0), (14, "view"): (2, 320.0)}


def test_activity_of_a_stream_equals_the_batch(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "index")
    rows = spark.range(2000).select((F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(mins=F.col("id").cast("int"))).alias("ts"), F.when(F.col("id") % 3 == 0, "view").otherwise("click").alias("event_type"), F.col("id").cast("double").alias("value"))
    rows.repartitionByRange(5, "ts").write.parquet(source)
    stream = incremental.file_stream(spark, source, files_per_batch=1)
    incremental.keep_activity(spark, stream, path, str(tmp_path / "c"), late="10 days").awaitTermination()
    want = incremental.activity(spark.read.parquet(source))
    assert sorted(map(tuple, index.load(spark, path).drop("window_key").collect())) == sorted(map(tuple, want.collect()))
