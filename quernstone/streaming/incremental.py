"""Incremental upkeep of the index, of parsed artifacts and of windowed counts by
Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import TimestampNTZType

from quernstone.operators.index import upsert


def keep_index(
    spark: SparkSession,
    source: DataFrame,
    path: str,
    checkpoint: str,
    prepare: Callable[[DataFrame], DataFrame] = lambda df: df,
    key: str = "point_id",
    order: str | None = None,
    mode: str = "append",
    buckets: int | None = None,
) -> StreamingQuery:
    """Upserts each micro-batch of ``source`` into the index at ``path``: only the buckets
    that it touches are written. ``order``: the column by which the last of several rows with
    one key inside a batch is chosen; between batches the later batch wins. A batch that
    runs again after a failure changes nothing, as the index knows its number."""

    def one(batch: DataFrame, number: int) -> None:
        upsert(spark, path, prepare(batch), key, order=order, batch=(checkpoint, number), buckets=buckets)

    return source.writeStream.foreachBatch(one).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_as_you_go(source: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends finished artifacts batch by batch; an aborted run keeps what it wrote."""
    return source.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def file_stream(spark: SparkSession, path: str, schema=None, files_per_batch: int | None = None) -> DataFrame:
    """A table of Parquet files (a folder, or one file) as a stream of its files; files that
    come later are read by a later run."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    folder = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()
    source = spark.readStream.schema(schema or spark.read.parquet(path).schema)
    if files_per_batch:
        source = source.option("maxFilesPerTrigger", files_per_batch)
    return source.parquet(path) if folder else source.option("pathGlobFilter", at.getName()).parquet(at.getParent().toString())


def activity(events: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Counts and sums by event type in tumbling windows, with a watermark; works on a
    stream and on a table. A stream's times without a zone are taken in the session's."""
    if events.isStreaming and events.schema["ts"].dataType == TimestampNTZType():
        events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    at = events.withWatermark("ts", late) if events.isStreaming else events
    return at.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def keep_activity(spark: SparkSession, events: DataFrame, path: str, checkpoint: str, late: str = "10 minutes", window: str = "1 hour") -> StreamingQuery:
    """Keeps the windowed counts of a stream of events in the index at ``path``, keyed by
    window and type. The state store holds the windows that the watermark leaves open; each
    batch upserts the windows that it changed. Events later than the watermark are dropped."""
    rows = activity(events, late, window)
    named = lambda df: df.withColumn("window_key", F.concat_ws("|", F.col("start").cast("long"), "event_type"))
    return keep_index(spark, rows, path, checkpoint, named, "window_key", mode="update")
