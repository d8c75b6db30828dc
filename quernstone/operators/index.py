"""The index: one row per point with named unit vectors and a payload, keyed by a
deterministic id, so that building twice gives the same rows."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quernstone.functions.ids import uuid5
from quernstone.functions.vectors import normalised
from quernstone.operators import ranking
from quernstone.tables import delete, scratch, written

PAYLOAD = ("ticket_id", "date", "component", "problem", "symptoms", "error_codes", "cause", "solution", "resolution", "questions_summary", "resolution_vocabulary_version")
SPACES = ("problem", "sts")
#: Hash buckets of a new index: a bucket for so many rows, within bounds; rows of a file; the
#: name of the buckets' column.
BUCKET_ROWS, LEAST_BUCKETS, MOST_BUCKETS, FILE_ROWS, BUCKET = 1_000_000, 64, 50_000, 500_000, "__bucket"


class IndexError_(Exception):
    """The index is missing, empty, or has vectors of another size."""


def points(records: DataFrame, problem: Column, sts: Column) -> DataFrame:
    """point_id, vector_problem, vector_sts, payload of parsed records."""
    fields = [F.date_format("date", "yyyy-MM-dd").alias("date") if f == "date" else F.col(f) for f in PAYLOAD]
    return records.select(uuid5(F.col("ticket_id").cast("string")).alias("point_id"), normalised(problem).alias("vector_problem"), normalised(sts).alias("vector_sts"), F.struct(*fields).alias("payload"))


def wire(points: DataFrame) -> Column:
    """A point as it is sent: id, the named vectors in one struct, payload."""
    vectors = F.struct(*[points[f"vector_{space}"].alias(space) for space in SPACES])
    return F.struct(points["point_id"].alias("id"), vectors.alias("vector"), points["payload"])


def latest(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """The last row of each key. The row is found by a maximum that combines before the
    shuffle, so a key with very many rows does not meet in one task."""
    ranked = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    best = rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), ranked).alias("row"))
    return best.select(key, *[F.col(f"row.{c}").alias(c) for c in rows.columns if c != key]).select(rows.columns)


def check_size(index: DataFrame, size: int) -> None:
    bad = index.where((F.coalesce(F.size("vector_problem"), F.lit(-1)) != size) | (F.coalesce(F.size("vector_sts"), F.lit(-1)) != size)).limit(1).count()
    if bad:
        raise IndexError_(f"the index holds vectors of another size than {size}")


def create_or_verify(spark: SparkSession, path: str, vector_size: int) -> bool:
    """True if there is no index yet (the first upsert makes it); else checks the size of
    its vectors and gives False."""
    if manifest(spark, path) is None:
        return True
    check_size(load(spark, path), vector_size)
    return False


def drop(spark: SparkSession, path: str) -> bool:
    """Deletes the index with all its versions; False if there is none."""
    return delete(spark, path)


def manifest(spark: SparkSession, path: str) -> dict[str, Any] | None:
    """The newest manifest: number, key, buckets (how many), schema, files (bucket -> folder),
    batches (source -> last batch), rows (at most so many); None if there is no index."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    numbers = [int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit()]
    if not numbers:
        return None
    stream = fs.open(jvm.org.apache.hadoop.fs.Path(folder, f"{max(numbers)}.json"))
    try:
        return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def swap(spark: SparkSession, path: str, found: dict[str, Any]) -> None:
    """Makes ``found`` the newest manifest: it is written beside, then renamed. The rename
    fails if another writer was first, whose version then stands."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    beside = jvm.org.apache.hadoop.fs.Path(f"{path}/manifest/_{uuid.uuid4().hex}")
    fs = beside.getFileSystem(conf)
    stream = fs.create(beside, False)
    stream.write(json.dumps(found).encode())
    stream.close()
    kind = jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(kind, 1)
    how[0] = kind.NONE
    target = jvm.org.apache.hadoop.fs.Path(f"{path}/manifest/{found['number']}.json")
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(beside.toUri(), conf).rename(beside, target, how)
    except Py4JJavaError as error:
        fs.delete(beside, False)
        raise IndexError_(f"another writer made version {found['number']} of {path}") from error


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def buckets_for(rows: int) -> int:
    return max(LEAST_BUCKETS, min(MOST_BUCKETS, -(-rows // BUCKET_ROWS)))


def bucketed(rows: DataFrame, path: str, key: str, buckets: int, count: int) -> str:
    """Writes ``rows`` (about ``count``) as one folder of a bucket each, below a new folder; gives
    its name. A large bucket is several tasks' work."""
    name, parts = uuid.uuid4().hex, max(1, -(-count // (buckets * FILE_ROWS)))
    dealt = rows.withColumn(BUCKET, bucket_of(key, buckets)).repartition(BUCKET, F.pmod(F.xxhash64(F.lit("part"), key), F.lit(parts)))
    dealt.write.partitionBy(BUCKET).parquet(f"{path}/data/{name}")
    return name


def buckets_in(rows: DataFrame, key: str, buckets: int) -> list[int]:
    """The buckets that have rows; at most ``buckets`` numbers."""
    return sorted(r[0] for r in rows.select(bucket_of(key, buckets).alias(BUCKET)).distinct().collect())


def read_buckets(spark: SparkSession, path: str, found: dict[str, Any], which: Iterable[int] | None = None) -> DataFrame:
    schema = StructType.fromJson(found["schema"])
    names = found["files"] if which is None else {b: found["files"][str(b)] for b in which if str(b) in found["files"]}
    folders = [f"{path}/data/{name}/{BUCKET}={b}" for b, name in names.items()]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def upsert(spark: SparkSession, path: str, new: DataFrame, key: str = "point_id", order: str | None = None, batch: tuple[str, int] | None = None, buckets: int | None = None) -> int:
    """Merges ``new`` into the index at ``path``; gives the number of keys written.

    The index is a table in hash buckets of the key (``buckets``, or a number by the first
    batch's size; ``rebuild`` may choose another), and a manifest that names each bucket's folder. Only buckets that ``new`` touches are read and written again, into
    new folders; the manifest is swapped when they are whole, so readers see the old index
    or the new one, and a failed write leaves the old one.

    ``order``: the column by which the last of several new rows with one key is chosen
    (without it the row's hash decides, so that a rerun gives the same). ``batch``: a source
    and a rising number; a batch that was merged before changes nothing."""
    found = manifest(spark, path)
    if batch and found and found["batches"].get(batch[0], -1) >= batch[1]:
        return 0
    if found and found["key"] != key:
        raise IndexError_(f"the index at {path} has the key {found['key']}")
    with scratch(spark):
        staged = written(latest(new, key, ordered(new, key, order)), "staged")
        count = staged.count()
        buckets = found["buckets"] if found else buckets or buckets_for(count)
        touched = buckets_in(staged, key, buckets)
        files = dict(found["files"]) if found else {}
        if touched:
            rows = staged
            if found:
                old = read_buckets(spark, path, found, touched)
                rows = old.join(staged.select(key), key, "left_anti").unionByName(staged, allowMissingColumns=True)
            name = bucketed(rows, path, key, buckets, found["rows"] + count if found else count)
            files |= {str(b): name for b in touched}
        schema = rows.schema if touched else StructType.fromJson(found["schema"]) if found else new.schema
        batches = (found["batches"] if found else {}) | ({batch[0]: batch[1]} if batch else {})
        number = found["number"] + 1 if found else 0
        swap(spark, path, {"number": number, "key": key, "buckets": buckets, "schema": schema.jsonValue(), "files": files, "batches": batches, "rows": (found["rows"] if found else 0) + count})
        return count


def ordered(rows: DataFrame, key: str, order: str | None) -> Column:
    """What decides between rows of one key: a column, and the whole row's hash."""
    whole = F.xxhash64(*[c for c in rows.columns if c != key])
    return F.struct(F.col(order), whole) if order else whole


def load(spark: SparkSession, path: str) -> DataFrame:
    found = manifest(spark, path)
    if found is None:
        raise IndexError_(f"no index at {path}")
    return read_buckets(spark, path, found)


def rebuild(spark: SparkSession, path: str, new: DataFrame, key: str = "point_id", order: str | None = None, buckets: int | None = None) -> int:
    """A whole new index of ``new``; the old one stays in use until the manifest is swapped."""
    found = manifest(spark, path)
    with scratch(spark):
        staged = written(latest(new, key, ordered(new, key, order)), "staged")
        count = staged.count()
        buckets = buckets or buckets_for(count)
        name = bucketed(staged, path, key, buckets, count)
        files = {str(b): name for b in buckets_in(staged, key, buckets)}
    batches = found["batches"] if found else {}
    swap(spark, path, {"number": found["number"] + 1 if found else 0, "key": key, "buckets": buckets, "schema": new.schema.jsonValue(), "files": files, "batches": batches, "rows": count})
    return count


def vacuum(spark: SparkSession, path: str) -> int:
    """Deletes what the newest manifest doesn't name; gives the number of bucket folders
    deleted. Only when no reader uses an older version."""
    found = manifest(spark, path)
    if found is None:
        return 0
    jvm = spark.sparkContext._jvm
    fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    used, gone = {(name, f"{BUCKET}={b}") for b, name in found["files"].items()}, 0
    for folder in fs.listStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/data")):
        name = folder.getPath().getName()
        for part in fs.listStatus(folder.getPath()):
            if part.isDirectory() and (name, part.getPath().getName()) not in used:
                fs.delete(part.getPath(), True)
                gone += 1
    for file in fs.listStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")):
        if file.getPath().getName() != f"{found['number']}.json":
            fs.delete(file.getPath(), False)
    return gone


def size(spark: SparkSession, path: str) -> int:
    """Exact number of points; refuses a missing or empty index."""
    n = load(spark, path).count()
    if not n:
        raise IndexError_(f"the index at {path} is empty")
    return n


def running(rows: DataFrame, by: str, order: str, value: str, out: str = "running") -> DataFrame:
    """``rows`` with the running total of ``value`` in each key, by ``order``; a hot key is
    summed range by range (``ranking``)."""
    return ranking.running(rows, [by], [F.col(order)], F.col(value), out)
