"""Written tables: what a job reads more than once goes to the folder that driver and
executors share, so a lost executor costs a re-read, not a recomputation.

A call that makes tables for itself opens a ``scratch``: its tables lie in a folder of
their own, which is deleted at the end, and only that. Calls in other threads have other
folders. Tables that a lazy result still reads are written ``into`` the caller's folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Rows of a small table's file.
FILE_ROWS = 200_000

#: The folder of the innermost ``scratch`` of this thread.
SCOPE: ContextVar[str | None] = ContextVar("scope", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the
    session. Only a local master may leave it unset (tests): one is made then."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="quernstone-")
        spark.conf.set("spark.checkpoint.dir", folder)
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def scope(spark: SparkSession) -> str:
    return SCOPE.get() or f"{shared_dir(spark)}/quernstone"


def new_path(spark: SparkSession, name: str, into: str | None = None) -> str:
    return f"{into or scope(spark)}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> bool:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """Tables written inside are deleted at the end. Around a write of a lazy result it
    deletes all that the result was made from."""
    folder = new_path(spark, "call")
    token = SCOPE.set(folder)
    try:
        yield folder
    finally:
        SCOPE.reset(token)
        delete(spark, folder)


def written(df: DataFrame, name: str, rows: int | None = None, into: str | None = None) -> DataFrame:
    """``df`` as a table in the shared folder: its lineage ends there. ``rows``: about how
    many there are, if that is known, so that few rows become few files."""
    spark = df.sparkSession
    path = new_path(spark, name, into)
    (df if rows is None else df.coalesce(1 + rows // FILE_ROWS)).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def plain_scan(df: DataFrame) -> bool:
    """Does ``df`` only read files, select and filter, so that each row is one row of a file
    and every later read gives the same rows in the same splits and order?"""
    left = [df._jdf.queryExecution().optimizedPlan()]
    while left:
        node = left.pop()
        if node.getClass().getSimpleName() not in ("LogicalRelation", "Project", "Filter") or not node.deterministic():
            return False
        children = node.children()
        left += [children.apply(i) for i in range(children.size())]
    return True
