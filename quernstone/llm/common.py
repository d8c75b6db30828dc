"""What the training-data operators share: row numbers, and the split of documents into
learning and held-out rows; written tables and spread joins are the library's."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.operators.joins import spread_join
from quernstone.tables import new_path, plain_scan, scope, scratch, shared_dir, written

__all__ = ["crc_mod", "drop_rows", "held_out", "new_path", "numbered", "read", "scope", "scratch", "shared_dir", "spread_join", "written"]

#: Files whose numbers are broadcast; beyond, they are joined by a shuffle.
FEW_FILES = 100_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def crc_mod(doc_id: str = "doc_id", mod: int = 5) -> Column:
    """crc32 of the id written as decimal text, modulo ``mod``."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % mod


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the fifth of documents that no model learns from (a null id is
    never learned from either)."""
    return F.coalesce(crc_mod(doc_id) == 0, F.lit(True))


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with one more column that numbers its rows, and that column's name, which
    no other has. Every later read sees the same numbers. Rows of a plain scan of Parquet files
    are numbered by file and place in it. All others are written first: rows made by explode,
    joins or unions may share a place in a file."""
    row = "row_number"
    while row in (c.lower() for c in docs.columns):
        row += "_"
    try:
        if "_metadata" in docs.columns or not plain_scan(docs):
            raise AnalysisException("rows may share a place")
        placed = docs.select("*", F.col("_metadata.file_path").alias(f"{row}_file"), F.col("_metadata.row_index").alias(f"{row}_at"))
    except AnalysisException:
        return written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered"), row
    # in one partition the increasing ids are 0, 1, 2, ...
    names = placed.select(f"{row}_file").distinct().coalesce(1).select(f"{row}_file", F.shiftleft(F.monotonically_increasing_id(), 33).alias(f"{row}_base"))
    names = written(names, "files")
    rows = placed.join(F.broadcast(names) if names.count() <= FEW_FILES else names, f"{row}_file")
    return rows.select(*[rows[c] for c in docs.columns], (F.col(f"{row}_base") + F.col(f"{row}_at")).alias(row)), row


def drop_rows(docs: DataFrame, dropped: DataFrame, key: str = "doc_id") -> DataFrame:
    """``docs`` without the rows whose ``key`` is in ``dropped``; rows whose key is null
    stay. Where ids may be null or repeated, the key is the one of ``numbered``."""
    return docs.join(dropped.select(key).where(F.col(key).isNotNull()), key, "left_anti").select(docs.columns)
