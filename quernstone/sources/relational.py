"""Relational tables by JDBC: reads in parallel ranges, filters and columns pushed down."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.operators.export import nested

#: Rows of a range, and ranges at most.
ROWS, PARTITIONS = 100_000, 200


def read_table(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A table in one task; Spark pushes filters and columns down."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def bounds(spark: SparkSession, url: str, table: str, column: str, where: str | None = None, **options: str) -> tuple:
    """Smallest, largest value of ``column`` and the number of rows, by the database."""
    name = spark.sparkContext._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier(column)
    query = f"select min({name}) as low, max({name}) as high, count(*) as n from {table}" + (f" where {where}" if where else "")
    return tuple(spark.read.format("jdbc").options(url=url, query=query, **options).load().first())


def read_ranges(spark: SparkSession, url: str, table: str, column: str, where: str | None = None, rows: int = ROWS, partitions: int = PARTITIONS, **options: str) -> DataFrame:
    """A table (or what ``where``, in the database's SQL, leaves of it) by ranges of a
    numeric or time ``column``, about ``rows`` each, whose bounds are the table's own minimum
    and maximum; rows with a null there come with the first range. An empty table is one task."""
    low, high, n = bounds(spark, url, table, column, where, **options)
    source = f"(select * from {table} where {where}) t" if where else table
    if not n or low is None or low == high:
        return read_table(spark, url, source, **options)
    ranges = {"partitionColumn": column, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(max(1, min(partitions, -(-n // rows))))}
    return read_table(spark, url, source, **ranges, **options)


def ids_of(spark: SparkSession, url: str, table: str, id_col: str, equal: Mapping[str, object], column: str | None = None, **options: str) -> DataFrame:
    """The ids of the rows with given values, ascending; the database gets the filter and
    sends the ids alone."""
    rows = read_ranges(spark, url, table, column, **options) if column else read_table(spark, url, table, **options)
    for name, value in equal.items():
        rows = rows.where(F.col(name) == value)
    return rows.select(id_col).orderBy(id_col)


def read_nested(spark: SparkSession, url: str, parent: str, child: str, key: str, child_key: str, order: list[str], fields: list[str], out: str, rows: int = ROWS, **options: str) -> DataFrame:
    """Rows of ``parent`` with the ordered array of their rows in ``child``; both are read
    by ranges of the key."""
    left = read_ranges(spark, url, parent, key, rows=rows, **options)
    right = read_ranges(spark, url, child, child_key, rows=rows, **options)
    return nested(left, right.withColumnRenamed(child_key, key) if child_key != key else right, key, order, fields, out)
