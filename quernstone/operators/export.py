"""Nested documents from relational tables, and the check that none is missing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nested(parent: DataFrame, child: DataFrame, key: str, order: Sequence[str], fields: Sequence[str], out: str) -> DataFrame:
    """``parent`` with an ordered array of its children; null without any."""
    rows = child.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*order, *[f for f in fields if f not in order]))).alias(out))
    return parent.join(rows, key, "left")


def author_role(consultant: Column, user: Column) -> Column:
    return F.when(consultant.isNotNull(), "konsultant").when(user.isNotNull(), "klient").otherwise("brak")


def reconciled(documents: DataFrame, children: str, parents: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """documents, parents, nested_rows, source_rows and whether both pairs agree; one row."""
    have = documents.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum(F.when(F.col(children).isNull(), 0).otherwise(F.size(children))), F.lit(0)).alias("nested_rows"))
    want = parents.agg(F.count(F.lit(1)).alias("parents"))
    source = rows.join(parents.select(key), key).agg(F.count(F.lit(1)).alias("source_rows"))
    one = lambda df: df.withColumn("one", F.lit(1))  # noqa: E731  one row each
    out = one(have).join(one(want), "one").join(one(source), "one").drop("one")
    return out.withColumn("complete", (F.col("documents") == F.col("parents")) & (F.col("nested_rows") == F.col("source_rows")))
