"""Joins that hold whatever share of all rows a key has."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a key may have in one task; bound on the keys that are broadcast to be spread.
HOT_ROWS, HOT_KEYS = 1_000, 10_000


def spread_join(rows: DataFrame, facts: DataFrame, keys: list[str], sizes: DataFrame, by: str, how: str = "inner", hot_rows: int | None = None) -> DataFrame:
    """``rows`` joined with ``facts`` (one row for each key), whatever the keys' shares.
    ``sizes`` has the keys and ``size``, their number of rows. A key above the line (one
    in ``HOT_KEYS`` of all rows) is dealt to blocks by the hash of column ``by``, and its
    row of ``facts`` is repeated for each. So fewer than ``HOT_KEYS`` keys are broadcast."""
    total, most = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.max("size"), F.lit(0))).first()
    line = max(HOT_ROWS if hot_rows is None else hot_rows, total // HOT_KEYS)
    if most <= line:
        return rows.join(facts, keys, how)
    hot = F.broadcast(sizes.where(F.col("size") > line).select(*keys, F.ceil(F.col("size") / line).cast("int").alias("__blocks")))
    dealt = rows.join(hot, keys, "left").withColumn("__block", F.coalesce(F.pmod(F.xxhash64(by), "__blocks"), F.lit(0)).cast("int")).drop("__blocks")
    repeated = facts.join(hot, keys, "left").withColumn("__block", F.explode(F.sequence(F.lit(0), F.coalesce("__blocks", F.lit(1)) - 1))).drop("__blocks")
    return dealt.join(repeated, [*keys, "__block"], how).drop("__block")
