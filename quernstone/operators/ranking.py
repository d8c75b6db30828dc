"""Running totals and ranks of any size, by a two-level scan.

A key (or the whole table) with more than a share of all rows is cut into ranges of its
order. The cuts come from a sample of the key's order values and are then fixed: they are
collected into a written table of bounded size, so a row's range depends on the row alone,
whatever partitions, retries or adaptive execution do. Totals of the ranges, combined
before their shuffle, give each range its offset; inside a range a window runs. So there is
one shuffle of the rows, and no task holds more than about one range.

Cuts separate values of the order: rows of one key and one order value are in one range.
Give an order that tells rows apart (a struct with an id last)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.tables import written

#: Rows of a key in one range at least; ranges of all keys together at most (about).
RANGE_ROWS, RANGES = 250_000, 10_000
#: Sampled order values for each range.
SAMPLES = 40


def cuts(rows: DataFrame, range_rows: int = RANGE_ROWS, ranges: int = RANGES) -> DataFrame | None:
    """__key, __cuts of the keys with more than ``range_rows`` rows: groups of cut values,
    ascending. At most ``2 * ranges`` cuts in all. None if there is no such key."""
    sizes = rows.groupBy("__key").agg(F.count(F.lit(1)).alias("n"))
    most, total = sizes.agg(F.max("n"), F.sum("n")).first()
    if (most or 0) <= range_rows:
        return None
    line = max(range_rows, total // ranges)
    hot = sizes.where(F.col("n") > line).select(F.col("__key").alias("__hot"), "n", F.ceil(F.col("n") / line).cast("long").alias("parts"))
    share = F.greatest(F.floor(F.col("n") / (F.col("parts") * SAMPLES)), F.lit(1))
    met = rows.join(F.broadcast(hot), F.col("__key").eqNullSafe(F.col("__hot"))).select("__key", "parts", "__order", share.alias("share"))
    met = met.where(F.pmod(F.xxhash64("__order"), "share") == 0)
    found = met.groupBy("__key", "parts").agg(F.sort_array(F.collect_set("__order")).alias("v"))
    place = lambda i: F.element_at("v", F.floor(i * F.size("v") / F.col("parts")).cast("int") + 1)
    flat = F.when((F.col("parts") > 1) & (F.size("v") > 0), F.transform(F.sequence(F.lit(1).cast("long"), F.greatest(F.col("parts") - 1, F.lit(1))), place))
    width = F.ceil(F.sqrt(F.size("c"))).cast("int")
    grouped = F.transform(F.sequence(F.lit(0), F.ceil(F.size("c") / F.col("w")).cast("int") - 1), lambda g: F.slice("c", g * F.col("w") + 1, F.col("w")))
    out = found.select("__key", flat.alias("c")).where("c is not null").withColumn("w", width).select("__key", grouped.alias("__cuts"))
    return written(out.coalesce(1), "cuts")


def range_of(order: Column, grouped: Column) -> Column:
    """The number of cuts at or below ``order``, by two searches; 0 where there are none."""
    width = F.size(grouped[0])
    at = F.size(F.filter(grouped, lambda g: g[0] <= order))
    inner = F.size(F.filter(F.get(grouped, at - 1), lambda c: c <= order))
    return F.when(grouped.isNull() | (at == 0), F.lit(0)).otherwise((at - 1) * width + inner)


def running(rows: DataFrame, by: Sequence[str], order: Sequence[Column], value: Column | None = None, out: str = "running", before: bool = False, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``rows`` with ``out``: the sum of ``value`` (none: the number of rows) over the rows
    of the same key up to and with this one, or without it (``before``). ``order``: ascending,
    nulls first; wrap what should come otherwise. Null keys are a key."""
    keyed = rows.withColumns({"__key": F.struct(*by) if by else F.lit(0), "__order": F.struct(*order), "__value": F.lit(1).cast("long") if value is None else value})
    found = cuts(keyed.select("__key", "__order"), range_rows)
    extent = (Window.unboundedPreceding, -1) if before else (Window.unboundedPreceding, 0)
    if found is None:
        total = F.sum("__value").over(Window.partitionBy("__key").orderBy("__order").rowsBetween(*extent))
        return keyed.withColumn(out, F.coalesce(total, F.lit(0)) if before else total).select(*rows.columns, out)
    ranged = keyed.join(F.broadcast(found.withColumnRenamed("__key", "__hot")), F.col("__key").eqNullSafe(F.col("__hot")), "left")
    ranged = ranged.withColumn("__range", range_of(F.col("__order"), F.col("__cuts"))).drop("__cuts")
    sums = ranged.where("__hot is not null").groupBy("__hot", "__range").agg(F.sum("__value").alias("s"))
    upto = Window.partitionBy("__hot").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # at most one row for each range
    offsets = sums.select(F.col("__hot").alias("__at"), F.col("__range").alias("__r"), F.coalesce(F.sum("s").over(upto), F.lit(0)).alias("__offset"))
    inside = F.sum("__value").over(Window.partitionBy("__key", "__range").orderBy("__order").rowsBetween(*extent))
    inside = F.coalesce(inside, F.lit(0)) if before else inside
    met = ranged.withColumn("__in", inside).join(F.broadcast(offsets), F.col("__hot").eqNullSafe(F.col("__at")) & (F.col("__range") == F.col("__r")) & F.col("__hot").isNotNull(), "left")
    return met.withColumn(out, F.col("__in") + F.coalesce("__offset", F.lit(0))).select(*rows.columns, out)
