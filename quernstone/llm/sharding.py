"""Sharding by weighted rendezvous hashing.

Every (record key, shard) pair has a pseudo-random number u in (0, 1) from MD5; the
record goes to the shard with the smallest -ln(u) / weight. A new shard wins only the
records for which its own number is smallest, so growing from n to n + 1 shards moves
about 1/(n+1) of the rows, all of them into the new shard. A shard with weight w gets
a share of w / (sum of weights).

Only DataFrame functions are used. Slots (a gapless row number in each shard) are
given in blocks of bounded size, with the blocks' offsets from their counts, so that
no task holds a whole shard.

Edge cases: null text has size 16 and crc 0; a null key hashes as the empty text; rows
with the same key go to the same shard, each with its own slot; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.llm.common import read, written

SHARDS = 40
#: Rows that get their slots in one task.
BLOCK_ROWS = 250_000


def distance(key: Column, shard: Column, weight: Column) -> Column:
    """-ln(u) / weight with u from the first 52 bits of MD5(key:shard)."""
    digest = F.md5(F.concat(key, F.lit(":"), shard.cast("string")).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)
    return -F.log(u) / weight


def nearest(key: Column, weights: Sequence[float]) -> Column:
    """struct(distance, shard) of the winning shard; ties to the smaller shard."""
    shards = F.array(*[F.struct(F.lit(s).alias("shard"), F.lit(float(w)).alias("weight")) for s, w in enumerate(weights)])
    return F.array_min(F.transform(shards, lambda x: F.struct(distance(key, x["shard"], x["weight"]).alias("distance"), x["shard"].alias("shard"))))


def assign(df: DataFrame, key: Column, weights: Sequence[float], new_weight: float = 1.0) -> DataFrame:
    """``df`` with shard, and grown_shard after a shard of ``new_weight`` is added."""
    k = F.coalesce(key.cast("string"), F.lit(""))
    n = len(weights)
    won = df.withColumns({"__best": nearest(k, weights), "__new": distance(k, F.lit(n), F.lit(float(new_weight)))})
    return won.withColumns(
        {"shard": F.col("__best.shard"), "grown_shard": F.when(F.col("__new") < F.col("__best.distance"), F.lit(n)).otherwise(F.col("__best.shard"))}
    ).drop("__best", "__new")


def with_slots(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``rows`` (shard, row and others) with ``slot``: gapless from 0 in each shard."""
    most = rows.groupBy("shard").count().agg(F.max("count")).first()[0] or 0
    blocks = max(1, -(-most // block_rows))
    rows = rows.withColumn("block", F.pmod("row", F.lit(blocks)))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n")).select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    ranked = rows.withColumn("at", F.row_number().over(Window.partitionBy("shard", "block").orderBy(F.col("doc_id").asc_nulls_last(), "row")))
    return ranked.join(offsets, ["shard", "block"]).withColumn("slot", (F.col("offset") + F.col("at") - 1).cast("long")).drop("block", "at", "offset")


def op5_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = read(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.monotonically_increasing_id().alias("row"),
    )
    placed = written(assign(rows, F.col("doc_id"), [1.0] * SHARDS), "shards")
    return with_slots(placed).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def crc_table() -> list[int]:
    """The byte table of CRC-32 (its reversed polynomial is a fixed value)."""
    out = []
    for value in range(256):
        for _ in range(8):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        out.append(value)
    return out


def oracle() -> str:
    """The query in SQL. With equal weights the smallest -ln(u) is the largest u. Slots are
    those of shards of at most ``BLOCK_ROWS`` rows."""
    step = f"xor(c >> 8, ({crc_table()}::bigint[])[((xor(c, b)) & 255) + 1])"
    number = "(('0x' || substr(md5(coalesce(doc_id::varchar, '') || ':' || s), 1, 13))::bigint + 0.5::double)"
    return f"""
with t as (select row_number() over () as row, doc_id, encode(coalesce(text, '')) as raw from documents),
x as (select *, hex(raw) as h from t),
c as (select row, doc_id, octet_length(raw) + 16 as size,
        xor(list_reduce(list_transform(range(0, octet_length(raw)), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::bigint), lambda c, b: {step}, 4294967295::bigint), 4294967295::bigint) as text_crc32 from x),
u as (select row, doc_id, size, text_crc32, s, {number} as u from c, (select unnest(range(0, {SHARDS + 1})) as s)),
g as (select row, any_value(doc_id) as doc_id, any_value(size) as size, any_value(text_crc32) as text_crc32, max_by(s, u) filter (where s < {SHARDS}) as shard, max_by(s, u) as grown from u group by row)
select doc_id, size, text_crc32, 'key' as law, shard::int as shard, row_number() over (partition by shard order by doc_id nulls last, row) - 1 as slot, grown::int as grown_shard from g"""
