"""Exact dedup by a heavy-hitter split.

1. One pass over the texts writes (id, digest) to the shared folder; the digest is
   SHA-256 of the text with runs of white space made one space.
2. Misra-Gries counters find the frequent digests. Spark's ``approx_top_k`` keeps
   them as a Frequent-Items sketch of at most ``tracked`` counters per task, which
   merge map-side; any digest above about n/tracked rows is among them.
3. The candidates are counted exactly (a second, cheap pass). Their winners, at most
   ``heavy`` rows, are broadcast, so copies of a frequent text are decided map-side
   and never meet in one task.
4. All other digests use an ordinary shuffle: counts and smallest rows, combined map-side,
   and a join of the rows with them in which digests above a share of all rows are spread.

Every step is a DataFrame or SQL function.

Edge cases: a null text counts as empty; empty texts equal each other; a null id
sorts after all others; of rows with equal text and equal id exactly one is kept;
an empty table gives an empty result; other columns are ignored, whatever their name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm.common import drop_rows, numbered, read, spread_join, written

#: Misra-Gries counters, and how many of the most frequent digests are taken from
#: them. The second bounds the broadcast: 1024 rows of about 60 bytes.
TRACKED, HEAVY = 4096, 1024

WHITE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row: Column | None = None) -> DataFrame:
    """One row per input row: id, sha (32 bytes), row (a number that sets equal rows
    apart; the caller's, if it has one)."""
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.unhex(F.sha2(normalised(F.col(text_col)).cast("binary"), 256)).alias("sha"),
        (F.monotonically_increasing_id() if row is None else row).alias("row"),
    )
    return written(rows, "digests")


def frequent(rows: DataFrame, tracked: int = TRACKED, heavy: int = HEAVY) -> DataFrame:
    """Candidate 64-bit digest keys by Misra-Gries; at most ``heavy`` rows."""
    top = rows.select(F.xxhash64("sha").alias("key")).agg(F.expr(f"approx_top_k(key, {heavy}, {tracked})").alias("top"))
    return top.select(F.explode("top").alias("t")).where("t.count > 1").select(F.col("t.item").alias("key"))


def exact_groups(rows: DataFrame, tracked: int = TRACKED, heavy: int = HEAVY) -> DataFrame:
    """doc_id, keep_id, group_size, kept, sha, row for every row of ``digests``."""
    order = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), F.col("row").alias("row"))
    keyed = rows.withColumn("order", order)
    hot = F.broadcast(frequent(rows, tracked, heavy))
    least = [F.count(F.lit(1)).alias("size"), F.min("order").alias("first")]
    winners = written(keyed.join(hot, F.xxhash64("sha") == hot["key"], "left_semi").groupBy("sha").agg(*least).where("size > 1"), "winners")
    first = F.coalesce("first", "order")
    out = ["doc_id", first["id"].alias("keep_id"), F.coalesce("size", F.lit(1)).alias("group_size"), (first == F.col("order")).alias("kept"), "sha", "row"]
    seen = keyed.join(F.broadcast(winners), "sha")
    rest = keyed.join(F.broadcast(winners.select("sha")), "sha", "left_anti")
    groups = written(rest.groupBy("sha").agg(*least).where("size > 1"), "groups")
    return seen.select(out).unionByName(spread_join(rest, groups, ["sha"], groups, by="row", how="left").select(out))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_groups(digests(read(spark, sf_dir, "documents")))
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts. Rows are dropped by number, so
    ids may be null or repeated."""
    rows, row = numbered(docs)
    copies = exact_groups(digests(rows, row=F.col(row))).where("not kept").select(F.col("row").alias(row))
    return drop_rows(rows, copies, row).select(docs.columns)


ORACLE = r"""
with t as (
  select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents)
select doc_id, min(doc_id) over w as keep_id, count(*) over w as group_size,
       doc_id = min(doc_id) over w as kept, text_sha256
from t window w as (partition by text_sha256)
"""
