"""Exact nearest records by cosine similarity, and what is judged on them.

``nearest`` and ``rank_of`` work on blocks of vectors (``blocks``); ``scored`` makes every
pair a row, for reports that need all scores. There the queries are broadcast only if they
are at most ``BROADCAST_QUERIES`` rows (counted first); beyond, they are dealt to blocks and
each block meets the corpus by a keyed join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.functions.text import or_else
from quernstone.functions.vectors import dot, normalised
from quernstone.operators import blocks

BROADCAST_QUERIES, QUERY_BLOCK = 10_000, 1_000
TOP_K, SCORE_MIN, NOT_FOUND = 5, 0.48, 10**6


def space(df: DataFrame, id_col: str, vector: Column, *keep: str) -> DataFrame:
    """id, unit vector ``v``, and further columns: one named vector space."""
    return df.select(F.col(id_col).alias("id"), normalised(vector).alias("v"), *keep)


def scored(queries: DataFrame, corpus: DataFrame, same: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """query_id, id, score of every query against every other record of one space.
    ``same``: also a query against the record with its own id. ``keep``: further columns of
    the queries."""
    asked = queries.select(F.col("id").alias("query_id"), F.col("v").alias("q"), *keep)
    count = asked.count()
    if count <= BROADCAST_QUERIES:
        pairs = corpus.select("id", "v").crossJoin(F.broadcast(asked))
    else:
        n = -(-count // QUERY_BLOCK)
        asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(n)).cast("int"))
        pairs = corpus.select("id", "v", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("block")).join(asked, "block")
    pairs = pairs if same else pairs.where("id <> query_id")
    return pairs.select("query_id", "id", dot(F.col("q"), F.col("v")).alias("score"), *keep)


def top_k(scores: DataFrame, k: int = TOP_K) -> DataFrame:
    """The best k records of each query, with ``rank`` from 1; ties to the smaller id."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k)


def nearest(queries: DataFrame, corpus: DataFrame, k: int = TOP_K, same: bool = False) -> DataFrame:
    """query_id, id, score, rank: the best k records of each query, as ``top_k`` of
    ``scored`` gives, but by blocks: only each task's best records become rows."""
    return top_k(blocks.nearest(queries, corpus, k, same), k)


def split_at(queries: DataFrame, hits: DataFrame, threshold: float = SCORE_MIN) -> DataFrame:
    """query_id, kept, dropped_below: the threshold is inclusive and acts after the top k;
    queries without hits have zeros."""
    counts = hits.groupBy("query_id").agg(F.count_if(F.col("score") >= threshold).alias("kept"), F.count_if(F.col("score") < threshold).alias("dropped_below"))
    return queries.select(F.col("id").alias("query_id")).join(counts, "query_id", "left").na.fill(0, ["kept", "dropped_below"])


def results(hits: DataFrame, threshold: float = SCORE_MIN) -> DataFrame:
    """One row per query: its hits at or above the threshold, best first, and how many
    were dropped."""
    good = F.col("score") >= threshold
    return hits.groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.when(good, F.struct("rank", "id", "score")))).alias("hits"), F.count_if(~good).alias("dropped_below_threshold")
    )


def rank_of(expected: DataFrame, queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """``expected`` (query_id, expected_id) with the expected record's full rank. The rank
    is one more than the number of better records, so nothing is sorted; null if the
    record is missing. The expected records are scored by a keyed join of two vectors; the
    better ones are counted in blocks (``blocks.better``)."""
    wanted = expected.select(F.col("query_id").alias("id"), "expected_id").distinct().join(queries.select("id", "v"), "id")
    own = wanted.join(corpus.select(F.col("id").alias("expected_id"), F.col("v").alias("w")), "expected_id")
    own = own.where("id <> expected_id").select("id", "v", "expected_id", dot(F.col("v"), F.col("w")).alias("own"))
    ranks = blocks.better(own, corpus).select("query_id", "expected_id", (F.col("better") + 1).alias("rank"))
    return expected.join(ranks, ["query_id", "expected_id"], "left")


def rank_in(expected: DataFrame, hits: DataFrame, missing: int = NOT_FOUND) -> DataFrame:
    """``expected`` with the rank and score inside the top k, or ``missing`` and null."""
    found = hits.select("query_id", F.col("id").alias("expected_id"), "rank", "score")
    return expected.join(found, ["query_id", "expected_id"], "left").withColumn("rank", F.coalesce("rank", F.lit(missing)))


#: Fields of a hit in a response; a payload of an older shape gives empty texts.
HIT_FIELDS = ("date", "component", "problem", "symptoms", "cause", "solution", "resolution", "questions_summary")
QUERY_FIELDS = ("component", "problem", "symptoms", "error_codes", "cause", "solution", "resolution", "questions_summary")


def decoded_hits(entries: DataFrame, entry: str = "entry") -> DataFrame:
    """Raw hits as JSON texts -> point_id, score, payload (map) and ticket_id; what is missing
    is empty or zero."""
    hit = F.from_json(F.col(entry), "id string, score double, payload map<string,string>")
    rows = entries.withColumn("__hit", hit)
    rows = rows.withColumns({"point_id": F.coalesce("__hit.id", F.lit("")), "score": F.coalesce("__hit.score", F.lit(0.0)), "payload": F.coalesce("__hit.payload", F.create_map().cast("map<string,string>"))})
    return rows.withColumn("ticket_id", F.coalesce(F.try_element_at("payload", F.lit("ticket_id")), F.lit(""))).drop("__hit")


def requests_as_tickets(requests: DataFrame) -> DataFrame:
    """Search requests (ticket_id, date, category, subject, body, comments: role, created_at,
    body) in the shape of raw tickets. No date means today; comments are of the ordinary kind,
    their role may be unknown, their time empty."""
    comment = lambda c: F.struct(F.lit("zwyczajny").alias("kind"), or_else(c["role"], "nieznany").alias("role"), F.coalesce(c["created_at"], F.lit("")).alias("created_at"), c["body"].alias("body"))
    none = F.array().cast("array<struct<kind:string,role:string,created_at:string,body:string>>")
    return requests.select("ticket_id", F.coalesce("date", F.current_date()).alias("date"), "category", "subject", "body", F.coalesce(F.transform("comments", comment), none).alias("comments"))


def responses(queries: DataFrame, hits: DataFrame, payloads: DataFrame, threshold: float = SCORE_MIN) -> DataFrame:
    """query_id, query, hits, dropped_below_threshold: one row for each of ``queries``
    (query_id and the parsed fields), ``hits`` being query_id, rank, id, score and
    ``payloads`` id, ticket_id and the fields of a hit. Hits at or above the threshold, best
    first, each with ten named fields, empty where the payload lacks them."""
    good = F.col("score") >= threshold
    told = lambda f: F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f)
    hit = F.struct("rank", F.struct(told("ticket_id"), "score", *[told(f) for f in HIT_FIELDS]).alias("hit"))
    found = hits.join(payloads.select("id", "ticket_id", *HIT_FIELDS), "id", "left").groupBy("query_id").agg(F.sort_array(F.collect_list(F.when(good, hit))).alias("hits"), F.count_if(~good).alias("dropped_below_threshold"))
    asked = queries.select("query_id", F.struct(*[f for f in QUERY_FIELDS if f in queries.columns]).alias("query"))
    out = asked.join(found, "query_id", "left").withColumn("hits", F.transform("hits", lambda h: h["hit"]))
    return out.select("query_id", "query", F.coalesce("hits", F.array()).alias("hits"), F.coalesce("dropped_below_threshold", F.lit(0)).alias("dropped_below_threshold"))
