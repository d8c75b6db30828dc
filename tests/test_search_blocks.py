"""Block-wise search and exact selection against one row for each pair and plain sorts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernstone.operators import blocks, evaluate, search


def table(spark, n, size=8, seed=1, ties=True):
    draw = random.Random(seed)
    v = [[draw.gauss(0, 1) for _ in range(size)] for _ in range(n)]
    if ties:  # a third of the records are copies of one
        v = [v[0] if i % 3 == 1 else x for i, x in enumerate(v)]
    return search.space(spark.createDataFrame(list(enumerate(v)), "i int, e array<double>").repartition(5), "i", F.col("e"))


@pytest.mark.parametrize("same", [False, True])
@pytest.mark.parametrize("small", [False, True])
def test_nearest_equals_pairs(spark, monkeypatch, same, small):
    if small:  # several passes and blocks
        monkeypatch.setattr(blocks, "QUERIES", 7)
    corpus = table(spark, 300)
    queries = corpus.where("id % 10 < 2")
    got = sorted(map(tuple, search.nearest(queries, corpus, 4, same).select("query_id", "rank", "id", "score").collect()))
    want = search.top_k(search.scored(queries, corpus, same), 4)
    assert got == sorted(map(tuple, want.select("query_id", "rank", "id", "score").collect()))
    assert len(got) == 240


def test_ranks_equal_pairs(spark):
    corpus = table(spark, 200)
    queries = corpus.where("id % 20 = 1")
    pairs = [(q, e) for q in range(1, 200, 20) for e in (q, 0, 4, 7, 199, 1000)]
    expected = spark.createDataFrame(pairs, "query_id int, expected_id int")
    got = {(r["query_id"], r["expected_id"]): r["rank"] for r in search.rank_of(expected, queries, corpus).collect()}
    order = {}
    for r in search.scored(queries, corpus).collect():
        order.setdefault(r["query_id"], []).append((-r["score"], r["id"]))
    for (q, e), rank in got.items():
        ids = [i for _, i in sorted(order[q])]
        assert rank == (ids.index(e) + 1 if e in ids else None)
    assert len(got) == len(pairs)


def test_blocks_edges(spark):
    corpus = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0]), (4, [None, 1.0]), (5, [0.0, 0.0]), (6, [0.6, 0.8])], "id int, v array<double>")
    one = corpus.where("id = 1")
    assert [tuple(r) for r in search.nearest(one, corpus, 9).orderBy("rank").select("id", "score").collect()] == [(6, 0.6), (5, 0.0)]
    assert search.nearest(corpus.where("id > 9"), corpus, 3).count() == 0
    assert search.nearest(one, corpus.where("id > 9"), 3).count() == 0
    text = corpus.withColumn("id", F.concat(F.lit("k"), "id"))
    assert [r["id"] for r in search.nearest(text.where("id = 'k1'"), text, 1).collect()] == ["k6"]


def brute(values):
    v, n = sorted(values), len(values)
    at = lambda share: v[min(n - 1, int(share * n))]
    return (n, v[0], at(0.05), at(0.25), (v[(n - 1) // 2] + v[n // 2]) / 2, at(0.75), at(0.95), v[-1])


@pytest.mark.parametrize("bins", [4, 1024])
def test_distribution_equals_a_sort(spark, monkeypatch, bins):
    monkeypatch.setattr(evaluate, "selected", lambda *a, f=evaluate.selected, **k: f(*a, **k, bins=bins))
    draw = random.Random(4)
    series = {
        "uniform": [draw.random() for _ in range(501)],
        "one value": [0.25] * 300,
        "two": [0.1, 0.2],
        "single": [7.5],
        "skewed": [10.0 ** draw.randint(-8, 8) for _ in range(400)],
        "close": [1.0 + k * 2.0**-50 for k in (draw.randrange(40) for _ in range(200))],
        None: [draw.random() for _ in range(77)],
        "mostly one": [0.5] * 900 + [draw.gauss(0, 100) for _ in range(30)],
    }
    rows = [(s, x) for s, values in series.items() for x in values] + [("uniform", None), ("none", None)]
    got = {r["series"]: tuple(r)[1:] for r in evaluate.distribution(spark.createDataFrame(rows, "series string, score double").repartition(4)).collect()}
    assert got == {s: brute(v) for s, v in series.items()}


def test_distribution_has_no_window_over_a_series(spark):
    rows = spark.range(1000).select(F.lit("s").alias("series"), F.rand(1).alias("score"))
    plan = evaluate.distribution(rows)._jdf.queryExecution().toString()
    assert "Window" not in plan and "Sort " not in plan


def test_median_length_of_integers(spark):
    rows = spark.createDataFrame([("a",), ("bbb",), ("cc",), ("dddd",), (None,)], "t string")
    assert evaluate.median_length(rows, "t").first()["median_length"] == 2.5
    assert np.isclose(evaluate.distribution(rows.select(F.lit(1).alias("series"), F.length("t").alias("score"))).first()["max"], 4)
