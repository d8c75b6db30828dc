"""Queries of the catalogue against plain Python, on tables made for it."""

import random

import numpy as np

from quernstone.plans import catalogue


def test_embedding_text_is_whole(spark, tmp_path):
    rows = [(1, "en", "word " * 50 + "end"), (2, None, "x" * 101), (3, "de", None), (4, "fr", "")]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["embedded"] for r in catalogue.embedding_text(spark, str(tmp_path)).collect()}
    assert got == {i: "\n".join(x for x in (lang, text) if x is not None) for i, lang, text in rows}


def test_searches_take_every_fiftieth_row(spark, tmp_path):
    draw = random.Random(8)
    rows = [(i, [draw.gauss(0, 1) for _ in range(40)], draw.randrange(3)) for i in range(330)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    v = np.array([r[1] for r in rows])
    v /= np.linalg.norm(v, axis=1)[:, None]
    half = v[:, :32] / np.linalg.norm(v[:, :32], axis=1)[:, None]
    best, ranks = {}, {}
    for q in range(0, 330, 50):
        order = sorted((i for i in range(330) if i != q), key=lambda i: (-(v[q] @ v[i]), i))
        best[q] = order[:5]
        ranks[q] = order.index(min((i for i in range(330) if i != q), key=lambda i: (-(half[q] @ half[i]), i))) + 1
    got = {}
    for r in catalogue.search_topk(spark, str(tmp_path)).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == best
    assert {r["query_id"]: r["rank"] for r in catalogue.rank_full(spark, str(tmp_path)).collect()} == ranks
    assert {r["n"] for r in catalogue.recall_curve(spark, str(tmp_path)).where("grouping = 'overall'").collect()} == {7}
