import os
import re

import pytest

import corpus_pipeline
from quernstone.llm import queries

SF = "/root/testdata/sf0.001"


def test_stages_are_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "toxicity", "exact_dedup", "near_dedup", "packing"]
    assert set(queries.oracle_sql()) <= set(queries.queries())


def test_stages_on_edge_cases(spark, docs, empty):
    for df in (docs, empty):
        rows = df.select("doc_id", "text", "lang", "source", "row")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, rows, SF) if os.path.isdir(SF) else rows
            assert after.columns == rows.columns
            rows = after.cache()
        packed = corpus_pipeline.STAGES[-1][1](spark, rows, SF)
        assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in rows.collect()}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_run_keeps_one_of_each_group(spark):
    from quernstone.llm.common import read
    from quernstone.llm.minhash import near_groups

    kept = [r[0] for r in corpus_pipeline.run(spark, SF).select("doc_id").distinct().collect()]
    docs = read(spark, SF, "documents")
    rest = docs.join(spark.createDataFrame([(k,) for k in kept], "doc_id long"), "doc_id", "left_semi")
    assert 0 < len(kept) < docs.count()
    assert near_groups(rest).where("not kept").count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_each_stage_keeps_what_its_operator_says(spark):
    """Stage by stage on the predecessor's rows: languages and scores from the operators'
    columns, both kinds of copies by brute force."""
    from pyspark.sql import functions as F

    from quernstone.llm.common import read
    from quernstone.llm.language_id import identified
    from quernstone.llm.toxicity import toxicity
    from test_dedup import shingle_set

    docs, stages = read(spark, SF, "documents"), dict(corpus_pipeline.STAGES)
    kept = lambda name: stages[name](spark, docs, SF).cache()
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())

    after = kept("language_id")
    assert ids(after) == ids(docs.select("doc_id", identified(docs).alias("p")).where("p.lang <> 'und'"))
    docs = after
    after = kept("toxicity")
    assert ids(after) == ids(docs.select("doc_id", toxicity(docs, read(spark, SF, "labels")).alias("s")).where("s < 0.5"))
    docs = after
    first = {}
    for r in sorted(docs.collect(), key=lambda r: r["doc_id"]):
        first.setdefault(re.sub("[\x20\x09-\x0d]+", " ", r["text"] or ""), r["doc_id"])
    docs = kept("exact_dedup")
    assert ids(docs) == sorted(first.values())
    sets = {r["doc_id"]: shingle_set(r["text"]) for r in docs.collect()}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    order = sorted(sets)
    for k, a in enumerate(order):
        for b in order[k + 1 :]:
            small, large = sorted((len(sets[a]), len(sets[b])))
            if small and 4 * small >= 3 * large and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    docs = kept("near_dedup")
    assert ids(docs) == [i for i in order if top(i) == i]
    packed = stages["packing"](spark, docs, SF)
    assert sorted({r["doc_id"] for r in packed.select("doc_id").collect()}) == ids(docs)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0
