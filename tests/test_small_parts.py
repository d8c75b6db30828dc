"""Small parts that no other test meets."""

import pytest
from pyspark.sql import functions as F

from quernstone.functions import text
from quernstone.operators import index, quality, validate


def test_section_of_a_document():
    doc = "# Title\n\n## One\nfirst\nlines\n\n## Two\nsecond\n"
    assert text.section(doc, "## One") == "first\nlines" and text.section(doc, "## Two") == "second" and text.section(doc, "## Three") == ""


def test_tokens_are_words(spark):
    rows = spark.createDataFrame([("a  b\nc",), ("",), (None,)], "t string")
    assert [r[0] for r in rows.select(text.tokens_estimate(F.col("t"))).collect()] == [3, 0, None]


def test_first_ids_of_each_rule(spark):
    rows = spark.createDataFrame([(i, "brak" if i % 2 else "brak danych " + "x " * 20) for i in range(50)], "id int, t string")
    rules = {"no_resolution": quality.no_resolution(), "short": lambda t: F.when(F.length(t) < 5, t)}
    got = {r["rule"]: (r["dropped"], r["shown"], r["more"]) for r in quality.dropped_ids(quality.verdicts(rows, "t", rules), "id").collect()}
    assert got == {rule: (25, list(range(1, 21, 2)), 15) for rule in rules}
    none = quality.dropped_ids(quality.verdicts(rows.where("id < 0"), "t", rules), "id")
    assert none.count() == 0
    shown = spark.range(1).select(quality.listed(F.array(*[F.lit(i) for i in range(13)])).alias("l")).first()["l"]
    assert (shown["shown"], shown["more"]) == (list(range(10)), 3)


def test_point_as_it_is_sent(spark):
    rows = spark.createDataFrame([("p", [1.0, 0.0], [0.0, 1.0])], "point_id string, vector_problem array<double>, vector_sts array<double>").withColumn("payload", F.struct(F.lit("7").alias("ticket_id")))
    point = rows.select(index.wire(rows).alias("p")).first()["p"]
    assert point["id"] == "p" and point["vector"]["problem"] == [1.0, 0.0] and point["vector"]["sts"] == [0.0, 1.0] and point["payload"]["ticket_id"] == "7"


def test_vocabulary_is_a_table(spark, monkeypatch):
    words = spark.createDataFrame([(1, "fixed"), (1, "open"), (2, "other")], "version int, name string")
    good = '{"ticket_id":"7","date":"2024-05-06","component":"a","problem":"p","symptoms":"s","cause":"c","solution":"x","resolution":"%s","resolution_vocabulary_version":%d}'
    rows = spark.createDataFrame([(1, good % ("open", 1)), (2, good % ("other", 1)), (3, good % ("other", 2))], "id int, j string")
    told = lambda version: {r["id"]: list(r["errors"]) for r in validate.validated_by(rows, "j", version, words).collect()}
    assert told(1) == {1: [], 2: ["rekord: resolution is not in the vocabulary"], 3: ["rekord: vocabulary version is not 1"]}
    assert told(2) == {1: ["rekord: vocabulary version is not 2"], 2: ["rekord: vocabulary version is not 2"], 3: []}
    with pytest.raises(validate.VocabularyError, match="no names"):
        told(3)
    monkeypatch.setattr(validate, "NAMES", 1)
    with pytest.raises(validate.VocabularyError, match="more than 1"):
        told(1)
