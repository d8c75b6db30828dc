"""The relational source against Spark's own Derby, and one file for each record."""

import json
import os

import pytest
from pyspark.sql import functions as F

from quernstone.operators import export
from quernstone.sources import documents, relational, tickets

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def derby(spark):
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    url = "jdbc:derby:memory:tickets;create=true"
    orders = spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus")
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity")
    for name, rows in (("orders", orders), ("lineitem", lines)):
        rows.coalesce(1).write.format("jdbc").options(url=url, dbtable=name, createTableColumnTypes="o_orderstatus varchar(8)" if name == "orders" else "l_linenumber int").mode("overwrite").save()
    return url, orders, lines


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ranges_cover_the_table(spark, derby):
    url, orders, _ = derby
    low, high, n = relational.bounds(spark, url, "orders", "o_orderkey")
    assert (low, high, n) == orders.agg(F.min("o_orderkey"), F.max("o_orderkey"), F.count("*")).first()
    got = relational.read_ranges(spark, url, "orders", "o_orderkey", rows=100)
    assert got.rdd.getNumPartitions() == -(-n // 100)
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == n and max(sizes) < 3 * 100
    assert got.exceptAll(orders).count() == 0


def test_filter_and_columns_are_pushed_down(spark, derby):
    url, orders, _ = derby
    got = relational.ids_of(spark, url, "orders", "o_orderkey", {"o_orderstatus": "O"}, column="o_orderkey")
    assert [r[0] for r in got.collect()] == sorted(r[0] for r in orders.where("o_orderstatus = 'O'").select("o_orderkey").collect())
    told = plan(got)
    assert "PushedFilters: [*IsNotNull(o_orderstatus), *EqualTo(o_orderstatus,O)]" in told
    assert "ReadSchema: struct<o_orderkey:bigint>" in told and "Filter (" not in told


def test_where_goes_to_the_database(spark, derby):
    url, orders, _ = derby
    got = relational.read_ranges(spark, url, "orders", "o_orderkey", where="\"o_orderstatus\" = 'F'", rows=50)
    assert got.count() == orders.where("o_orderstatus = 'F'").count() and got.rdd.getNumPartitions() > 1
    none = relational.read_ranges(spark, url, "orders", "o_orderkey", where='"o_orderkey" < 0', rows=50)
    assert none.count() == 0 and none.rdd.getNumPartitions() == 1


def test_nested_from_the_database(spark, derby):
    url, orders, lines = derby
    got = relational.read_nested(spark, url, "orders", "lineitem", "o_orderkey", "l_orderkey", ["l_linenumber"], ["l_quantity"], "lines", rows=200)
    want = export.nested(orders, lines.withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey", ["l_linenumber"], ["l_quantity"], "lines")
    flat = lambda df: sorted((r[0], tuple(map(tuple, r["lines"] or []))) for r in df.collect())
    assert flat(got) == flat(want)
    counts = export.reconciled(got, "lines", orders, lines.withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey").first()
    assert counts["complete"]


def test_ids_of_a_module(spark, derby, tmp_path):
    url = derby[0]
    rows = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b")], "id int, modul string")
    rows.write.format("jdbc").options(url=url, dbtable="records", createTableColumnTypes="modul varchar(8)").mode("overwrite").save()
    assert [r[0] for r in tickets.ids_of_module(spark, url, "records", "a").collect()] == [1, 3]


def test_one_file_for_each_record(spark, tmp_path):
    folder = str(tmp_path / "the out")
    rows = spark.createDataFrame([(1, '{"a":"é"}'), (2, "[]"), (30, None)], "id int, doc string").repartition(3)
    tickets.write_files(rows, folder, "id", "doc")
    assert sorted(os.listdir(folder)) == ["1.json", "2.json", "30.json"] and os.path.isfile(f"{folder}/1.json")
    assert json.load(open(f"{folder}/1.json", encoding="utf-8")) == {"a": "é"} and open(f"{folder}/30.json").read() == ""
    got = {r["name"]: r["text"] for r in documents.read_documents(spark, folder).collect()}
    assert got["2"] == "[]"
    tickets.write_files(spark.createDataFrame([(2, "{}"), (4, "{}")], "id int, doc string"), (tmp_path / "the out").as_uri(), "id", "doc")
    assert sorted(os.listdir(folder)) == ["1.json", "2.json", "30.json", "4.json"] and open(f"{folder}/2.json").read() == "{}"
    documents.write_documents(rows.limit(1), folder, F.lit("only"), F.col("doc"), overwrite=True)
    assert os.listdir(folder) == ["only.json"]


def test_failed_task_leaves_no_file(spark, tmp_path):
    folder = str(tmp_path / "out")
    rows = spark.range(0, 40, 1, 4).select("id", F.when(F.col("id") == 35, F.raise_error(F.lit("broken"))).otherwise(F.lit("{}")).alias("doc"))
    with pytest.raises(Exception, match="broken"):
        tickets.write_files(rows, folder, "id", "doc")
    seen = lambda: [f for f in os.listdir(folder) if not f.startswith("_")] if os.path.isdir(folder) else []
    assert seen() == []
    for bad in ("a/b", "", None, ".hidden"):
        with pytest.raises(Exception, match="can't name a document"):
            documents.write_documents(spark.createDataFrame([(bad, "x")], "n string, t string"), folder, F.col("n"), F.col("t"))
    assert seen() == []


def test_golden_distractors_vocabulary_and_prompt(spark, tmp_path):
    put = lambda name, value: (tmp_path / name).write_text(value if isinstance(value, str) else json.dumps(value)) and str(tmp_path / name)
    golden = tickets.read_golden(spark, put("golden.json", {"queries": [{"expected_ticket_id": 7, "query_raw": "q", "expected_problem": "p", "kind": "k", "difficulty": "d"}]}))
    assert tuple(golden.first()) == (7, "q", "p", "k", "d")
    silent = tickets.read_distractors(spark, put("silent.json", {"queries": [{"id": "d1", "class": "c", "query_raw": "q"}]}))
    assert tuple(silent.first()) == ("d1", "c", "q")
    words = tickets.read_vocabulary(spark, put("words.json", {"version": 3, "classes": [{"name": "b", "hint": "x"}, {"name": "a", "hint": "y"}]}))
    assert [tuple(r) for r in words.orderBy("position").collect()] == [(3, 0, "b", "x"), (3, 1, "a", "y")]
    assert tickets.read_prompt(spark, put("prompt.md", "<!-- note\nof two lines -->\nAsk {{thread}}")) == "Ask {{thread}}"
