import json

import pytest
from pyspark.sql import functions as F

from quernstone.operators import evaluate, export, index, quality, sampling, search, validate
from quernstone.sources import tickets
from quernstone.streaming import incremental


def points(spark, rows):
    df = spark.createDataFrame(rows, "id long, e array<double>")
    return search.space(df, "id", F.col("e"))


def test_top_k_breaks_ties_by_id(spark):
    corpus = points(spark, [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, [-1.0, 0.0])])
    hits = search.top_k(search.scored(corpus.where("id = 1"), corpus, same=True), 3)
    assert [(r["id"], round(r["score"], 6)) for r in hits.orderBy("rank").collect()] == [(1, 1.0), (2, 1.0), (3, 0.0)]


def test_many_queries_go_by_blocks(spark, monkeypatch):
    corpus = points(spark, [(i, [float(i), 1.0]) for i in range(12)])
    whole = sorted(search.scored(corpus, corpus).collect())
    monkeypatch.setattr(search, "BROADCAST_QUERIES", 3)
    monkeypatch.setattr(search, "QUERY_BLOCK", 4)
    assert sorted(search.scored(corpus, corpus).collect()) == whole


def test_threshold_is_inclusive_and_counts_all(spark):
    hits = spark.createDataFrame([(1, 1, 0.48), (1, 2, 0.4)], "query_id long, rank int, score double")
    queries = spark.createDataFrame([(1,), (2,)], "id long")
    assert sorted(map(tuple, search.split_at(queries, hits, 0.48).collect())) == [(1, 1, 1), (2, 0, 0)]


def test_recall_curve(spark):
    ranks = spark.createDataFrame([(1, "a"), (3, "a"), (7, "b")], "rank int, kind string")
    rows = evaluate.recall_curve(ranks, 5, ["kind"]).where("grouping = 'overall'").orderBy("k").collect()
    assert [round(r["recall"], 1) for r in rows] == [33.3, 33.3, 66.7, 66.7, 66.7]
    assert rows[0]["mrr"] == pytest.approx((1 + 1 / 3 + 1 / 7) / 3)


def test_sweep_counts_missing_and_silent(spark):
    correct = spark.createDataFrame([(1, 0.5), (2, 0.3), (3, None)], "query_id long, score double")
    silent = spark.createDataFrame([(9, 0.45), (10, None)], "query_id long, best double")
    row = evaluate.threshold_sweep(correct, silent, [0.5]).first()
    assert (row["kept"], row["cut"], row["silenced"]) == (1, 1, 2)
    assert row["kept_percent"] == pytest.approx(100 / 3)


def test_distribution_uses_floor_index(spark):
    values = [i / 10 for i in range(10)]
    row = evaluate.distribution(spark.createDataFrame([("s", v) for v in values], "series string, score double")).first()
    assert (row["n"], row["min"], row["p05"], row["p25"], row["p75"], row["p95"], row["max"]) == (10, 0.0, 0.0, 0.2, 0.7, 0.9, 0.9)
    assert row["median"] == pytest.approx(0.45)


def test_histogram_edges(spark):
    rows = evaluate.histogram(spark.createDataFrame([("s", 0.29), ("s", 1.0), ("s", 1.5), ("s", 0.0)], "series string, score double")).collect()
    assert {r["bin"]: r["share"] for r in rows} == {29: 25.0, 99: 25.0, 0: 25.0}


DROPPED = ["brak", "nie podano", "Brak rozstrzygnięcia w wątku.", "brak - nie ustalono", "W wątku nie ustalono przyczyny."]
KEPT = [
    "Brak możliwości wygenerowania dokumentu w tej sytuacji, klient musi zaakceptować pismo i poczekać na kolejną wersję systemu.",
    "Wyjaśniono działanie.",
    "Dodano brakujące ustawienie",
    "Uzupełniono brakującą stawkę",
]


@pytest.mark.parametrize(("solution", "keep"), [*((s, False) for s in DROPPED), *((s, True) for s in KEPT)])
def test_hollow_rule(spark, solution, keep):
    row = quality.verdicts(spark.createDataFrame([(solution,)], "s string"), "s").first()
    assert row["keep"] is keep
    assert keep or row["hits"][0]["evidence"] == solution.strip()[:80]


@pytest.mark.parametrize(("total", "dropped", "warns"), [(50, 0, True), (50, 10, False), (1, 0, False)])
def test_drop_rate_warning(spark, total, dropped, warns):
    judged = spark.range(total).withColumn("keep", F.col("id") >= dropped)
    assert (quality.report(judged).first()["warning"] is not None) is warns


def test_reports(spark):
    judged = quality.verdicts(spark.createDataFrame([(1, "brak"), (2, "ok"), (3, None)], "id long, s string"), "s")
    assert [tuple(r) for r in quality.by_reason(judged).collect()] == [("no_resolution", 1)]
    assert [r[0] for r in quality.ids_for(judged, "no_resolution", "id").collect()] == [1]
    assert tuple(quality.agreement(judged, spark.createDataFrame([(1,), (2,)], "id long"), "id").first()) == (1, 0, 1)
    assert sorted(r["id"] for r in quality.kept(judged, judged, "id").collect()) == [2, 3]


NAMES = ("naprawione", "bez_zmian_w_systemie", "brak")
GOOD = {"ticket_id": "1", "date": "2026-01-01", "component": "c", "problem": " p ", "symptoms": "s", "cause": "c", "solution": "s", "resolution": "brak", "resolution_vocabulary_version": 1, "error_codes": []}


@pytest.mark.parametrize(
    ("change", "error"),
    [
        ({}, None),
        ({"extra": 1}, "extra: unknown field"),
        ({"cause": "  "}, "cause: blank or missing"),
        ({"resolution_vocabulary_version": 2, "resolution": "?"}, "rekord: vocabulary version is not 1"),
        ({"resolution": "?"}, "rekord: resolution is not in the vocabulary"),
        ({"cause": "", "resolution_vocabulary_version": 2}, "cause: blank or missing"),
    ],
)
def test_validation(spark, change, error):
    row = validate.validated(spark.createDataFrame([(json.dumps(GOOD | change),)], "t string"), "t", 1, NAMES).first()
    assert row["errors"] == ([error] if error else [])
    assert error or row["record"]["problem"] == "p"


@pytest.mark.parametrize("bad", ["{", "[1]", "", None, "3"])
def test_not_an_object_is_reported(spark, bad):
    checked = validate.validated(spark.createDataFrame([(bad,)], "t string"), "t", 1, NAMES)
    assert checked.first()["errors"] == ["rekord: not a JSON object"]
    assert tuple(validate.summary(checked).first()) == (1, 1, False)


def test_empty_validation_passes(spark):
    assert validate.summary(validate.validated(spark.createDataFrame([], "t string"), "t", 1, NAMES)).first()["ok"]


def test_answers_take_the_sources_identity(spark):
    answer = "```json\n" + json.dumps(GOOD | {"ticket_id": "other", "resolution_vocabulary_version": 99}) + "\n```"
    rows = spark.createDataFrame([(answer, "7", "2026-02-03"), ("no", "8", "2026-02-03"), (json.dumps(GOOD | {"x": 1}), "9", "2026-02-03")], "a string, i string, d string")
    a, b, c = validate.parsed_answers(rows, "a", "i", "d", 1, NAMES).orderBy("i").collect()
    assert a["errors"] == [] and a["record"]["ticket_id"] == "7"
    assert b["record"] is None and c["errors"] == ["x: unknown field"]


def test_stratified(spark):
    rows = spark.createDataFrame([(i, "a") for i in (1, 2, 3, 4)] + [(5, "b"), (6, "b")], "id long, c string")
    assert [r["id"] for r in sampling.stratified(rows, "c", "id", 3).collect()] == [1, 3, 5]


def test_content_filter(spark):
    long_, comment = "x" * 51, "array<struct<body:string>>"
    rows = spark.createDataFrame([(1, "zamkniety", long_, [(long_,)]), (2, "zamkniety", "x" * 50, [(long_,)]), (3, "nowy", long_, [(long_,)]), (4, "zamkniety", long_, None)], f"id long, s string, d string, c {comment}")
    assert [r["id"] for r in rows.where(sampling.has_content(F.col("s"), F.col("d"), F.col("c"))).collect()] == [1]


def test_answer_problems(spark):
    f = lambda sent, tokens: spark.range(1).select(sampling.answer_problem(F.lit(sent), F.lit(tokens), 100)).first()[0]
    assert (f(10, 100), f(400, 90), f(100, 90), f(0, 0)) == ("window full", "prompt cut", None, None)


def test_export_and_reconciliation(spark):
    parents = spark.createDataFrame([(1,), (2,)], "k long")
    kids = spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "k long, n int, t string")
    out = export.nested(parents, kids, "k", ["n"], ["t"], "kids")
    assert {r["k"]: r["kids"] and [x["t"] for x in r["kids"]] for r in out.collect()} == {1: ["a", "b"], 2: None}
    assert export.reconciled(out, "kids", parents, kids, "k").first()["complete"]
    assert not export.reconciled(out.where("k = 2"), "kids", parents, kids, "k").first()["complete"]


def records(spark, ids):
    row = [(str(i), "2026-01-01", "c", "p", "s", [], "c", "s", "brak", "q", 1) for i in ids]
    schema = "ticket_id string, date string, component string, problem string, symptoms string, error_codes array<string>, cause string, solution string, resolution string, questions_summary string, resolution_vocabulary_version int"
    return index.points(spark.createDataFrame(row, schema).withColumn("date", F.to_date("date")), F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(1.0), F.lit(0.0)))


def test_index_twice_is_the_same(spark, tmp_path):
    path = str(tmp_path / "index")
    with pytest.raises(index.IndexError_):
        index.size(spark, path)
    assert index.upsert(spark, path, records(spark, [1, 2])) == 2
    first = sorted(map(str, index.load(spark, path).collect()))
    assert index.upsert(spark, path, records(spark, [1, 2])) == 2
    assert sorted(map(str, index.load(spark, path).collect())) == first
    index.upsert(spark, path, records(spark, [3]))
    assert index.size(spark, path) == 3
    index.check_size(index.load(spark, path), 2)
    with pytest.raises(index.IndexError_):
        index.check_size(index.load(spark, path), 3)
    assert index.rebuild(spark, path, records(spark, [5])) == 1 and index.size(spark, path) == 1


def test_streaming_index(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "index")
    records(spark, [1, 2]).write.parquet(source)
    for more in (None, [2, 3]):
        if more:
            records(spark, more).write.mode("append").parquet(source)
        stream = spark.readStream.schema(records(spark, [1]).schema).parquet(source)
        incremental.keep_index(spark, stream, path, str(tmp_path / "cp")).awaitTermination(120)
    assert index.size(spark, path) == 3


def test_ticket_files(spark, tmp_path):
    raw = {"zrodlo": "x", "tabela": "t", "zgloszenie": {"id": 7, "created_at": "2026-06-23 10:00", "szczegolowy_opis": "<p>A</p>"}, "komentarze": None}
    (tmp_path / "zgloszenie-7.json").write_text(json.dumps(raw))
    (tmp_path / "notes.txt").write_text("no")
    rows = tickets.read_raw(spark, str(tmp_path))
    row = rows.first()
    assert (row["ticket_id"], str(row["date"]), row["subject"], row["body"], row["comments"]) == ("7", "2026-06-23", "", "A", [])
    assert tickets.numbered(rows).first()["number"] == 7
    assert tickets.chosen(rows, ["7"]).count() == 1
    with pytest.raises(tickets.SourceError):
        tickets.chosen(rows, ["8"])
    assert tickets.read_texts(spark, str(tmp_path)).count() == 1


@pytest.mark.parametrize(
    ("change", "error"),
    [
        ({"ticket_id": None}, "ticket_id: not a text"),
        ({"date": "not a date"}, "date: not a date"),
        ({"date": "2026-02-30"}, "date: not a date"),
        ({"problem": 5}, "problem: not a text"),
        ({"error_codes": "E1"}, "error_codes: not a list of texts"),
        ({"error_codes": ["E1", None]}, "error_codes: not a list of texts"),
        ({"error_codes": []}, None),
        ({"resolution_vocabulary_version": "x"}, "resolution_vocabulary_version: not an integer"),
        ({"questions_summary": " "}, "questions_summary: blank or missing"),
    ],
)
def test_types_of_fields(spark, change, error):
    row = validate.validated(spark.createDataFrame([(json.dumps(GOOD | change),)], "t string"), "t", 1, NAMES).first()
    assert row["errors"] == ([error] if error else [])


def test_missing_fields_and_answers_of_wrong_types(spark):
    for f in ("ticket_id", "date", "problem", "resolution_vocabulary_version"):
        text = json.dumps({k: v for k, v in GOOD.items() if k != f})
        assert validate.validated(spark.createDataFrame([(text,)], "t string"), "t", 1, NAMES).first()["errors"] == [f"{f}: missing"]
    rows = spark.createDataFrame([(json.dumps(GOOD | {"problem": 5}), "1", "2026-01-01")], "a string, i string, d string")
    assert validate.parsed_answers(rows, "a", "i", "d", 1, NAMES).first()["errors"] == ["problem: not a text"]


def test_artifacts_are_read_in_order_and_strictly(spark, tmp_path):
    for name in ("b", "a"):
        (tmp_path / f"{name}.json").write_text(json.dumps(GOOD | {"ticket_id": name}))
    assert [r["ticket_id"] for r in tickets.read_artifacts(spark, str(tmp_path), 1, NAMES).collect()] == ["a", "b"]
    (tmp_path / "c.json").write_text(json.dumps(GOOD | {"problem": ""}))
    with pytest.raises(Exception, match="c.json: problem"):
        tickets.read_artifacts(spark, str(tmp_path), 1, NAMES).collect()


def test_ids_are_written_in_order(spark, tmp_path):
    path = str(tmp_path / "ids")
    tickets.write_ids(spark.range(500).orderBy(F.rand(3)), path)
    lines = [x for f in sorted((tmp_path / "ids").glob("part-*")) for x in f.read_text().split()]
    assert lines == [str(i) for i in range(500)]
    tickets.write_files(spark.createDataFrame([(1, "{}"), (2, "[]")], "id int, doc string"), str(tmp_path / "files"), "id", "doc")
    assert {p.name for p in (tmp_path / "files").iterdir() if p.is_file()} == {"1.json", "2.json"}


def test_hits_requests_and_responses(spark):
    rows = spark.createDataFrame([('{"id": "p", "score": 0.5, "payload": {"ticket_id": "7"}}',), ("{}",)], "entry string")
    got = [(r["point_id"], r["score"], r["ticket_id"], r["payload"]) for r in search.decoded_hits(rows).collect()]
    assert got == [("p", 0.5, "7", {"ticket_id": "7"}), ("", 0.0, "", {})]
    schema = "ticket_id string, date date, category string, subject string, body string, comments array<struct<role:string,created_at:string,body:string>>"
    row = search.requests_as_tickets(spark.createDataFrame([("1", None, "", "", "b", [(None, None, "x")])], schema)).first()
    assert row["date"] is not None and tuple(row["comments"][0]) == ("zwyczajny", "nieznany", "", "x")


def test_index_is_created_verified_and_dropped(spark, tmp_path):
    path = str(tmp_path / "index")
    assert index.create_or_verify(spark, path, 2)
    rows = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new"), ("b", 1, "x")], "point_id string, at int, text string")
    rows = rows.withColumns({"vector_problem": F.array(F.lit(1.0), F.lit(0.0)), "vector_sts": F.array(F.lit(1.0), F.lit(0.0))})
    assert index.upsert(spark, path, rows, order="at") == 2
    assert {r["point_id"]: r["text"] for r in index.load(spark, path).collect()} == {"a": "new", "b": "x"}
    assert not index.create_or_verify(spark, path, 2)
    with pytest.raises(index.IndexError_):
        index.create_or_verify(spark, path, 3)
    assert index.drop(spark, path) and not index.drop(spark, path)


def test_places_in_categories(spark):
    rows = spark.createDataFrame([(i, None if i % 7 == 0 else "ab"[i % 2]) for i in range(200)], "id int, c string")
    got = sampling.placed_in(rows, "c", F.col("id")).collect()
    for c in (None, "a", "b"):
        assert [r["at"] for r in sorted((r for r in got if r["c"] == c), key=lambda r: r["id"])] == list(range(sum(r["c"] == c for r in got)))
