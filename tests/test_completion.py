"""Completions: paid once, kept through a crash, and stopped by a failing provider."""

import os

import pytest
from pyspark.sql import functions as F

from quernstone.functions import encoders
from quernstone.operators import completion


def counting(folder, answer="ok", crash=None, refuse=None):
    """A completer that leaves a file for each prompt it is asked."""
    import uuid

    def made():
        good = encoders.fixed_completer(answer)()

        def complete(prompts):
            for p in prompts:
                if crash and crash(p):
                    raise RuntimeError("the worker dies")
                if refuse and refuse(p):
                    raise encoders.TransportError("connection refused")
                open(f"{folder}/{uuid.uuid4().hex}", "w").write(p)
            return good(prompts)

        return complete

    return made


def asked(folder):
    return sorted(open(f"{folder}/{f}").read() for f in os.listdir(folder))


@pytest.fixture
def calls(tmp_path):
    (tmp_path / "calls").mkdir()
    return str(tmp_path / "calls")


def prompts(spark, n, each=1):
    return spark.range(n * each).select("id", F.concat(F.lit("prompt "), F.col("id") % n).alias("prompt"))


def test_equal_prompts_are_asked_once(spark, tmp_path, calls):
    store = str(tmp_path / "store")
    rows = prompts(spark, 10, each=30)
    done = completion.completed_once(rows, "prompt", counting(calls), store).collect()
    assert len(done) == 300 and {r["completion"]["text"] for r in done} == {"ok"} and {r["error_kind"] for r in done} == {None}
    assert asked(calls) == sorted(f"prompt {i}" for i in range(10))
    assert completion.complete_all(rows, "prompt", counting(calls), store) == 0
    more = completion.completed_once(prompts(spark, 12), "prompt", counting(calls, "new"), store).collect()
    assert len(asked(calls)) == 12 and sum(r["completion"]["text"] == "new" for r in more) == 2


def test_null_and_empty(spark, tmp_path, calls):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "x")], "id int, prompt string")
    done = completion.completed_once(rows, "prompt", counting(calls), str(tmp_path / "s")).collect()
    assert len(done) == 3 and len(asked(calls)) == 2
    assert completion.completed_once(rows.where("id > 9"), "prompt", counting(calls), str(tmp_path / "t")).count() == 0


def test_crash_after_half_of_the_rounds(spark, tmp_path, calls):
    store, rows = str(tmp_path / "store"), prompts(spark, 40)
    keyed = rows.withColumn("round", F.pmod(F.xxhash64(completion.key_of(F.col("prompt"))), F.lit(4)))
    bad = {r["prompt"] for r in keyed.where("round = 2").collect()}
    with pytest.raises(Exception, match="the worker dies"):
        completion.complete_all(rows, "prompt", counting(calls, crash=bad.__contains__), store, round_rows=10)
    first = {r["prompt"] for r in keyed.where("round < 2").collect()}
    assert completion.stored(spark, store).count() == len(first)
    for name in os.listdir(calls):
        os.remove(f"{calls}/{name}")
    assert completion.complete_all(rows, "prompt", counting(calls), store) == 40 - len(first)
    assert set(asked(calls)) == {f"prompt {i}" for i in range(40)} - first
    assert completion.stored(spark, store).count() == 40


def test_a_failing_transport_is_a_value(spark, tmp_path, calls):
    store, rows = str(tmp_path / "store"), prompts(spark, 20)
    refuse = lambda p: p == "prompt 7"
    done = completion.completed_once(rows, "prompt", counting(calls, refuse=refuse), store, call=1).collect()
    assert {r["prompt"]: r["error_kind"] for r in done if r["error_kind"]} == {"prompt 7": "transport"}
    assert completion.stored(spark, store).count() == 19
    again = completion.completed_once(rows, "prompt", counting(calls), store).collect()  # only the refused one is asked
    assert not [r for r in again if r["error_kind"]] and len(asked(calls)) == 20


def test_a_dead_provider_aborts(spark, tmp_path, calls):
    store, rows = str(tmp_path / "store"), prompts(spark, 200)
    with pytest.raises(completion.CompletionAborted, match="refused|not asked"):
        completion.complete_all(rows, "prompt", counting(calls, refuse=lambda p: True), store, round_rows=50, most_failures=20, tries=1)
    assert not asked(calls)
    half = lambda p: int(p.split()[1]) % 2 == 0
    with pytest.raises(completion.CompletionAborted):
        completion.complete_all(rows, "prompt", counting(calls, refuse=half), store, round_rows=50, most_failures=20, tries=1, call=1, breaker=100)
    kept = completion.stored(spark, store).count()
    assert 0 < kept < 100  # good answers of the round that failed are kept


def test_task_stops_asking(spark, tmp_path):
    import collections

    tries = collections.Counter()

    class Dead:
        def __call__(self):
            def complete(prompts):
                raise encoders.TransportError("down")

            return complete

    rows = spark.range(64).coalesce(1).select(F.col("id").cast("string").alias("prompt_key"), F.lit("x").alias("prompt"))
    got = completion.asked(rows, Dead(), call=1, tries=1, breaker=3).groupBy("error").count().collect()
    assert {r["error"]: r["count"] for r in got} == {"down": 3, "not asked: the calls before failed": 61} and not tries


def test_wrong_number_of_answers(spark, tmp_path):
    bad = lambda: lambda prompts: []
    with pytest.raises(Exception, match="0 answers for"):
        completion.complete_all(prompts(spark, 3), "prompt", bad, str(tmp_path / "s"))


def test_completer_by_name():
    assert encoders.completer_named("  FAKE ", answer="a")()(["p"])[0]["text"] == "a"
    with pytest.raises(encoders.CompleterError, match="known: fake, scripted"):
        encoders.completer_named("other")
    with pytest.raises(encoders.CompleterError, match="fake"):
        encoders.completer_named("fake")


def test_embed_request():
    factory = encoders.pseudo_encoder(4)
    assert len(encoders.embed_request(["a", "b"], "query", factory, 4)) == 2
    assert encoders.embed_request(["a"], "query", factory, 4)[0] == encoders.pseudo_vector("[query]: a", 4)
    for texts, mode, size in ([], "query", 4), (["a"], "other", 4), (["a"], "query", 5):
        with pytest.raises(encoders.EncoderError):
            encoders.embed_request(texts, mode, factory, size)
