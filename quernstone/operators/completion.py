"""Model calls over a table of prompts: each different prompt is paid for once, answers are
kept in a table that a rerun reads first, and a failing provider stops the run.

Two kinds of failure are told apart. A *transport* failure (``TransportError``: timeouts,
refused connections, quota) says nothing about the prompt: it is tried again, is a value
in the result (``error_kind``, ``error``), is never stored, and more than ``most_failures`` of
them abort the run. A bad *answer* is an answer: it is stored and paid for; whether it holds a
record is the business of ``validate.parsed_answers``. Any other exception of a
completer is a fault in it and ends the run at once."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quernstone.functions.encoders import COMPLETION, TransportError
from quernstone.operators.joins import spread_join
from quernstone.tables import new_path, scratch, written

#: Prompts of a round, which is stored as a whole; prompts of a call; tries of a call;
#: calls that fail one after the other before a task stops asking; failures that end a run.
ROUND, CALL, TRIES, BREAKER, MOST_FAILURES = 100_000, 16, 3, 3, 100
FIELDS = [f.split()[0] for f in COMPLETION.split(", ")]
ANSWERED = f"prompt_key string, {COMPLETION}, error string"
KINDS = {"string": pa.string(), "long": pa.int64(), "double": pa.float64()}


class CompletionAborted(Exception):
    """Too many transport failures; the answers so far are stored."""


def key_of(prompt: Column) -> Column:
    return F.sha2(F.coalesce(prompt, F.lit("")), 256)


def stored(spark: SparkSession, store: str) -> DataFrame:
    """prompt_key and the answer's fields; of a prompt answered twice (by two runs at once)
    one answer. An empty table if nothing is stored."""
    schema = f"prompt_key string, {COMPLETION}"
    try:
        rows = spark.read.schema(schema).parquet(store)
    except AnalysisException:
        return spark.createDataFrame([], schema)
    answer = F.struct(*FIELDS)
    return rows.groupBy("prompt_key").agg(F.min(answer).alias("a")).select("prompt_key", "a.*")


def asked(prompts: DataFrame, factory: Callable, call: int = CALL, tries: int = TRIES, breaker: int = BREAKER, wait: float = 0.0) -> DataFrame:
    """``ANSWERED`` for prompt_key and prompt: the answer's fields, or ``error``. A task
    whose calls fail ``breaker`` times in a row asks no more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        complete, failed = factory(), 0
        for batch in batches:
            keys, texts, rows = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for begin in range(0, len(keys), call):
                part = texts[begin : begin + call]
                answers: list[dict[str, Any]] = []
                error = "not asked: the calls before failed"
                if failed < breaker:
                    for attempt in range(tries):
                        try:
                            answers, error = list(complete([t or "" for t in part])), None
                            break
                        except TransportError as e:
                            error = str(e) or type(e).__name__
                            time.sleep(wait * 2**attempt)
                    failed = 0 if error is None else failed + 1
                if error is None and len(answers) != len(part):
                    raise ValueError(f"the completer gave {len(answers)} answers for {len(part)} prompts")
                for i, key in enumerate(keys[begin : begin + call]):
                    rows.append((key, *([answers[i].get(f) for f in FIELDS] if error is None else [None] * len(FIELDS)), error))
            names = [f.split()[0] for f in ANSWERED.split(", ")]
            kinds = [KINDS[f.split()[1]] for f in ANSWERED.split(", ")]
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return prompts.select("prompt_key", "prompt").mapInArrow(run, ANSWERED)


def by_round(wanted: DataFrame, rounds: int) -> DataFrame:
    """``wanted`` with ``round``, by hash, as a table with a folder for each, so that a round
    reads its own prompts only."""
    rows = wanted.withColumn("round", F.pmod(F.xxhash64("prompt_key"), F.lit(max(rounds, 1))).cast("int"))
    if rounds < 2:
        return rows
    path = new_path(wanted.sparkSession, "rounds")
    rows.repartition("round").write.partitionBy("round").parquet(path)
    return wanted.sparkSession.read.schema(rows.schema).parquet(path)


def complete_all(df: DataFrame, prompt: str, factory: Callable, store: str, round_rows: int = ROUND, most_failures: int = MOST_FAILURES, **call: Any) -> int:
    """Answers all prompts of ``df`` that the store has no answer for, round by round; a
    round's answers are stored before the next one begins, so a crash costs one round.
    Gives the number of prompts asked."""
    spark = df.sparkSession
    with scratch(spark):
        wanted = df.select(key_of(F.col(prompt)).alias("prompt_key"), F.col(prompt).alias("prompt")).groupBy("prompt_key").agg(F.min("prompt").alias("prompt"))
        wanted = written(wanted.join(stored(spark, store).select("prompt_key"), "prompt_key", "left_anti"), "prompts")
        count = wanted.count()
        rounds, failures = -(-count // round_rows), 0
        dealt = by_round(wanted, rounds)
        for i in range(rounds):
            part = dealt.where(F.col("round") == i)
            seen = Observation()
            answers = written(asked(part, factory, **call).observe(seen, F.count("error").alias("failures"), F.max("error").alias("error")), "answers")
            answers.where("error is null").drop("error").write.mode("append").parquet(store)
            failures += seen.get["failures"] or 0
            if failures > most_failures:
                raise CompletionAborted(f"{failures} prompts without an answer, the last for: {seen.get['error']}")
    return count


def completed_once(df: DataFrame, prompt: str, factory: Callable, store: str, out: str = "completion", **options: Any) -> DataFrame:
    """``df`` with the answer as ``out`` (null without one), ``error_kind`` (``transport`` or
    null). Rows with one prompt share an answer, whatever their number."""
    complete_all(df, prompt, factory, store, **options)
    rows = df.withColumn("prompt_key", key_of(F.col(prompt)))
    facts = stored(df.sparkSession, store).select("prompt_key", F.struct(*FIELDS).alias(out))
    sizes = rows.groupBy("prompt_key").agg(F.count(F.lit(1)).alias("size"))
    salted = rows.withColumn("__salt", F.monotonically_increasing_id())
    met = spread_join(salted, facts, ["prompt_key"], sizes, by="__salt", how="left")
    return met.select(*df.columns, out, F.when(F.col(out).isNull(), F.lit("transport")).alias("error_kind"))
