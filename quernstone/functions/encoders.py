"""Embedding models and language models behind Arrow functions.

A model is a callable on a batch, made once per worker by a factory: ``encoder`` takes
texts and gives vectors, ``completer`` takes prompts and gives dictionaries with the
fields of ``COMPLETION``. Both are pluggable; the two here need no network.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODES = ("query", "passage", "sts")
#: Fixed values (modes and prefixes of the embedding interface): what each mode puts before the text.
PREFIXES = {"query": "[query]: ", "passage": "", "sts": "[sts]: "}
COMPLETION = "text string, model string, prompt_tokens long, completion_tokens long, latency_ms double, cache_write_tokens long, cache_read_tokens long, cost_usd double"


class EncoderError(Exception):
    """The encoder was asked for what it can't give."""


class TransportError(Exception):
    """A provider could not be reached or refused; nothing is known about the prompt."""


def with_prefix(text: Column, mode: str) -> Column:
    if mode not in MODES:
        raise EncoderError(f"mode must be one of {', '.join(MODES)}, not {mode!r}")
    return F.concat(F.lit(PREFIXES[mode]), text)


def pseudo_vector(text: str, dimension: int) -> list[float]:
    """A unit vector that depends on the text alone. Seed, generator and range are fixed
    values of the interface: SHA-256 of the text seeds a Mersenne Twister."""
    import hashlib
    import math
    import random

    draw = random.Random(int.from_bytes(hashlib.sha256(text.encode("utf-8")).digest(), "big"))
    v = [2.0 * draw.random() - 1.0 for _ in range(dimension)]
    length = math.sqrt(sum(x * x for x in v))
    return [x / length for x in v] if length else v


def pseudo_encoder(dimension: int) -> Callable[[], Callable[[Sequence[str]], list[list[float]]]]:
    return lambda: lambda texts: [pseudo_vector(t, dimension) for t in texts]


ENCODERS: dict[str, Callable[[int], Callable]] = {"fake": pseudo_encoder}


def encoder_named(name: str, dimension: int) -> Callable:
    made = ENCODERS.get(name.strip().lower())
    if made is None:
        raise EncoderError(f"unknown encoder {name!r}; known: {', '.join(sorted(ENCODERS))}")
    return made(dimension)


def embed(text: Column, mode: str, factory: Callable, dimension: int) -> Column:
    """Vectors of ``text`` in one mode; their length is checked, null stays null."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = factory()
        for texts in batches:
            known = texts.notna()
            vectors = list(encode(texts[known].tolist()))
            if len(vectors) != int(known.sum()) or any(len(v) != dimension for v in vectors):
                raise EncoderError(f"the encoder must give one vector of {dimension} for each text")
            out = pd.Series([None] * len(texts), index=texts.index, dtype=object)
            out[known] = pd.Series(vectors, index=texts.index[known], dtype=object)
            yield out

    return run(with_prefix(text, mode))


def embed_request(texts: Sequence[str], mode: str, factory: Callable, dimension: int) -> list[list[float]]:
    """The vectors of one request, outside a table: at least one text, in a known mode."""
    if not texts:
        raise EncoderError("a request needs at least one text")
    if mode not in MODES:
        raise EncoderError(f"mode must be one of {', '.join(MODES)}, not {mode!r}")
    vectors = list(factory()([PREFIXES[mode] + t for t in texts]))
    if len(vectors) != len(texts) or any(len(v) != dimension for v in vectors):
        raise EncoderError(f"the encoder must give one vector of {dimension} for each text")
    return vectors


def embed_query(text: Column, factory: Callable, dimension: int) -> Column:
    return embed(text, "query", factory, dimension)


def embed_passage(text: Column, factory: Callable, dimension: int) -> Column:
    return embed(text, "passage", factory, dimension)


def embed_sts(text: Column, factory: Callable, dimension: int) -> Column:
    return embed(text, "sts", factory, dimension)


def fixed_completer(answer: str, model: str = "fake") -> Callable[[], Callable[[Sequence[str]], list[dict[str, Any]]]]:
    """Answers every prompt alike; tokens are words."""

    def one(prompt: str) -> dict[str, Any]:
        return {"text": answer, "model": model, "prompt_tokens": len(prompt.split()), "completion_tokens": len(answer.split()), "latency_ms": 0.0, "cache_write_tokens": 0, "cache_read_tokens": 0, "cost_usd": 0.0}

    return lambda: lambda prompts: [one(p) for p in prompts]


class CompleterError(Exception):
    """An unknown completer, or a scripted one that was asked for more answers than it has."""


def scripted_completer(answers: Sequence[str], model: str = "fake") -> Callable[[], Callable[[Sequence[str]], list[dict[str, Any]]]]:
    """Gives its answers one after the other and raises at the end of the script. Each task
    begins at the first answer: use one partition where the order matters."""

    def made() -> Callable[[Sequence[str]], list[dict[str, Any]]]:
        left = list(answers)

        def complete(prompts: Sequence[str]) -> list[dict[str, Any]]:
            if len(prompts) > len(left):
                raise CompleterError(f"the script of {len(answers)} answers has ended")
            return [fixed_completer(left.pop(0), model)()([p])[0] for p in prompts]

        return complete

    return made


def failing_completer(answer: str, fails: Callable[[Sequence[str]], bool]) -> Callable[[], Callable[[Sequence[str]], list[dict[str, Any]]]]:
    """For tests: a call for which ``fails`` holds can't be made, others get ``answer``."""

    def made() -> Callable[[Sequence[str]], list[dict[str, Any]]]:
        good = fixed_completer(answer)()

        def complete(prompts: Sequence[str]) -> list[dict[str, Any]]:
            if fails(prompts):
                raise TransportError("connection refused")
            return good(prompts)

        return complete

    return made


#: Completers by name; each is made from keyword settings. Callers register their own.
COMPLETERS: dict[str, Callable[..., Callable]] = {"fake": fixed_completer, "scripted": scripted_completer}


def completer_named(name: str, **settings: Any) -> Callable:
    """The factory registered under ``name`` (case and surrounding space don't count). An
    unknown name or missing settings fail here, before anything runs."""
    made = COMPLETERS.get(name.strip().lower())
    if made is None:
        raise CompleterError(f"unknown completer {name!r}; known: {', '.join(sorted(COMPLETERS))}")
    try:
        return made(**settings)
    except TypeError as error:
        raise CompleterError(f"completer {name.strip().lower()!r}: {error}") from error


def completed(df: DataFrame, prompt: str, factory: Callable, out: str = "completion") -> DataFrame:
    """``df`` with the model's answer. The call is paid for, so write the result before
    anything reads it twice; Spark is told that the call does not repeat itself."""

    @F.pandas_udf(COMPLETION)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        complete = factory()
        for prompts in batches:
            yield pd.DataFrame(list(complete(prompts.fillna("").tolist())))

    return df.withColumn(out, run.asNondeterministic()(F.col(prompt)))
