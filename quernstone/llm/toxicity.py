"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one on the windows of ordinary text, and one on
toxic text, that is on what sets it apart: of a toxic sample document the words whose openings
occur far more often in toxic documents, in windows of ``WORDS``. (Trained on all windows of
toxic documents, most of which are ordinary, the dictionary is one of ordinary text; figures
in the README.) Before compression the toxic dictionary is put in front of the ordinary one, so
that ordinary words cost the same with both. Its size is chosen among ``SIZES`` by the
calibration's log loss.

Every whole text is cut into windows of ``WORDS`` words; a window's margin is its compressed
length with the ordinary dictionary less that with the toxic one. A logistic calibration, fitted
on sample texts that neither dictionary has seen, weighs a document's largest margins, its
counts of windows above thresholds and its length.

The sample is bounded: at most ``TOXIC`` and ``ORDINARY`` labelled rows that are not held
out, of at most ``SAMPLE_CHARS`` characters each and ``SAMPLE_TOTAL`` together (scored documents
have no limit). Only text and ``toxic`` are learned from.

Edge cases: null and empty texts score like a text without toxic windows; null ids are
held out and not learned from; null labels are not learned from; if a class has no
sample rows the score is that class' share in the sample (0 or 1), 0 without any; a
document with several labels counts once for each; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.llm.common import held_out, read

TOXIC, ORDINARY, SAMPLE_CHARS, SAMPLE_TOTAL = 2000, 4000, 20_000, 40_000_000
WORDS, LEVEL, ORDINARY_BYTES = 6, 12, 65_536
#: Sizes of the toxic dictionary that are tried.
SIZES = (512, 1024, 2048)
#: A word opening sets toxic text apart if this many sample documents have it, this many
#: times as often among toxic ones as among ordinary ones.
OPENING, LEAST_SHARE, RATIO, WHOLE_SHARE = (4, 5, 6), 0.02, 20.0, 0.05
#: Weight of a toxic row against an ordinary one in the calibration.
TOXIC_WEIGHT = 1.5

WORD = re.compile(r"\w+")


def windows(text: str | None) -> list[bytes]:
    words = (text or "").lower().split()
    return [(" " + " ".join(words[i : i + WORDS])).encode("utf-8", "replace") for i in range(0, len(words), WORDS)]


def sample(docs: DataFrame, labels: DataFrame) -> list[tuple[int, str]]:
    """(toxic, text), bounded; rows with the smallest hash of their id."""
    known = labels.where(~held_out() & F.col("toxic").isin(0, 1)).select("doc_id", "toxic")
    drawn = [known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for c, n in ((1, TOXIC), (0, ORDINARY))]
    ids = drawn[0].unionByName(drawn[1])  # at most TOXIC + ORDINARY rows
    texts = docs.where(F.length("text") <= SAMPLE_CHARS).select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    order = Window.orderBy(F.xxhash64("doc_id"), "doc_id", "text", "toxic").rowsBetween(Window.unboundedPreceding, 0)
    sizes = texts.select("doc_id", "toxic", "text", F.sum(F.length("text")).over(order).alias("chars"))  # of the sample's rows
    return [(r["toxic"], r["text"]) for r in sizes.where(F.col("chars") <= SAMPLE_TOTAL).orderBy("chars").collect()]


def words_of(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def openings(words: set[str]) -> set[str]:
    return {w[:k] for w in words for k in OPENING if len(w) >= k}


def apart(toxic: list[str], ordinary: list[str]) -> list[bytes]:
    """What sets toxic text apart, as often as it occurs: of each word its shortest
    opening that does, or the whole word if it is frequent in toxic text. Only one text's
    words are held at a time."""
    n, m = max(1, len(toxic)), max(1, len(ordinary))
    t = Counter(x for text in toxic for x in openings(words_of(text)))
    t = {x: c for x, c in t.items() if c >= max(4, LEAST_SHARE * n)}
    o = Counter(x for text in ordinary for x in openings(words_of(text)) if x in t)
    marks = {x for x in t if (t[x] + 0.5) / n >= RATIO * (o[x] + 0.5) / m}
    opening = lambda w: next((k for k in OPENING if len(w) >= k and w[:k] in marks), None)
    whole = Counter(w for text in toxic for w in words_of(text) if opening(w))
    found = []
    for text in toxic:
        for w in sorted(words_of(text)):
            k = opening(w)
            if k:
                found.append((" " + (w if whole[w] >= WHOLE_SHARE * n else w[:k])).encode())
    return found


def trained(samples: list[bytes], size: int) -> bytes:
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples: they are the dictionary
        return b"".join(dict.fromkeys(samples))[-size:]


def toxic_windows(toxic: list[str], ordinary: list[str]) -> list[bytes]:
    found = apart(toxic, ordinary)
    return [b"".join(found[i : i + WORDS]) for i in range(0, len(found), WORDS)]


def dictionaries(toxic: list[str], ordinary: list[str], sizes: tuple[int, ...] = SIZES) -> tuple[bytes, list[bytes]]:
    """The ordinary dictionary, and toxic ones of several sizes."""
    thin = max(1, sum(len(t) for t in ordinary) // 4_000_000)
    plain = trained(list(islice((w for t in ordinary for w in windows(t)), 0, None, thin)), ORDINARY_BYTES)
    marked = toxic_windows(toxic, ordinary)
    return plain, [trained(marked, size) for size in sizes]


def compressors(pair: tuple[bytes, bytes]) -> list[Any]:
    import zstandard

    made = []
    for content in pair:
        table = zstandard.ZstdCompressionDict(content or b" ", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        table.precompute_compress(level=LEVEL)
        made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=table, write_content_size=False, write_dict_id=False, write_checksum=False).compress)
    return made


def features(text: str | None, compress: list[Any]) -> list[float]:
    import numpy as np

    plain, toxic = compress
    margins = np.array([len(plain(w)) - len(toxic(w)) for w in windows(text)] or [0])
    top = np.sort(margins)[::-1][:3]
    top = np.concatenate([top, np.zeros(3 - len(top))])
    n = np.log1p(len(margins))
    at = [(margins >= k).sum() for k in (2, 3, 4, 5, 6)]
    return [*np.clip(top, -2, 12), *np.log1p(at), *(np.array(at) / len(margins)), n, top[0] * n / 10]


def logistic(x: Any, y: Any, weight: Any, ridge: float = 1e-2, steps: int = 50) -> Any:
    """Coefficients (intercept last) by Newton's method."""
    import numpy as np

    x = np.hstack([x, np.ones((len(x), 1))])
    b = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(b)), x.T @ (weight * (y - p)) - ridge * b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return b


def loss(x: Any, y: Any, weight: Any) -> float:
    """Log loss of rows that a calibration on the other half has not seen."""
    import numpy as np

    total = 0.0
    for half in (0, 1):
        seen = np.arange(len(x)) % 2 == half
        b = logistic(x[seen], y[seen], weight[seen])
        z = np.clip(x[~seen] @ b[:-1] + b[-1], -30, 30)
        total += float((weight[~seen] * np.logaddexp(0, np.where(y[~seen] == 1, -z, z))).sum())
    return total


def train(rows: list[tuple[int, str]]) -> dict[str, Any]:
    """dictionaries and calibration; of each class two rows in three train the former."""
    import numpy as np

    by = {c: [t for k, t in rows if k == c] for c in (0, 1)}
    if not by[0] or not by[1]:
        return {"share": 1.0 if by[1] else 0.0}
    third = {c: [t for i, t in enumerate(by[c]) if i % 3 == 2] or by[c] for c in by}
    plain, toxic = dictionaries(*([t for i, t in enumerate(by[c]) if i % 3 != 2] for c in (1, 0)))
    held = [(c, t) for c in (0, 1) for t in third[c]]
    y = np.array([float(c) for c, _ in held])
    weight, best = np.where(y == 1, TOXIC_WEIGHT, 1.0), None
    for content in dict.fromkeys(toxic):
        pair = (plain, content + plain)
        compress = compressors(pair)
        x = np.array([features(t, compress) for _, t in held])
        mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-6
        x = (x - mean) / spread
        found = {"pair": pair, "mean": mean, "spread": spread, "b": logistic(x, y, weight), "loss": loss(x, y, weight)}
        best = found if best is None or found["loss"] < best["loss"] else best
    return best


def scorer(spark: SparkSession, model: dict[str, Any]) -> Any:
    """Scalar UDF: text -> score."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import numpy as np

        model = shared.value
        compress = compressors(model["pair"]) if "pair" in model else None
        for texts in batches:
            if compress is None:
                yield pd.Series(np.full(len(texts), model["share"]))
                continue
            out = np.zeros(len(texts))
            for i, text in enumerate(texts):
                x = (np.array(features(text if isinstance(text, str) else None, compress)) - model["mean"]) / model["spread"]
                out[i] = 1 / (1 + np.exp(-np.clip(x @ model["b"][:-1] + model["b"][-1], -30, 30)))
            yield pd.Series(out)

    return score


def toxicity(docs: DataFrame, labels: DataFrame, learn_from: DataFrame | None = None) -> Column:
    return scorer(docs.sparkSession, train(sample(docs if learn_from is None else learn_from, labels)))(F.col("text"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = docs.select("doc_id", held_out().alias("held_out"), toxicity(docs, read(spark, sf_dir, "labels")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_civil(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those predicted toxic."""
    return docs.where(toxicity(docs, labels) < 0.5).select(docs.columns)
