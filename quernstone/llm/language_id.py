"""Language identification with a string kernel.

Kernel: blended-spectrum presence kernel, k(x, y) = |G(x) & G(y)| / sqrt(|G(x)| |G(y)|),
where G is the set of a text's character n-grams of 1 to 3 characters (lower case; all
that is no letter counts as one separator; letters beyond the ``LETTERS`` most frequent
ones of the sample share one symbol).

Model: ``LANDMARKS`` sample texts span the Nyström feature space; one-versus-rest kernel
ridge regression on at most ``PER_LANGUAGE`` texts for each language, ``SAMPLE_ROWS`` in all
(at least one for each language; the documented bound of the sample: the rows with the smallest
hash of their id). Of a longer text a window of ``SAMPLE_CHARS`` characters is
learned from, at a place drawn by that hash; together at most ``SAMPLE_TOTAL`` characters. No
language is left out. With A the ridge solution over the landmarks, a text scores
K(x, landmarks) A. Since K is itself a product of presence vectors, the landmarks'
presence matrix times A is computed once, and a batch of texts is scored as one product
of its sparse presence matrix with that matrix.

Every whole text is scored. Learning uses text and language of rows that are not held
out, nothing else.

Edge cases: null text, or text without a letter: ``und`` with score 0; null ids are
held out; repeated rows are scored one by one; ties go to the language first in the
alphabet; an empty table, or one without a language to learn, gives ``und`` throughout;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.llm.common import held_out, read

PER_LANGUAGE, SAMPLE_ROWS, LANDMARKS, LETTERS, RIDGE, SHARPNESS = 300, 9_600, 256, 60, 1e-2, 6.0
#: Characters of a sample text, and of the sample (documents that are scored have no limit).
SAMPLE_CHARS, SAMPLE_TOTAL = 20_000, 40_000_000
#: Symbols: 0 other letters, 1 separators, then the letters.
BASE = 64
SPACE = BASE + BASE**2 + BASE**3
#: Symbols of a text that are worked on at once.
STEP = 1 << 18
UND = "und"


@lru_cache(maxsize=1)
def letter_table() -> Any:
    """For each code point 1 if it is no letter, else 0."""
    import sys

    import numpy as np

    return np.fromiter((0 if chr(c).isalpha() else 1 for c in range(sys.maxunicode + 1)), dtype=np.uint8, count=sys.maxunicode + 1)


def symbols_of(letters: str) -> Any:
    table = letter_table().copy()
    for i, c in enumerate(letters):
        table[ord(c)] = 2 + i
    return table


def grams(text: str | None, table: Any, flags: Any) -> Any:
    """Sorted codes of the text's n-grams; ``flags`` is a zeroed scratch array."""
    import numpy as np

    if not text:
        return np.zeros(0, dtype=np.int64)
    s = table[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    s = s[np.concatenate(([True], (s[1:] != 1) | (s[:-1] != 1)))]
    for begin in range(0, len(s), STEP):  # a long text in parts that overlap by two symbols
        part = s[begin : begin + STEP + 2].astype(np.int32)
        flags[part] = True
        two = part[:-1] * BASE + part[1:]
        flags[BASE + two] = True
        flags[BASE + BASE**2 + two[:-1] * BASE + part[2:]] = True
    found = np.flatnonzero(flags)
    flags[found] = False
    return found


def sample(docs: DataFrame) -> list[tuple[str, str]]:
    """(lang, text) of the rows that are learned from: bounded in rows and characters."""
    rows = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = rows.groupBy("lang").count()
    langs = counts.count()
    if not langs:
        return []
    each = max(1, min(PER_LANGUAGE, SAMPLE_ROWS // langs))
    chars = max(1, min(SAMPLE_CHARS, SAMPLE_TOTAL // (each * langs)))
    draw = F.xxhash64("doc_id")
    # thinned first, so that no window sorts a whole language
    share = counts.select(F.col("lang").alias("known"), ((1.5 * each + 50) / F.col("count")).alias("share"))
    thin = rows.join(F.broadcast(share) if langs <= SAMPLE_ROWS else share, F.col("lang") == F.col("known"))
    thin = thin.where(F.pmod(draw, F.lit(1_000_003)) / 1_000_003.0 < F.col("share"))
    begin = F.pmod(F.xxhash64("doc_id", "lang"), F.greatest(F.length("text") - chars + 1, F.lit(1))).cast("int") + 1
    thin = thin.select("lang", draw.alias("draw"), "doc_id", F.substring("text", begin, chars).alias("text"))  # cut before it is sorted
    first = Window.partitionBy("lang").orderBy("draw", "doc_id", "text")
    thin = thin.withColumn("n", F.row_number().over(first)).where(F.col("n") <= each)
    return sorted((r["lang"], r["text"]) for r in thin.select("lang", "text").collect())


def train(rows: list[tuple[str, str]]) -> dict[str, Any]:
    """langs, letters, place (of each n-gram among those that landmarks have), weights (one
    row for each of these, and one of zeros; a column for each language)."""
    import numpy as np

    count = pd.Series([c for _, t in rows for c in set(t.lower()) if c.isalpha()]).value_counts()
    letters = "".join(sorted(count.index, key=lambda c: (-count[c], c))[:LETTERS])
    table, flags = symbols_of(letters), np.zeros(SPACE, dtype=bool)
    langs = sorted({lang for lang, _ in rows})
    sets = [grams(t, table, flags) for _, t in rows]
    use = [i for i, s in enumerate(sets) if len(s)]
    each = max(1, LANDMARKS // max(1, len(langs)))
    marks = [i for lang in langs for i in [j for j in use if rows[j][0] == lang][:each]]
    known = np.unique(np.concatenate([sets[i] for i in marks])) if marks else np.zeros(0, dtype=np.int64)

    def presence(which: list[int]) -> Any:
        out = np.zeros((len(which), len(known)), dtype=np.float32)
        for r, i in enumerate(which):
            at = np.searchsorted(known, sets[i])
            at = at[(at < len(known))]
            out[r, at[np.isin(known[at], sets[i], assume_unique=True)]] = 1
            out[r] /= np.sqrt(len(sets[i]))
        return out

    landmark = presence(marks)
    cross = np.vstack([presence(use[i : i + 200]) @ landmark.T for i in range(0, len(use), 200)]).astype(float) if use else np.zeros((0, 0))
    target = np.array([[1.0 if rows[i][0] == lang else -1.0 for lang in langs] for i in use])
    place = np.full(SPACE, len(known), dtype=np.int32)
    place[known] = np.arange(len(known))
    weights = np.zeros((len(known) + 1, len(langs)), dtype=np.float32)
    if use:
        within = (landmark @ landmark.T).astype(float)
        solved = np.linalg.lstsq(cross.T @ cross + RIDGE * len(use) * (within + 1e-6 * np.eye(len(marks))), cross.T @ target, rcond=None)[0]
        weights[:-1] = landmark.T @ solved
    return {"langs": langs, "letters": letters, "place": place, "weights": weights}


def predictor(spark: SparkSession, model: dict[str, Any]) -> Any:
    """Scalar UDF: text -> struct(lang, score)."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import numpy as np

        model = shared.value
        table, flags = symbols_of(model["letters"]), np.zeros(SPACE, dtype=bool)
        names = np.array([*model["langs"], UND], dtype=object)
        for texts in batches:
            lang, score = np.full(len(texts), len(names) - 1), np.zeros(len(texts))
            for begin in range(0, len(texts), 64):
                found = [grams(t if isinstance(t, str) else None, table, flags) for t in texts.iloc[begin : begin + 64]]
                # a letter shows as a single symbol other than the separator
                at = [i for i, s in enumerate(found) if len(s) and (s[s < BASE] != 1).any()]
                if not at or len(names) == 1:
                    continue
                sizes = np.array([len(found[i]) for i in at])
                raw = np.add.reduceat(model["weights"][model["place"][np.concatenate([found[i] for i in at])]], np.concatenate(([0], np.cumsum(sizes)[:-1])), axis=0) / np.sqrt(sizes)[:, None]
                soft = np.exp(SHARPNESS * (raw - raw.max(axis=1, keepdims=True)))
                soft /= soft.sum(axis=1, keepdims=True)
                at = np.array(at) + begin
                lang[at], score[at] = soft.argmax(axis=1), soft.max(axis=1)
            yield pd.DataFrame({"lang": names[lang], "score": score})

    return predict


def identified(docs: DataFrame, learn_from: DataFrame | None = None) -> Column:
    """The prediction for ``docs.text`` as a column, learned from ``learn_from``."""
    return predictor(docs.sparkSession, train(sample(docs if learn_from is None else learn_from)))(F.col("text"))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = docs.select("doc_id", held_out().alias("held_out"), identified(docs).alias("p"))
    return found.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def keep_identified(docs: DataFrame) -> DataFrame:
    """``docs`` without texts in which no language is found (null, or no letter). Rows without
    a ``lang`` get the predicted one. If no language can be learned, texts with a letter stay."""
    model = train(sample(docs))
    if not model["langs"]:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    predict = predictor(docs.sparkSession, model).asNondeterministic()  # else filter and column call it once each
    found = docs.withColumn("__found", predict(F.col("text"))["lang"]).where(F.col("__found") != UND)
    return found.withColumn("lang", F.coalesce("lang", "__found")).select(docs.columns)
