"""Choosing records to process."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions.text import strip, strip_html_to_measure
from quernstone.operators.ranking import RANGE_ROWS, running

MIN_CHARS, CHARS_PER_TOKEN = 50, 3.0
#: Categories whose quotas are broadcast.
FEW_CATEGORIES = 10_000
FINISHED = ("rozwiazany", "zamkniety")


def has_content(status: Column, description: Column, comments: Column, least: int = MIN_CHARS) -> Column:
    """Finished, with a description and at least one comment of more than ``least`` characters."""
    long_ = lambda t: F.length(strip(strip_html_to_measure(t))) > least
    return status.isin(*FINISHED) & long_(description) & F.exists(F.coalesce(comments, F.array()), lambda c: F.coalesce(long_(c["body"]), F.lit(False)))


def stratified(df: DataFrame, category: str, id_col: str, count: int) -> DataFrame:
    """A systematic sample: each category gets its share, at least one, taken at equal
    steps in the order of the id's text; at last the smallest ids up to ``count``. Repeated
    ids are counted, not sorted: a row of the plan is an id with its copies."""
    sizes = df.groupBy(category).agg(F.count(F.lit(1)).alias("n"))
    total, categories = sizes.agg(F.sum("n"), F.count(F.lit(1))).first()
    quota = F.greatest(F.lit(1), F.bround(count * F.col("n") / max(total or 0, 1), 0).cast("long"))
    sizes = sizes.withColumn("quota", quota).withColumn("step", F.greatest(F.lit(1), F.floor(F.col("n") / F.col("quota"))))
    ids = df.groupBy(category, id_col).agg(F.count(F.lit(1)).alias("copies"))
    placed = running(ids, [category], [F.col(id_col).cast("string")], F.col("copies"), "before", before=True)
    placed = placed.join(F.broadcast(sizes) if categories <= FEW_CATEGORIES else sizes, category)
    nth = F.ceil(F.col("before") / F.col("step"))  # the first step at or after the id's first copy
    picked = placed.where((nth * F.col("step") < F.col("before") + F.col("copies")) & (nth < F.col("quota")))
    return picked.select(id_col, category).orderBy(id_col).limit(count)


def placed_in(df: DataFrame, category: str, order: Column, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``df`` with ``at``: each row's place in its category, from 0. A large category is cut
    into ranges of the order that are fixed beforehand, so it may lie in many tasks."""
    return running(df, [category], [order], out="at", before=True, range_rows=range_rows)


def sample_report(df: DataFrame, picked: DataFrame, category: str, id_col: str) -> DataFrame:
    """category, size, picked, ids (of the sample, ascending): largest category first."""
    taken = picked.groupBy(category).agg(F.count(F.lit(1)).alias("picked"), F.sort_array(F.collect_list(id_col)).alias("ids"))
    sizes = df.groupBy(category).agg(F.count(F.lit(1)).alias("size"))
    return sizes.join(taken, category, "left").na.fill(0, ["picked"]).orderBy(F.desc("size"), category)


def too_long(df: DataFrame, chars: Column, context: int) -> DataFrame:
    """Rows above the context window; reported, not removed."""
    return df.where(chars > int(context * CHARS_PER_TOKEN))


def fits(prompt_chars: Column, system_chars: Column, context: int, answer: int) -> Column:
    return prompt_chars + system_chars <= int((context - answer) * CHARS_PER_TOKEN)


def answer_problem(sent_chars: Column, prompt_tokens: Column, context: int) -> Column:
    """Why a model's answer can't be trusted, or null: the window was full, or so few
    tokens were read that the prompt was cut."""
    cut = (sent_chars > 0) & (prompt_tokens > 0) & (sent_chars / prompt_tokens > CHARS_PER_TOKEN)
    return F.when(prompt_tokens >= context, "window full").when(cut, "prompt cut")


def not_done(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return df.join(done.select(key), key, "left_anti")
