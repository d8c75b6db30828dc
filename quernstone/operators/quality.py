"""The quality filter: explainable rules, all of which run on every record."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.functions.text import evidence, has_phrase, words_beside

# Fixed values of the rule and of the drop-rate warning.
ESCAPE_PHRASES = ("brak", "nie dotyczy", "nie ustalono", "nie podano")
MAX_EXTRA_WORDS, EVIDENCE_LENGTH = 10, 80
EXPECTED_DROP_RATE, TOLERANCE, MIN_RECORDS, MAX_LISTED = 0.19, 0.5, 50, 10

Rule = Callable[[Column], Column]


def no_resolution(phrases: Sequence[str] = ESCAPE_PHRASES, most: int = MAX_EXTRA_WORDS) -> Rule:
    """Evidence if the text is an escape phrase and at most ``most`` other words."""
    return lambda text: F.when(has_phrase(text, phrases) & (words_beside(text, phrases) <= most), evidence(text, EVIDENCE_LENGTH))


RULES: Mapping[str, Rule] = {"no_resolution": no_resolution()}


def verdicts(df: DataFrame, text: str, rules: Mapping[str, Rule] = RULES) -> DataFrame:
    """``df`` with ``hits`` (rule, evidence) and ``keep``: no rule hit."""
    found = F.array(*[F.struct(F.lit(name).alias("rule"), rule(F.col(text)).alias("evidence")) for name, rule in rules.items()])
    return df.withColumn("hits", F.filter(found, lambda h: h["evidence"].isNotNull())).withColumn("keep", F.size("hits") == 0)


def by_reason(judged: DataFrame) -> DataFrame:
    """rule, dropped; a record counts under each of its rules; most frequent first."""
    return judged.select(F.explode("hits.rule").alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("dropped")).orderBy(F.desc("dropped"), "rule")


def ids_for(judged: DataFrame, rule: str, id_col: str) -> DataFrame:
    return judged.where(F.array_contains("hits.rule", rule)).select(id_col).orderBy(id_col)


def listed(ids: Column, most: int = MAX_LISTED) -> Column:
    """The first ids and how many more there are."""
    return F.struct(F.slice(ids, 1, most).alias("shown"), F.greatest(F.size(ids) - most, F.lit(0)).alias("more"))


def dropped_ids(judged: DataFrame, id_col: str, most: int = MAX_LISTED) -> DataFrame:
    """rule, dropped, shown (the smallest ids, ``most`` at most), more: what a report tells of
    each rule. Ids are ranked under a limit, so a rule's ids never meet in one row or task."""
    hits = judged.select(F.explode("hits.rule").alias("rule"), id_col)
    counts = hits.groupBy("rule").agg(F.count(F.lit(1)).alias("dropped"))
    first = F.row_number().over(Window.partitionBy("rule").orderBy(id_col))
    shown = hits.withColumn("at", first).where(F.col("at") <= most).groupBy("rule").agg(F.sort_array(F.collect_list(id_col)).alias("shown"))
    return counts.join(shown, "rule").select("rule", "dropped", "shown", F.greatest(F.col("dropped") - most, F.lit(0)).alias("more"))


def warning(total: Column, dropped: Column) -> Column:
    """A message if far fewer records were dropped than expected; null for few records."""
    rate = dropped / total
    return F.when((total >= MIN_RECORDS) & (rate < EXPECTED_DROP_RATE * TOLERANCE), F.format_string(f"dropped %.1f%%, expected ~{100 * EXPECTED_DROP_RATE:.0f}%%", rate * 100))


def report(judged: DataFrame) -> DataFrame:
    """read, indexed, dropped, drop_rate, warning; one row."""
    out = judged.agg(F.count(F.lit(1)).alias("read"), F.count_if("keep").alias("indexed"), F.count_if(~F.col("keep")).alias("dropped"))
    return out.select("*", F.coalesce(F.try_divide("dropped", "read"), F.lit(0.0)).alias("drop_rate"), warning(F.col("read"), F.col("dropped")).alias("warning"))


def kept(df: DataFrame, judged: DataFrame, key: str) -> DataFrame:
    """Rows whose id has a kept verdict."""
    return df.join(judged.where("keep").select(key), key, "left_semi")


def agreement(judged: DataFrame, rejected: DataFrame, key: str) -> DataFrame:
    """How the drops agree with labelled rejections: caught, false_positives, missed."""
    dropped = judged.where(~F.col("keep")).select(key)
    both = dropped.withColumn("d", F.lit(1)).join(rejected.select(key).distinct().withColumn("r", F.lit(1)), key, "full")
    return both.agg(F.count_if(F.col("d").isNotNull() & F.col("r").isNotNull()).alias("caught"), F.count_if(F.col("r").isNull()).alias("false_positives"), F.count_if(F.col("d").isNull()).alias("missed"))
