"""The corpus pipeline: raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is
written as Parquet and read again as the next stage's ``docs``. All stages but the last
return the columns of ``documents``. Each stage learns and counts on what its
predecessor kept, whole.

The dedup stages decide on rows, not ids: a null or repeated doc_id neither saves a copy
nor costs a text that has none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quernstone.llm import packing
from quernstone.llm.common import read
from quernstone.llm.exact_dedup import drop_copies
from quernstone.llm.language_id import keep_identified
from quernstone.llm.minhash import drop_near_copies
from quernstone.llm.pieces import tokenizer_path
from quernstone.llm.toxicity import keep_civil
from quernstone.tables import delete, new_path, scratch, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which no language is found: null texts, or no letter."""
    return keep_identified(docs)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are predicted toxic."""
    return keep_civil(docs, read(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each group of equal texts."""
    return drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each group of near duplicates."""
    return drop_near_copies(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of at most 4096 tokens."""
    return packing.packed(docs, tokenizer_path(packing.TABLE))


STAGES = [("language_id", language), ("toxicity", toxic), ("exact_dedup", exact), ("near_dedup", near), ("packing", pack)]

#: Models, MinHash and bin packing can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        folder = new_path(spark, f"stage-{name}")
        with scratch(spark):
            docs = written(stage(spark, docs, sf_dir), "docs", into=folder)
        if last:
            delete(spark, last)  # what the stage was made from
        last = folder
    return STAGES[-1][1](spark, docs, sf_dir)
