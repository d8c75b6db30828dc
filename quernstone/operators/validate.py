"""Validation of parsed records: errors are values, nothing is raised for a bad record."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions.text import strip, strip_fence

#: Fields of a parsed record that must not be blank.
REQUIRED = ("component", "problem", "symptoms", "cause", "solution", "resolution")
IDENTITY = ("ticket_id", "date", "resolution_vocabulary_version")
FIELDS = ("ticket_id", "date", "component", "problem", "symptoms", "error_codes", "cause", "solution", "resolution", "resolution_vocabulary_version", "questions_summary")
SCHEMA = ", ".join(f"{f} string" for f in ("ticket_id", "date", *REQUIRED, "questions_summary")) + ", error_codes array<string>, resolution_vocabulary_version int"


def is_object(text: Column) -> Column:
    """Well-formed JSON whose top level is an object."""
    return F.coalesce(F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT<"), F.lit(False))


def unknown_keys(text: Column, allowed: Sequence[str]) -> Column:
    return F.array_except(F.coalesce(F.json_object_keys(text), F.array().cast("array<string>")), F.array(*[F.lit(a) for a in allowed]))


def listed(*errors: tuple[Column, Column]) -> Column:
    """Messages of the conditions that hold, in order."""
    return F.filter(F.array(*[F.when(bad, message) for bad, message in errors]), lambda e: e.isNotNull())


def kind(record: Column, field: str) -> Column:
    """The JSON type of a field: null if it is missing, ``VOID`` for JSON's null."""
    return F.schema_of_variant(F.try_variant_get(record, f"$.{field}", "variant"))


def field_errors(record: Column, fields: Sequence[str] = FIELDS) -> Column:
    """``field: message`` for each of ``fields`` of a JSON object (a variant) that is missing,
    of the wrong type, or blank; in the order of ``fields``."""
    found = []
    for f in fields:
        type_ = kind(record, f)
        text = F.try_variant_get(record, f"$.{f}", "string")
        if f == "error_codes":  # optional; every element must be a text
            bad = type_.isNotNull() & ~type_.isin("ARRAY<STRING>", "ARRAY<VOID>") | F.coalesce(F.exists(F.try_variant_get(record, "$.error_codes", "array<string>"), lambda x: x.isNull()), F.lit(False))
            found.append((bad, F.lit(f"{f}: not a list of texts")))
            continue
        if f != "questions_summary":
            found.append((type_.isNull(), F.lit(f"{f}: missing")))
        if f == "resolution_vocabulary_version":
            number = F.try_variant_get(record, f"$.{f}", "double")
            found.append((type_.isNotNull() & ~F.coalesce(number == F.floor(number), F.lit(False)), F.lit(f"{f}: not an integer")))
            continue
        found.append((type_ != "STRING", F.lit(f"{f}: not a text")))
        if f == "date":
            day = text.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).isNotNull()
            found.append(((type_ == "STRING") & ~F.coalesce(day, F.lit(False)), F.lit(f"{f}: not a date")))
        elif f not in ("ticket_id", "resolution"):  # a blank resolution is not in the vocabulary
            found.append(((type_ == "STRING") & (strip(text) == ""), F.lit(f"{f}: blank or missing")))
    return listed(*found)


def record_errors(text: Column, version: int | Column, names: Sequence[str] | Column, known: Sequence[str] = (), told: Column | None = None) -> Column:
    """``field: message`` of each failed check of a record's JSON. Checks on the whole record
    (location ``rekord``) run only if no field failed, and the vocabulary's version before
    membership in it. Fields in ``known`` come from elsewhere, not from the text; ``told``
    is then the version. ``names``: the vocabulary's, or an array column of them."""
    record = F.try_parse_json(text)
    strange = F.transform(unknown_keys(text, FIELDS), lambda k: F.concat(k, F.lit(": unknown field")))
    field = F.concat(field_errors(record, [f for f in FIELDS if f not in known]), strange)
    if told is None:
        told = F.try_variant_get(record, "$.resolution_vocabulary_version", "double")
    resolution = strip(F.try_variant_get(record, "$.resolution", "string"))
    asked = version if isinstance(version, Column) else F.lit(version)
    member = F.array_contains(names, resolution) if isinstance(names, Column) else resolution.isin(*names)
    whole = F.when(told != asked, F.array(F.concat(F.lit("rekord: vocabulary version is not "), asked.cast("string")))).when(
        ~member, F.array(F.lit("rekord: resolution is not in the vocabulary"))
    ).otherwise(F.array().cast("array<string>"))
    return F.when(~is_object(text), F.array(F.lit("rekord: not a JSON object"))).when(F.size(field) > 0, field).otherwise(whole)


def validated(df: DataFrame, text: str, version: int | Column, names: Sequence[str] | Column) -> DataFrame:
    """``df`` with ``record`` and ``errors`` (empty: valid); required texts are trimmed."""
    parsed = F.from_json(F.col(text), SCHEMA)
    out = df.withColumn("record", parsed).withColumn("errors", record_errors(F.col(text), version, names))
    for f in REQUIRED:
        out = out.withColumn("record", F.col("record").withField(f, strip(F.col(f"record.{f}"))))
    return out.withColumn("record", F.when(F.size("errors") == 0, F.col("record")))


class VocabularyError(Exception):
    """The vocabulary has no such version, or too many names."""


#: Names of one version that go to every task.
NAMES = 10_000


def names_of(vocabulary: DataFrame, version: int) -> DataFrame:
    """One row: the names of one version of a vocabulary (version, name). Their number is
    checked, so that they may be broadcast."""
    names = vocabulary.where(F.col("version") == version).select("name").distinct()
    count = names.limit(NAMES + 1).count()
    if not 0 < count <= NAMES:
        raise VocabularyError(f"version {version} of the vocabulary has {'no' if not count else f'more than {NAMES}'} names")
    return names.agg(F.collect_set("name").alias("__names"))


def validated_by(df: DataFrame, text: str, version: int, vocabulary: DataFrame) -> DataFrame:
    """``validated`` against one version of a table of vocabularies (version, name)."""
    rows = df.join(F.broadcast(names_of(vocabulary, version)))  # one row
    return validated(rows, text, version, F.col("__names")).drop("__names")


def parsed_answers(df: DataFrame, answer: str, ticket_id: str, date: str, version: int, names: Sequence[str]) -> DataFrame:
    """Model answers to records: the fence goes, and id, date and version are the source's,
    whatever the model says. A failed answer keeps its row, and with it its cost."""
    bare = df.withColumn("__json", strip_fence(F.col(answer)))
    own = F.struct(F.col(ticket_id).cast("string").alias("ticket_id"), F.col(date).cast("string").alias("date"), F.lit(version).alias("resolution_vocabulary_version"))
    out = bare.withColumn("record", F.from_json("__json", SCHEMA)).withColumn("__own", own)
    for f in IDENTITY:
        out = out.withColumn("record", F.col("record").withField(f, F.col(f"__own.{f}")))
    errors = record_errors(F.col("__json"), version, names, IDENTITY, F.lit(version))
    return out.withColumn("errors", errors).withColumn("record", F.when(F.size("errors") == 0, F.col("record"))).drop("__json", "__own")


def summary(checked: DataFrame) -> DataFrame:
    """checked, failed, ok; an empty table passes."""
    return checked.agg(F.count(F.lit(1)).alias("checked"), F.count_if(F.size("errors") > 0).alias("failed")).withColumn("ok", F.col("failed") == 0)
