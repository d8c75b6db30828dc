"""Readers and writers of the ticket formats."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions.text import strip_editorial, strip_html
from quernstone.operators.validate import validated
from quernstone.sources import relational
from quernstone.sources.documents import write_documents

# The export's fields, in the export's order.
COMMENT = "struct<id:int,typ:string,autor_rola:string,created_at:string,tresc:string>"
SCALARS = (
    "created_at",
    "updated_at",
    "status",
    "kategoria",
    "modul",
    "czego_dotyczy",
    "szczegolowy_opis",
    "priorytet",
    "sposob_zgloszenia",
    "wersja_zgloszona",
    "numer_mantis",
    "data_przyjecia",
    "data_zamkniecia",
    "powod_zakonczenia",
    "wykonane_czynnosci",
    "przyczyna",
    "ocena_rozwiazania",
    "instytucja",
    "osoba_kontakt",
    "email_kontakt",
    "telefon_kontakt",
)
RAW = f"zrodlo string, tabela string, zgloszenie struct<id:int,rozwiazanieid:int,{','.join(f'{s}:string' for s in SCALARS)}>, komentarze array<{COMMENT}>"
PARSED = (
    "ticket_id string, date date, component string, problem string, symptoms string, error_codes array<string>, cause string, solution string, resolution string,"
    " resolution_vocabulary_version int, questions_summary string"
)


class SourceError(Exception):
    """Records that were asked for are missing."""


def read_raw(spark: SparkSession, folder: str) -> DataFrame:
    """Export documents, one JSON file each: ticket_id, date, category, subject, body,
    comments (kind, role, created_at, body). Null texts become empty, no comments an empty
    array; a malformed file fails the read."""
    rows = spark.read.schema(RAW).option("multiLine", True).option("mode", "FAILFAST").option("pathGlobFilter", "*.json").json(folder)
    text = lambda c: strip_html(F.coalesce(c, F.lit("")))
    none = F.array().cast("array<struct<kind:string,role:string,created_at:string,body:string>>")
    comments = F.transform("komentarze", lambda k: F.struct(k["typ"].alias("kind"), k["autor_rola"].alias("role"), k["created_at"].alias("created_at"), text(k["tresc"]).alias("body")))
    z = "zgloszenie."
    return rows.select(
        F.col(z + "id").cast("string").alias("ticket_id"),
        F.to_date(F.substring(z + "created_at", 1, 10)).alias("date"),
        F.coalesce(z + "kategoria", F.lit("")).alias("category"),
        F.coalesce(z + "czego_dotyczy", F.lit("")).alias("subject"),
        text(F.col(z + "szczegolowy_opis")).alias("body"),
        F.coalesce(comments, none).alias("comments"),
        F.col("_metadata.file_name").alias("file_name"),
    )


def chosen(rows: DataFrame, ids: Sequence[str] | None = None, limit: int | None = None) -> DataFrame:
    """The rows asked for by id (all must be there), or the first by file name."""
    if ids:
        wanted = rows.sparkSession.createDataFrame([(i,) for i in dict.fromkeys(ids)], "ticket_id string")
        missing = [r[0] for r in wanted.join(rows, "ticket_id", "left_anti").collect()]
        if missing:
            raise SourceError(f"no such tickets: {', '.join(sorted(missing))}")
        return rows.join(wanted, "ticket_id", "left_semi")
    rows = rows.orderBy("file_name")
    return rows if limit is None else rows.limit(limit)


def read_parsed(spark: SparkSession, folder: str) -> DataFrame:
    """Parsed artifacts; malformed JSON fails the read (validate the texts for the rest)."""
    rows = spark.read.schema(PARSED).option("multiLine", True).option("mode", "FAILFAST").option("pathGlobFilter", "*.json").json(folder)
    return rows.withColumn("error_codes", F.coalesce("error_codes", F.array().cast("array<string>"))).withColumn("questions_summary", F.coalesce("questions_summary", F.lit("brak")))


def read_artifacts(spark: SparkSession, folder: str, version: int, names: Sequence[str]) -> DataFrame:
    """The records of a folder's artifacts in the order of their file names. An invalid one
    stops the read, with its file's name and first error."""
    checked = validated(read_texts(spark, folder), "text", version, names)
    file = F.element_at(F.split("path", "/"), -1)
    stop = F.raise_error(F.concat(file, F.lit(": "), F.get("errors", F.lit(0))))
    return checked.select(file.alias("file_name"), F.when(F.size("errors") == 0, F.col("record")).otherwise(stop).alias("record")).orderBy("file_name").select("file_name", "record.*")


def write_files(rows: DataFrame, folder: str, name: str, text: str) -> None:
    """One JSON file per row, ``<name>.json``; none appears before its task is committed."""
    write_documents(rows, folder, F.col(name), F.col(text))


def read_texts(spark: SparkSession, folder: str) -> DataFrame:
    """path and whole text of every JSON file, for validation that reports and never aborts."""
    return spark.read.option("pathGlobFilter", "*.json").text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """version, position, name, hint; the order is significant."""
    rows = spark.read.schema("version int, classes array<struct<name:string,hint:string>>").option("multiLine", True).json(path)
    return rows.select("version", F.posexplode("classes").alias("position", "c")).select("version", "position", "c.name", "c.hint")


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    schema = "queries array<struct<expected_ticket_id:bigint,query_raw:string,expected_problem:string,kind:string,difficulty:string>>"
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("queries").alias("q")).select("q.*")


def read_distractors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("queries array<struct<id:string,class:string,query_raw:string>>").option("multiLine", True).json(path).select(F.explode("queries").alias("q")).select("q.*")


def numbered(rows: DataFrame, file_name: str = "file_name") -> DataFrame:
    """With ``number``: the last part of the file's stem, as an integer; ordered by it."""
    stem = F.regexp_replace(F.col(file_name), r"\.[^.]*$", "")
    return rows.withColumn("number", F.element_at(F.split(stem, "-"), -1).cast("int")).orderBy("number", file_name)


def write_ids(ids: DataFrame, path: str) -> None:
    """One id per line, ascending: part files in the order of their ranges."""
    column = ids.columns[0]
    ids.select(column).repartitionByRange(column).sortWithinPartitions(column).select(F.col(column).cast("string")).write.text(path)


def ids_of_module(spark: SparkSession, url: str, table: str, module: str, **options: str) -> DataFrame:
    """Ids of a module's rows, ascending; filter and column are pushed down."""
    return relational.ids_of(spark, url, table, "id", {"modul": module}, **options)


def read_prompt(spark: SparkSession, path: str) -> str:
    """The text of a prompt file, without its comments; one small file."""
    text = spark.read.text(path, wholetext=True)
    return text.select(strip_editorial(F.col("value")).alias("prompt")).first()["prompt"]
