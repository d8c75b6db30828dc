"""One file for each record: a writer by Spark's Python data source API.

``df.write.format("json_documents").option("path", folder).mode("append").save()`` with the
columns ``name`` and ``text`` makes ``folder/<name>.json``. A task writes its files into a
hidden folder of its own; only when all tasks have succeeded are they moved to their places, by
renames, so a failed task or job leaves nothing that a reader would see (at most the hidden
folder of a task that outlived its job). A file that is already is replaced; ``overwrite`` deletes the folder's other documents first."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any
from urllib.parse import unquote, urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

SUFFIX, HIDDEN = ".json", "_writing"
#: Renames at a time when a job is committed.
THREADS = 16


def opened(path: str) -> tuple[Any, str]:
    """The file system (local, HDFS, S3, ...) and the path in it."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = unquote(urlparse(path).path)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class Staged(WriterCommitMessage):
    """What a task has written: its folder, and how many files."""

    folder: str
    files: int


class JsonDocumentsWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str], schema: StructType, overwrite: bool):
        if "path" not in options:
            raise ValueError("json_documents needs a path")
        if sorted(schema.names) != ["name", "text"]:
            raise ValueError(f"json_documents writes the columns name and text, not {', '.join(schema.names)}")
        self.path, self.overwrite, self.job = options["path"].rstrip("/"), overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[Any]) -> Staged:
        where, root = opened(self.path)
        folder = posixpath.join(root, f"{HIDDEN}-{self.job}", uuid.uuid4().hex)  # an attempt of its own
        where.create_dir(folder, recursive=True)
        files = 0
        for row in iterator:
            name = row["name"]
            if not name or "/" in name or name.startswith((".", "_")):
                raise ValueError(f"{name!r} can't name a document")
            with where.open_output_stream(posixpath.join(folder, name + SUFFIX)) as out:
                out.write((row["text"] or "").encode())
            files += 1
        return Staged(folder, files)

    def commit(self, messages: list[Staged | None]) -> None:
        from pyarrow import fs

        where, root = opened(self.path)
        where.create_dir(root, recursive=True)
        if self.overwrite:
            for info in where.get_file_info(fs.FileSelector(root)):
                if info.type == fs.FileType.File and info.path.endswith(SUFFIX):
                    where.delete_file(info.path)
        with ThreadPoolExecutor(THREADS) as pool:
            for message in filter(None, messages):
                found = where.get_file_info(fs.FileSelector(message.folder))
                list(pool.map(lambda i: where.move(i.path, posixpath.join(root, i.base_name)), found))
        self.clean()

    def abort(self, messages: list[Staged | None]) -> None:
        self.clean()

    def clean(self) -> None:
        from pyarrow import fs

        where, root = opened(self.path)
        folder = posixpath.join(root, f"{HIDDEN}-{self.job}")
        if where.get_file_info(folder).type != fs.FileType.NotFound:
            where.delete_dir(folder)


class JsonDocuments(DataSource):
    @classmethod
    def name(cls) -> str:
        return "json_documents"

    def writer(self, schema: StructType, overwrite: bool) -> JsonDocumentsWriter:
        return JsonDocumentsWriter(self.options, schema, overwrite)


def write_documents(rows: DataFrame, folder: str, name: Column, text: Column, overwrite: bool = False) -> None:
    """One file ``<name>.json`` for each row. Of several rows with one name one file stays."""
    rows.sparkSession.dataSource.register(JsonDocuments)
    out = rows.select(name.cast("string").alias("name"), text.alias("text"))
    out.write.format("json_documents").mode("overwrite" if overwrite else "append").option("path", folder).save()


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """name and text of the documents in a folder."""
    rows = spark.read.option("pathGlobFilter", f"*{SUFFIX}").text(folder, wholetext=True)
    return rows.select(F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "").alias("name"), F.col("value").alias("text"))
