"""Fill-in-the-middle transformation of whole texts.

A text becomes a UTF-32 array of code points. A class is given to each code point, and
``flatnonzero`` of the places where neighbouring classes differ yields the units'
boundaries. Two ranks, drawn from a hash of the document's id, choose two boundaries; the
array is sliced there, and the pieces are encoded again behind sentinels:

    psm  <P>prefix<S>suffix<M>middle        spm  <S>suffix<P>prefix<M>middle

or the text stays plain. Units are code points (``chars``: classes alternate, so all
neighbours differ), runs of white and other characters (``words``), or ``lines``.

``restored`` rebuilds the text from the output and the form alone, JVM-side: a sentinel can't
begin inside a piece and end in the next one, as no end of one is the beginning of another.

Rows are transformed one by one, without a shuffle; the transformation depends on id and
text alone, so a task that runs again gives the same.

Edge cases: null and empty texts have no unit and stay plain, with an empty output; so do
texts that contain a sentinel. A null id is hashed as an empty text. Rows with equal ids are
each transformed. An empty table gives an empty result; other columns are ignored, and
``transformed`` carries none of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm.common import read
from quernstone.llm.pieces import grouped

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SENTINELS = (PREFIX, SUFFIX, MIDDLE)
#: Percent of texts that are transformed, percent of those in the form spm, and the seed.
RATE, SPM, SEED = 90, 20, 1
UNITS = ("chars", "words", "lines")
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
KINDS = [("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())]

#: White space of the unit ``words``: what Unicode calls so.
WHITE = [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def classes(points, unit: str):
    """A number for each code point; a unit ends where it changes."""
    import numpy as np

    if unit == "chars":
        return np.arange(len(points)) & 1
    if unit == "words":
        return np.isin(points, WHITE)
    ends = points == 10  # a line ends after its line feed
    return np.cumsum(ends) - ends


def boundaries(points, unit: str = "chars"):
    """Where units begin, and the end: one more than there are units."""
    import numpy as np

    kinds = classes(points, unit)
    inner = np.flatnonzero(kinds[1:] != kinds[:-1]) + 1
    return np.concatenate(([0], inner, [len(points)])) if len(points) else np.zeros(1, dtype=np.int64)


def draws(doc_id: int | None, seed: int) -> list[int]:
    found = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(found[i : i + 8], 16) for i in range(0, 32, 8)]


def transform(doc_id: int | None, text: str | None, unit: str = "chars", rate: int = RATE, spm: int = SPM, seed: int = SEED) -> tuple:
    """One row of ``SCHEMA``."""
    import numpy as np

    text = text or ""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    edges = boundaries(points, unit)
    n = len(edges) - 1
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or any(s in text for s in SENTINELS) or h3 % 100 >= rate:
        return doc_id, n, "plain", None, None, text
    first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
    begin, end = int(edges[first]), int(edges[last])
    prefix, middle, suffix = (p.tobytes().decode("utf-32-le", "surrogatepass") for p in (points[:begin], points[begin:end], points[end:]))
    if h4 % 100 < spm:
        return doc_id, n, "spm", begin, end - begin, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return doc_id, n, "psm", begin, end - begin, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def transformed(docs: DataFrame, unit: str = "chars", rate: int = RATE, spm: int = SPM, seed: int = SEED) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars (null if plain), output (text) of
    every row of ``docs`` (doc_id, text)."""
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {', '.join(UNITS)}, not {unit!r}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in grouped(batches):
            rows = [transform(i, t, unit, rate, spm, seed) for i, t in zip(ids, texts, strict=True)]
            columns = [pa.array(c, kind) for c, (_, kind) in zip(zip(*rows, strict=True), KINDS, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, [name for name, _ in KINDS])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def restored(output: Column, form: Column) -> Column:
    """The text again, from the output and its form."""
    parts = F.split(output, "<[PSM]>", -1)
    psm, spm = (F.concat(*[F.get(parts, F.lit(i)) for i in order]) for order in ((1, 3, 2), (2, 3, 1)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = transformed(read(spark, sf_dir, "documents"))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    out = ["doc_id", "n", "form", "prefix_chars", "middle_chars"]
    return rows.select(*out, digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


def oracle() -> str:
    number = lambda i: f"('0x' || substr(h, {8 * i + 1}, 8))::bigint"
    return f"""
with t as (select doc_id, coalesce(text, '') as x, length(coalesce(text, '')) as n, sha256('{SEED}:' || coalesce(doc_id::varchar, '')) as h from documents),
d as (select *, {number(0)} % (n + 1) as r1, {number(1)} % (n + 1) as r2, {number(2)} % 100 as r3, {number(3)} % 100 as r4 from t),
c as (select *, least(r1, r2) as a, greatest(r1, r2) as b,
        case when x = '' or contains(x, '<P>') or contains(x, '<S>') or contains(x, '<M>') or r3 >= {RATE} then 'plain' when r4 < {SPM} then 'spm' else 'psm' end as form from d),
p as (select *, substr(x, 1, a) as prefix, substr(x, a + 1, b - a) as middle, substr(x, b + 1) as suffix from c)
select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars,
  sha256(case form when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle when 'spm' then '<S>' || suffix || '<P>' || prefix || '<M>' || middle else x end) as output_sha256,
  sha256(x) as restored_sha256 from p"""
