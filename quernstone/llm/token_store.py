"""Binary token output as a content-addressed store.

Layout of a store (all files are Parquet, written and read by Spark):

``kind=chunk``   digest, data      unique chunks, each stored once
``kind=recipe``  one row per document: the digests of its chunks in order, their
                 ends, and the Merkle root over the digests
``manifest``     recipes in ascending doc_id order with ``start``, the number of ids
                 before the document, and the part that the row is in

A document's ids, with the end id, are cut where a rolling hash over the last
``WINDOW`` ids meets a mask, so equal passages are cut alike wherever they stand.
Chunks are named by BLAKE2b-128 of their ids, which are kept as zstandard-compressed
16- or 32-bit integers. One shuffle by digest brings equal chunks together (each task
sends a chunk once only, so a chunk that many documents share does not pile up).

Reading back decompresses every chunk, recomputes digest, length and CRC, joins them to
the recipes by digest, and recomputes the Merkle root. A document's CRC is the XOR of
its chunks' CRCs, each carried over the bytes that follow it (polynomial arithmetic
modulo the CRC polynomial), so no task has to hold a document.

Edge cases: null and empty texts are the end id alone; repeated ids are separate rows,
in the order of their texts' places in the input; null ids come last; an empty table
gives an empty store; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.llm.common import new_path, read, spread_join
from quernstone.llm.pieces import grouped, library_table, tokenizer_path

TABLE, END = "byte_bpe_50k.json", 2
#: Ids in the rolling hash's window (a power of two); shortest and longest chunk; a cut falls on one id in
#: 2**MASK_BITS beyond the shortest.
WINDOW, LEAST, MOST, MASK_BITS = 16, 256, 8192, 10
#: Digests of chunks already sent that a task remembers.
SENT = 200_000
#: Reversed CRC-32 polynomial (fixed value).
POLYNOMIAL = 0xEDB88320

ROWS = "kind string, key binary, doc_id long, row long, n long, data binary, digests array<binary>, ends array<long>, root binary"
SCHEMA = pa.schema([("kind", pa.string()), ("key", pa.binary()), ("doc_id", pa.int64()), ("row", pa.int64()), ("n", pa.int64()), ("data", pa.binary()), ("digests", pa.list_(pa.binary())), ("ends", pa.list_(pa.int64())), ("root", pa.binary())])


def cuts(ids: Any) -> list[int]:
    """Ends of the chunks of an array of ids."""
    import numpy as np

    n = len(ids)
    if n <= LEAST:
        return [n]
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    rolled, width = mixed, 1  # sums over 1, 2, 4, ... ids, each id times a power of the factor
    while width < WINDOW:
        factor = np.uint64(pow(0x100000001B3, width, 1 << 64))
        wider = rolled.copy()
        wider[width:] += rolled[:-width] * factor
        rolled, width = wider, 2 * width
    marks = np.flatnonzero((rolled >> np.uint64(64 - MASK_BITS)) == 0) + 1
    ends, at = [], 0
    for mark in marks.tolist():
        while mark - at > MOST:
            at += MOST
            ends.append(at)
        if mark - at >= LEAST:
            ends.append(mark)
            at = mark
    while n - at > MOST:
        at += MOST
        ends.append(at)
    return [*ends, n] if at < n else ends


def merkle(digests: list[bytes]) -> bytes:
    """Root of the binary hash tree; an odd node goes up as it is."""
    level = list(digests)
    while len(level) > 1:
        level = [hashlib.blake2b(b"".join(level[i : i + 2]), digest_size=16).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def shrink(ids: Any, compressor: Any) -> bytes:
    """One byte for the width, then the ids, low bytes first, compressed."""
    import numpy as np

    width = 2 if not len(ids) or ids.max() < 1 << 16 else 4
    planes = np.ascontiguousarray(ids.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T)
    return bytes([width]) + compressor.compress(planes.tobytes())


def grow(data: bytes, decompressor: Any) -> Any:
    import numpy as np

    width = data[0]
    planes = np.frombuffer(decompressor.decompress(data[1:]), dtype=np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").ravel().astype("<u4")


def chunked(docs: DataFrame, path: str) -> DataFrame:
    """Chunk rows (once per task) and recipe rows of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import zstandard
        from pyspark import TaskContext

        table, compressor = library_table(path), zstandard.ZstdCompressor(level=3, write_content_size=True)
        row, sent, rows, size = TaskContext.get().partitionId() << 33, set(), [], 0
        end = np.array([END], dtype="<u4")

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), SCHEMA, strict=True)], schema=SCHEMA)
            rows.clear()
            return out

        for doc_ids, texts in grouped(batches):
            for doc_id, found in zip(doc_ids, table.many(texts), strict=True):
                ids = np.concatenate((found, end))
                raw = memoryview(ids).cast("B")
                begin, digests, ends = 0, [], cuts(ids)
                for stop in ends:
                    digest = hashlib.blake2b(raw[4 * begin : 4 * stop], digest_size=16).digest()
                    digests.append(digest)
                    if digest not in sent:
                        if len(sent) >= SENT:
                            sent.clear()
                        sent.add(digest)
                        data = shrink(ids[begin:stop], compressor)
                        size += len(data)
                        rows.append(("chunk", digest, None, None, stop - begin, data, None, None, None))
                    begin = stop
                rows.append(("recipe", row.to_bytes(8, "little"), doc_id, row, len(ids), None, digests, ends, merkle(digests)))
                row += 1
                if size > 4 << 20 or len(rows) > 20_000:
                    yield batch()
                    size = 0
        if rows:
            yield batch()

    return docs.select("doc_id", "text").mapInArrow(run, ROWS)


def store(docs: DataFrame, tokenizer: str) -> str:
    """Writes the store of ``docs`` into the shared folder; gives its path."""
    spark = docs.sparkSession
    path = new_path(spark, "token-store")
    once = Window.partitionBy("key").orderBy("kind")
    rows = chunked(docs, tokenizer).withColumn("copy", F.row_number().over(once)).where("kind = 'recipe' or copy = 1").drop("copy")
    rows.write.partitionBy("kind").parquet(path)
    order = ["doc_id", "row"]
    recipes = part(spark, path, "recipe").select("doc_id", "row", "n", "digests", "ends", "root")
    ranged = recipes.repartitionByRange(F.col("doc_id").asc_nulls_last(), "row").sortWithinPartitions(F.col("doc_id").asc_nulls_last(), "row")
    ranged.withColumn("part", F.spark_partition_id()).write.parquet(f"{path}-ranged")
    ranged = spark.read.schema(ranged.schema.add("part", "integer")).parquet(f"{path}-ranged")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    parts = ranged.groupBy("part").agg(F.sum("n").alias("ids")).select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy(F.col(order[0]).asc_nulls_last(), order[1]).rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(parts, "part")
    starts.select("part", "doc_id", "row", (F.col("base") + F.col("inside")).alias("start"), "n", "digests", "ends", "root").write.parquet(f"{path}-manifest")
    return path


def part(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Rows of one kind; the full schema is given, so no file is opened to infer it."""
    return spark.read.schema(ROWS).parquet(path).where(F.col("kind") == kind)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    schema = "part int, doc_id long, row long, start long, n long, digests array<binary>, ends array<long>, root binary"
    return spark.read.schema(schema).parquet(f"{path}-manifest")


def chunk_facts(spark: SparkSession, path: str) -> DataFrame:
    """digest, n, crc and whether the chunk's content has the name it is stored under."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        opened = zstandard.ZstdDecompressor()
        for batch in batches:
            names, rows = batch.column(0), batch.column(1)
            out: list[tuple] = []
            for i in range(batch.num_rows):
                ids = grow(rows[i].as_py(), opened).tobytes()
                name = names[i].as_py()
                out.append((name, len(ids) // 4, zlib.crc32(ids), hashlib.blake2b(ids, digest_size=16).digest() == name))
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.int64(), pa.bool_()), strict=True)], ["digest", "ids", "crc", "sound"])

    return part(spark, path, "chunk").select("key", "data").mapInArrow(run, "digest binary, ids long, crc long, sound boolean")


def times(a: Any, b: Any) -> Any:
    """Products modulo the CRC polynomial of arrays of reversed 32-bit polynomials."""
    import numpy as np

    a, b, out = a.astype(np.uint64), b.astype(np.uint64), np.zeros(len(a), dtype=np.uint64)
    one = np.uint64(1)
    for bit in range(31, -1, -1):
        out ^= np.where((a >> np.uint64(bit)) & one, b, np.uint64(0))
        b = (b >> one) ^ np.where(b & one, np.uint64(POLYNOMIAL), np.uint64(0))
    return out


def carried(crc: Any, tail: Any) -> Any:
    """CRCs after ``tail`` further zero bytes: crc * x**(8 * tail)."""
    import numpy as np

    power = np.array([1 << 23], dtype=np.uint64)  # x**8
    out, left = crc.astype(np.uint64), tail.astype(np.uint64)
    while left.any():
        odd = (left & np.uint64(1)).astype(bool)
        if odd.any():
            out[odd] = times(np.broadcast_to(power, int(odd.sum())), out[odd])
        power, left = times(power, power), left >> np.uint64(1)
    return out


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, verified for each document of the store."""

    def shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc = carried(batch.column(3).to_numpy(), batch.column(2).to_numpy() * 4).astype("int64")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(crc), batch.column(4)], ["row", "ids", "crc", "sound"])

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = [merkle(d) == r for d, r in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(same, pa.bool_())], ["doc_id", "row", "start", "n", "rooted"])

    recipes = manifest(spark, path)
    begins = F.concat(F.array(F.lit(0).cast("long")), F.slice("ends", 1, F.size("ends") - 1))
    steps = recipes.select("row", "n", F.explode(F.arrays_zip("digests", "ends", begins.alias("begins"))).alias("c"))
    steps = steps.select("row", F.col("c.digests").alias("digest"), (F.col("c.ends") - F.col("c.begins")).alias("length"), (F.col("n") - F.col("c.ends")).alias("tail"))
    uses = steps.groupBy("digest").agg(F.count(F.lit(1)).alias("size"))  # a chunk may stand in very many documents
    met = spread_join(steps, chunk_facts(spark, path), ["digest"], uses, by="row").select("row", "ids", "tail", "crc", (F.col("sound") & (F.col("ids") == F.col("length"))).alias("sound"))
    sums = met.mapInArrow(shift, "row long, ids long, crc long, sound boolean").groupBy("row").agg(F.sum("ids").alias("n_tokens"), F.bit_xor("crc").alias("ids_crc32"), F.bool_and("sound").alias("sound"))
    checked = recipes.select("doc_id", "row", "start", "n", "digests", "root").mapInArrow(roots, "doc_id long, row long, start long, n long, rooted boolean")
    return checked.join(sums, "row").select("doc_id", "start", "n_tokens", "ids_crc32", (F.col("rooted") & F.col("sound") & (F.col("n") == F.col("n_tokens"))).alias("verified"))


def restored(spark: SparkSession, path: str, doc_ids: DataFrame) -> DataFrame:
    """doc_id and ids of the documents asked for, put together from their chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import zstandard

        opened = zstandard.ZstdDecompressor()
        for batch in batches:
            ids = [np.concatenate([grow(x, opened) for x in parts]).astype("int64") for parts in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int64()))], ["doc_id", "ids"])

    wanted = manifest(spark, path).join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi")
    steps = wanted.select("doc_id", "row", F.posexplode("digests").alias("at", "key"))
    parts = steps.join(part(spark, path, "chunk").select("key", "data"), "key").groupBy("row", "doc_id").agg(F.sort_array(F.collect_list(F.struct("at", "data"))).alias("parts"))
    return parts.select("doc_id", F.col("parts.data").alias("parts")).mapInArrow(run, "doc_id long, ids array<long>")


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(spark, store(read(spark, sf_dir, "documents"), tokenizer_path(TABLE)))
