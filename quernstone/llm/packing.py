"""Packing documents into training sequences by vector bin packing.

A sequence is a bin with three limits: tokens, segments, and loss-bearing tokens (for
instruction data: the prompt bears no loss). A document is an item with the vector
(tokens, 1, loss-bearing tokens). The open bin takes, of the items in the pool, the one
with the largest dot product of item vector and free capacity, both as shares of the
limits; an item that fits whole goes before one that has to be cut. If none fits, the
best item is cut so that the bin is full. A bin that can't be filled is trimmed to the
largest power of two, which needs no padding, and the rest goes back to the pool.

Each task packs the documents of its partition as a stream: the pool holds at most
``POOL`` items, whose ids are the only texts in memory, so memory is bounded whatever
the partition's size, and no row is shuffled. A sequence's id is the partition's number
and a counter. A task that runs again reads the same rows and packs them alike, if its
input is a table, as here.

Edge cases: null and empty texts are the end id alone; documents longer than a sequence
are cut; rows with equal ids are packed one by one; an empty table gives no sequences;
other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quernstone.llm.common import read
from quernstone.llm.pieces import WordTable, grouped, library_encoder, tokenizer_path

TABLE, END = "word_bpe_49k.json", 2
#: Tokens, segments and loss-bearing tokens of a sequence; items in a task's pool.
TOKENS, SEGMENTS, LOSS, POOL = 4096, 128, 4096, 512


@dataclass(slots=True)
class Item:
    """A piece of a document, from ``start`` to ``end``: its ids lie in ``buffer`` (4 bytes
    each), which begins at ``base`` and which pieces share. Tokens from ``loss_from`` on
    bear loss."""

    doc_id: int | None
    buffer: bytes
    base: int
    start: int
    end: int
    total: int
    loss_from: int

    def __len__(self) -> int:
        return self.end - self.start

    @property
    def ids(self) -> memoryview:
        return memoryview(self.buffer)[4 * (self.start - self.base) : 4 * (self.end - self.base)]

    def loss(self) -> int:
        return max(0, self.end - max(self.start, self.loss_from))

    def most(self, tokens: int, loss: int) -> int:
        """The longest beginning within both limits."""
        return min(len(self), tokens, loss + max(0, self.loss_from - self.start))

    def cut(self, length: int) -> tuple[Item, Item | None]:
        """Both parts on the same buffer, so cutting a long text costs no copies."""
        at = self.start + length
        rest = Item(self.doc_id, self.buffer, self.base, at, self.end, self.total, self.loss_from) if at < self.end else None
        return Item(self.doc_id, self.buffer, self.base, self.start, at, self.total, self.loss_from), rest

    def alone(self) -> Item:
        """The same piece with a buffer of its own, so that the text's can go."""
        return self if len(self.buffer) == 4 * len(self) else Item(self.doc_id, bytes(self.ids), self.start, self.start, self.end, self.total, self.loss_from)


class Packer:
    def __init__(self, tokens: int = TOKENS, segments: int = SEGMENTS, loss: int = LOSS, pool: int = POOL):
        import numpy as np

        self.np, self.limits, self.size = np, (tokens, segments, loss), pool
        self.pool: list[Item] = []
        self.vectors = np.zeros((2 * pool + segments + 8, 3))

    def add(self, item: Item) -> Iterator[list[Item]]:
        """Takes an item; gives the bins that are closed."""
        tokens, _, loss = self.limits
        while (whole := item.most(tokens, loss)) == tokens:  # a full bin by itself
            first, rest = item.cut(whole)
            yield [first]
            if rest is None:
                return
            item = rest
        self.push(item.alone())
        while len(self.pool) >= self.size:
            yield self.fill()

    def push(self, item: Item) -> None:
        n = len(self.pool)
        if n == len(self.vectors):
            self.vectors = self.np.vstack([self.vectors, self.np.zeros_like(self.vectors)])
        self.vectors[n] = (len(item), 1, item.loss())
        self.pool.append(item)

    def take(self, i: int) -> Item:
        item, last = self.pool[i], self.pool.pop()
        if i < len(self.pool):
            self.pool[i] = last
            self.vectors[i] = self.vectors[len(self.pool)]
        return item

    def fill(self) -> list[Item]:
        """Packs one bin from the pool."""
        np = self.np
        limits = np.array(self.limits, dtype=float)
        free, bin_ = limits.copy(), []
        while self.pool and free.min() >= 1:
            items = self.vectors[: len(self.pool)]
            score = items @ (free / limits**2)
            fits = (items <= free).all(axis=1)
            if free[1] == 1 and free[0] > 1:  # the last segment should fill the bin
                fits &= items[:, 0] == free[0]
            i = int(np.where(fits, score, -1).argmax()) if fits.any() else int(score.argmax())
            item = self.take(i)
            length = item.most(int(free[0]), int(free[2]))
            if length < len(item):
                item, rest = item.cut(length)
                self.push(rest)
            free -= (len(item), 1, item.loss())
            bin_.append(item)
        return self.close(bin_)

    def close(self, bin_: list[Item]) -> list[Item]:
        """The bin as it is if it is full, else its first 2**k tokens."""
        length = sum(map(len, bin_))
        over = length - (length if length == self.limits[0] else 1 << (length.bit_length() - 1))
        while over:
            item = bin_.pop()
            if len(item) > over:
                item, rest = item.cut(len(item) - over)
                bin_.append(item)
                self.push(rest)
                over = 0
            else:
                over -= len(item)
                self.push(item)
        return bin_

    def flush(self) -> Iterator[list[Item]]:
        while self.pool:
            yield self.fill()


COLUMNS = (("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()))
IDS = ("ids", pa.binary())


def packed(docs: DataFrame, path: str, tokens: int = TOKENS, segments: int = SEGMENTS, loss: int = LOSS, pool: int = POOL, loss_from: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece. ``loss_from``: an integer column, the first loss-bearing
    position (null or no column: 0). ``with_ids``: also the piece's ids, as little-endian
    unsigned 32-bit integers."""
    fields = [*COLUMNS, IDS] if with_ids else list(COLUMNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        table = library_encoder(path, WordTable)
        packer, sequence, rows = Packer(tokens, segments, loss, pool), TaskContext.get().partitionId() << 33, []
        end = END.to_bytes(4, "little")

        def written(bins: Iterator[list[Item]]) -> None:
            nonlocal sequence
            for bin_ in bins:
                offset = 0
                for x in bin_:
                    rows.append((x.doc_id, x.start, len(x), zlib.crc32(x.ids), x.total, sequence, offset, *([bytes(x.ids)] if with_ids else [])))
                    offset += len(x)
                sequence += 1

        def batch() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * len(fields)
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])
            rows.clear()
            return out

        for one in batches:
            begins = iter(one.column(2).to_pylist())
            for doc_ids, texts in grouped([one]):
                for doc_id, found in zip(doc_ids, table.many(texts), strict=True):
                    ids = found.tobytes() + end
                    written(packer.add(Item(doc_id, ids, 0, 0, len(ids) // 4, len(ids) // 4, next(begins) or 0)))
                    if len(rows) >= 10_000:
                        yield batch()
            yield batch()
        written(packer.flush())
        yield batch()

    schema = ", ".join(f"{n} {'binary' if n == 'ids' else 'long'}" for n, _ in fields)
    begin = f"cast({loss_from} as long) as loss_from" if loss_from else "cast(0 as long) as loss_from"
    return docs.selectExpr("doc_id", "text", begin).mapInArrow(run, schema)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(read(spark, sf_dir, "documents"), tokenizer_path(TABLE))
