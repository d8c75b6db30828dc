"""Queries against all records by blocks of vectors, so that no pair becomes a row.

The queries of one pass are counted and bounded (``QUERIES``, ``QUERY_BYTES``), and sent to
the tasks once; more queries take more passes over the corpus, which is not shuffled. A task
multiplies its records' vectors, block by block, with the queries' matrix. Products are
only a first look: what comes within ``CLOSE`` of a decision is scored again exactly as
``functions.vectors.dot`` does, term by term in order, so results and ties are the same as
with one row for each pair."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Queries of a pass, bytes of their vectors, records in a block, cells of a product, pairs
#: that are scored exactly at once.
QUERIES, QUERY_BYTES, BLOCK, CELLS, PAIRS = 10_000, 64 << 20, 4_096, 1 << 22, 1 << 18
#: Bound on what rounding makes of a product of unit vectors, with room to spare.
CLOSE = 1e-9


def passes(queries: DataFrame) -> list[DataFrame]:
    """``queries`` (id, v, ...) in parts that may be broadcast; by hash of the id."""
    count, width = queries.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    most = max(1, min(QUERIES, QUERY_BYTES // (8 * max(width or 1, 1))))
    if count <= most:
        return [queries]
    # hashes are even, but not exactly: half as many more parts keep each one below the bound
    n = -(-count * 3 // (2 * most))
    return [queries.where(F.pmod(F.xxhash64("id"), F.lit(n)) == i) for i in range(n)]


def collected(queries: DataFrame) -> tuple[list, Any, list]:
    """ids, matrix and further columns of one pass; rows without a vector are left out."""
    import numpy as np

    rows = [r for r in queries.where("v is not null").collect()]
    size = max((len(r["v"]) for r in rows), default=0)
    rows = [r for r in rows if len(r["v"]) == size and None not in r["v"]]
    matrix = np.array([r["v"] for r in rows], dtype=np.float64).reshape(len(rows), size)
    return [r["id"] for r in rows], matrix, rows


def matrix_of(column: pa.Array, size: int) -> tuple[Any, Any]:
    """The vectors of ``size`` numbers in an Arrow list column, and their places."""
    import numpy as np

    lengths = np.diff(column.offsets.to_numpy())
    good = (lengths == size) & column.is_valid().to_numpy(zero_copy_only=False)
    values = column.values
    if values.null_count:
        bad = ~values.is_valid().to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(len(lengths)), lengths)
        good[owner[bad[column.offsets[0].as_py() : column.offsets[-1].as_py()]]] = False
    at = np.flatnonzero(good)
    begins = column.offsets.to_numpy()[at]
    numbers = values.to_numpy(zero_copy_only=False)
    return numbers[begins[:, None] + np.arange(size)].astype(np.float64), at


def exact(a: Any, b: Any) -> Any:
    """Dot products of rows, term by term in order."""
    import numpy as np

    total = np.zeros(len(a))
    for k in range(a.shape[1]):
        total = total + a[:, k] * b[:, k]
    return total


def products(batch: pa.RecordBatch, matrix: Any) -> Iterator[tuple[Any, Any, Any]]:
    """(place of the records in the batch, their vectors, products with all queries)."""
    size = matrix.shape[1]
    step = max(1, min(BLOCK, CELLS // max(len(matrix), 1)))
    for begin in range(0, batch.num_rows, step):
        part = batch.column(1).slice(begin, step)
        vectors, at = matrix_of(part, size)
        if len(at):
            yield at + begin, vectors, matrix @ vectors.T


def places(ids: list) -> dict[Any, list[int]]:
    """The queries with each id: a query may be asked more than once."""
    found: dict[Any, list[int]] = {}
    for n, i in enumerate(ids):
        found.setdefault(i, []).append(n)
    return found


def without_own(scores: Any, names: list, at: Any, known: dict[Any, list[int]]) -> None:
    import numpy as np

    for c, place in enumerate(at.tolist()):
        for n in known.get(names[place], ()):
            scores[n, c] = -np.inf


def nearest(queries: DataFrame, corpus: DataFrame, k: int, same: bool = False) -> DataFrame:
    """query_id, id, score of the ``k`` best records of each query; each task sends its own
    best ones, ties to the smaller id. ``same``: a query may find the record with its id."""
    types = [queries.schema["id"].dataType, corpus.schema["id"].dataType]
    rows = None
    for part in passes(queries.select("id", "v").distinct()):
        ids, matrix, _ = collected(part)
        sent = queries.sparkSession.sparkContext.broadcast((ids, matrix))
        schema = f"query_id {types[0].simpleString()}, id {types[1].simpleString()}, score double"
        found = corpus.select("id", "v").mapInArrow(best_of(sent, k, same, [to_arrow_type(t) for t in types]), schema)
        rows = found if rows is None else rows.unionByName(found)
    return rows


def best_of(sent: Any, k: int, same: bool, kinds: list[pa.DataType]) -> Any:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        ids, matrix = sent.value
        known = {} if same else places(ids)
        heap: list[list[tuple[float, Any]]] = [[] for _ in ids]
        floor = np.full(len(ids), -np.inf)  # the k-th best score so far
        for batch in batches:
            names = batch.column(0).to_pylist()
            for at, vectors, scores in products(batch, matrix):
                without_own(scores, names, at, known)
                bar = floor
                if len(at) > k:
                    bar = np.maximum(floor, np.partition(scores, len(at) - k, axis=1)[:, len(at) - k])
                q, c = np.nonzero((scores >= (bar - CLOSE)[:, None]) & (scores > -np.inf))
                if not len(q):
                    continue
                value = np.concatenate([exact(matrix[q[i : i + PAIRS]], vectors[c[i : i + PAIRS]]) for i in range(0, len(q), PAIRS)])
                edges = np.flatnonzero(np.diff(q, prepend=-1, append=-1))
                for begin, end in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    n = int(q[begin])
                    found = zip((-value[begin:end]).tolist(), (names[at[i]] for i in c[begin:end].tolist()), strict=True)
                    heap[n] = heapq.nsmallest(k, [*heap[n], *found])
                    if len(heap[n]) == k:
                        floor[n] = -heap[n][-1][0]
        out = [(ids[n], i, -s) for n, found in enumerate(heap) for s, i in found]
        columns = list(zip(*out, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [*kinds, pa.float64()], strict=True)], ["query_id", "id", "score"])

    return run


def better(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """query_id, expected_id, better: how many records beat each query's expected one.
    ``queries``: id, v, expected_id, own (the expected record's exact score). A record beats it
    with a higher score, or an equal one and a smaller id; the query's own record is left out.
    Each task sends one number for each query."""
    types = [queries.schema[c].dataType for c in ("id", "expected_id")]
    rows = None
    for part in passes(queries.select("id", "v", "expected_id", "own")):
        _, matrix, found = collected(part)
        sent = queries.sparkSession.sparkContext.broadcast(([(r["id"], r["expected_id"], r["own"]) for r in found], matrix))
        schema = f"query_id {types[0].simpleString()}, expected_id {types[1].simpleString()}, better long"
        counts = corpus.select("id", "v").mapInArrow(count_of(sent, [to_arrow_type(t) for t in types]), schema)
        rows = counts if rows is None else rows.unionByName(counts)
    return rows.groupBy("query_id", "expected_id").agg(F.sum("better").alias("better"))


def count_of(sent: Any, kinds: list[pa.DataType]) -> Any:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        asked, matrix = sent.value
        ids, wanted = [a[0] for a in asked], [a[1] for a in asked]
        own, known = np.array([a[2] for a in asked], dtype=np.float64), places(ids)
        total = np.zeros(len(asked), dtype=np.int64)
        for batch in batches:
            names = batch.column(0).to_pylist()
            for at, vectors, scores in products(batch, matrix):
                without_own(scores, names, at, known)
                total += (scores > (own + CLOSE)[:, None]).sum(axis=1)
                q, c = np.nonzero(np.abs(scores - own[:, None]) <= CLOSE)
                for i in range(0, len(q), PAIRS):
                    qs, cs = q[i : i + PAIRS], c[i : i + PAIRS]
                    value = exact(matrix[qs], vectors[cs])
                    won = value > own[qs]
                    tied = np.flatnonzero(value == own[qs])
                    won[tied] = [names[at[cs[t]]] < wanted[qs[t]] for t in tied.tolist()]
                    total += np.bincount(qs[won], minlength=len(asked))
        columns = [pa.array(x, t) for x, t in zip((ids, wanted, total), [*kinds, pa.int64()], strict=True)]
        yield pa.RecordBatch.from_arrays(columns, ["query_id", "expected_id", "better"])

    return run
