"""Approximate nearest neighbours by learned partitions (after neural LSH).

Fit, on a bounded sample (``SAMPLE`` vectors, those with the smallest hash of their id):
the sample's exact ``NEIGHBOURS``-nearest-neighbour graph is cut into balanced parts, by
growing parts of equal size from spread-out seeds and then refining with label
propagation under a capacity; a small classifier (softmax regression on the vector) is
trained on each sample vector's part, with its neighbours' parts as soft targets. There is
a part for each ``PART_ROWS`` rows of the table, as far as the sample goes (``PART_SAMPLE``
sample vectors for each, so at most 256). The number of parts that a query visits, at
every size of the table, is the smallest that finds ``TARGET`` of the true neighbours of the
sample vectors that were held out (one in ``HELD``), measured against brute force: few where the vectors have clusters, most of
them where they have none.

Index: every row goes to its most probable part, whatever the part's size.

Search: a query visits its most probable parts. A part's rows and the queries that visit it
are dealt to blocks of bounded size by hash; each block of rows meets each block of
queries, and only each block's nearest go on to the merge, so no part, however large, meets
in one task. A part that at most ``QUERY_BLOCK`` queries visit is not copied.
Distances are Euclidean, in double precision, on the original vectors; ties go to the
smaller id.

Vectors that are null, zero, of another length than most, or that hold null, NaN or
infinite components take no part, as a candidate or as a query.

Edge cases: fewer than ``TOP`` candidates: all parts are visited, so all are found; repeated
vectors are separate rows; a row whose id is null is no candidate; of rows with equal id
all are candidates of others, none of each other, and a query id is asked once, with the
smallest of its vectors; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.llm.common import read, written

SAMPLE, NEIGHBOURS, TOP, EVERY = 8192, 10, 10, 100
#: Rows and sample rows for each part, recall aimed at, one in how many sample vectors is held out.
PART_ROWS, PART_SAMPLE, TARGET, HELD = 256, 28, 0.94, 8
#: Rows of a part that meet in one task, and queries with them.
BLOCK, QUERY_BLOCK = 16_384, 8_192


def usable(column: str) -> Column:
    v = F.col(column)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(v.isNotNull() & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def graph(x: Any, k: int) -> Any:
    """Indices of each row's k nearest other rows."""
    import numpy as np

    out = np.empty((len(x), k), dtype=np.int64)
    square = (x**2).sum(axis=1)
    for begin in range(0, len(x), 512):
        d = square[begin : begin + 512, None] - 2 * x[begin : begin + 512] @ x.T + square
        d[np.arange(len(d)), np.arange(begin, begin + len(d))] = np.inf
        near = np.argpartition(d, k - 1, axis=1)[:, :k]
        out[begin : begin + len(d)] = np.take_along_axis(near, np.take_along_axis(d, near, axis=1).argsort(axis=1), axis=1)
    return out


def balanced_parts(near: Any, parts: int, rounds: int = 20) -> Any:
    """A part for each node of the graph, none above 1.1 times the mean size."""
    import numpy as np

    n = len(near)
    draw = np.random.Generator(np.random.PCG64(7))
    most = int(np.ceil(1.1 * n / parts))
    links: list[list[int]] = [[] for _ in range(n)]
    for a in range(n):
        for b in near[a].tolist():
            links[a].append(b)
            links[b].append(a)
    part, size = np.full(n, -1), np.zeros(parts, dtype=np.int64)
    waits = iter(draw.permutation(n).tolist())
    for p in range(parts):  # grow a part from a free node
        edge: list[int] = []
        while size[p] < n // parts:
            node = edge.pop(0) if edge else next((w for w in waits if part[w] < 0), None)
            if node is None:
                break
            if part[node] < 0:
                part[node] = p
                size[p] += 1
                edge += [b for b in links[node] if part[b] < 0]
    for node in np.flatnonzero(part < 0).tolist():
        part[node] = p = int(size.argmin())
        size[p] += 1
    for _ in range(rounds):
        moved = 0
        for node in draw.permutation(n).tolist():
            votes = np.bincount(part[links[node]], minlength=parts) if links[node] else np.zeros(parts)
            votes = np.where(size < most, votes, -1)
            votes[part[node]] = np.count_nonzero(part[links[node]] == part[node]) if links[node] else 0
            to = int(votes.argmax())
            if votes[to] > votes[part[node]]:
                size[part[node]] -= 1
                size[to] += 1
                part[node] = to
                moved += 1
        if moved < n // 200:
            break
    return part


def classifier(x: Any, target: Any, steps: int = 300, rate: float = 0.05) -> tuple[Any, Any]:
    """Softmax regression by Adam on standardised vectors: weights and bias."""
    import numpy as np

    w = np.zeros((x.shape[1] + 1, target.shape[1]))
    x = np.hstack([x, np.ones((len(x), 1))])
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        z = x @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = x.T @ (p - target) / len(x) + 1e-4 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g**2
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], w[-1]


def nearest_of(queries: Any, rows: Any, k: int) -> Any:
    """Indices of each query's k nearest ``rows``."""
    import numpy as np

    out, square = np.empty((len(queries), k), dtype=np.int64), (rows**2).sum(axis=1)
    for begin in range(0, len(queries), 512):
        d = square - 2 * queries[begin : begin + 512] @ rows.T
        out[begin : begin + len(d)] = np.argpartition(d, k - 1, axis=1)[:, :k]
    return out


def fit(rows: Any, count: int, top: int = TOP) -> dict[str, Any]:
    """The model from an array of sample vectors of ``count`` rows: mean, spread, w, b, visits.
    The number of visits is calibrated on vectors that the router has not seen."""
    import numpy as np

    n = len(rows)
    apart = np.arange(n) % HELD == 0 if n >= HELD * (NEIGHBOURS + 1) else np.zeros(n, dtype=bool)
    held, rows = rows[apart], rows[~apart]
    n = len(rows)
    parts = max(2, min(count // PART_ROWS, n // PART_SAMPLE))
    mean, spread = rows.mean(axis=0), rows.std(axis=0) + 1e-9
    k = min(NEIGHBOURS, n - 1)
    if k < 1:
        return {"mean": mean, "spread": spread, "w": np.zeros((rows.shape[1], 1)), "b": np.zeros(1), "visits": 1}
    near = graph(rows, k)
    part = balanced_parts(near, parts)
    target = np.zeros((n, parts))
    for i in range(n):
        target[i] = np.bincount(part[near[i]], minlength=parts) / (2 * k)
        target[i, part[i]] += 0.5
    w, b = classifier((rows - mean) / spread, target)
    model = {"mean": mean, "spread": spread, "w": w, "b": b}
    at = ranked(model, rows)[:, 0]  # where the index puts them
    asked, wanted = (held, nearest_of(held, rows, k)) if len(held) else (rows, near)
    order = ranked(model, asked)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(parts)[None, :], axis=1)
    # the place of each true neighbour's part in the query's order
    found = np.take_along_axis(place, at[wanted], axis=1)
    visits = next((c for c in range(1, parts + 1) if (found < c).mean() >= TARGET), parts) if count > top else parts
    return model | {"visits": visits}


def ranked(model: dict[str, Any], x: Any) -> Any:
    """Parts of each row, most probable first."""
    import numpy as np

    return np.argsort(-((x - model["mean"]) / model["spread"] @ model["w"] + model["b"]), axis=1, kind="stable")


def routed(vectors: DataFrame, model: dict[str, Any], visits: int) -> DataFrame:
    """``vectors`` (id, v) with ``parts``, the ``visits`` most probable ones."""
    import numpy as np

    shared = vectors.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<int>")
    def parts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for v in batches:
            if not len(v):
                yield pd.Series([], dtype=object)
                continue
            found = ranked(shared.value, np.vstack(v.to_list()).astype(float))[:, :visits]
            yield pd.Series(list(found.astype("int32")))

    return vectors.withColumn("parts", parts("v"))


def nearest_in_block(top: int) -> Any:
    def run(key: tuple, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        if not len(queries) or not len(rows):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        x, ids = np.vstack(rows["v"].to_list()), rows["id"].to_numpy()
        square, asked, found, scores = (x**2).sum(axis=1), [], [], []
        largest = square.max()
        for begin in range(0, len(queries), 64):
            part = queries.iloc[begin : begin + 64]
            q, names = np.vstack(part["v"].to_list()), part["id"].to_numpy()
            size = (q**2).sum(axis=1)
            d = size[:, None] - 2 * q @ x.T + square
            d[names[:, None] == ids] = np.inf
            k = min(top, len(ids))
            # rounding of the expanded form: all that may be among the nearest stay
            line = np.partition(d, k - 1, axis=1)[:, k - 1] + 1e-9 * (size + largest)
            of, at = np.nonzero((d <= line[:, None]) & np.isfinite(d))
            exact = np.sqrt(((x[at] - q[of]) ** 2).sum(axis=1))
            order = np.lexsort((ids[at], exact, of))
            of, at, exact = of[order], at[order], exact[order]
            best = np.arange(len(of)) - np.searchsorted(of, of) < top  # the place within the query
            asked.append(names[of[best]])
            found.append(ids[at[best]])
            scores.append(exact[best])
        return pd.DataFrame({"query_id": np.concatenate(asked), "vec_id": np.concatenate(found), "score": np.concatenate(scores)})

    return run


def search(vectors: DataFrame, queries: Column, top: int = TOP, id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the nearest rows of the rows where ``queries``."""
    import numpy as np

    own = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(column).cast("array<double>").alias("v"))
    good = own.where(F.col("id").isNotNull() & usable("v"))
    sizes = good.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    if not sizes:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, count = sizes[0]
    good = good.where(F.size("v") == dim)
    drawn = good.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").collect()
    model = fit(np.array([r["v"] for r in drawn]), count, top)
    indexed = written(routed(good, model, 1).select("id", "v", F.col("parts")[0].alias("part")), "ann-index")
    once = good.where(queries).groupBy("id").agg(F.min("v").alias("v"))
    asked = written(routed(once, model, model["visits"]).select("id", "v", F.explode("parts").alias("part")), "ann-queries")
    blocks_of = lambda n, size, name: F.greatest(F.ceil(n / size), F.lit(1)).cast("int").alias(name)
    held = indexed.groupBy("part").count().select("part", blocks_of(F.col("count"), BLOCK, "blocks"))
    visits = asked.groupBy("part").count().select("part", blocks_of(F.col("count"), QUERY_BLOCK, "query_blocks"))
    plan = F.broadcast(held.join(visits, "part"))  # a row for each part
    within = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    visiting = asked.join(plan, "part").select("id", "v", "part", within(F.col("query_blocks")).alias("query_block"), every(F.col("blocks")).alias("block"))
    blocks = indexed.join(plan, "part").select("id", "v", "part", within(F.col("blocks")).alias("block"), every(F.col("query_blocks")).alias("query_block"))
    key = ["part", "block", "query_block"]
    near = visiting.groupBy(key).cogroup(blocks.groupBy(key)).applyInPandas(nearest_in_block(top), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def op8_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "embeddings"), F.col("id") % EVERY == 0)
