"""Target-distribution importance resampling by bucket-partitioned inverted postings.

Features of a text are its runs of one to three consecutive words, repeats counted; a
feature's bucket is its CRC-32 modulo ``BUCKETS``. A document is worth the sum of its
features' gains, the log of how much more often the target corpus has their buckets; the
draw is without replacement, by the largest of worth plus Gumbel noise (hash of the id).

1. Postings. A task tallies (bucket, document, count) for a block of documents (about
   ``BLOCK_BYTES`` of text), sorts them by bucket, and sends one row for each group of
   buckets: the posting lists of its buckets, packed, and the buckets' totals. Both corpora
   are posted alike. CRCs of runs come from their words' CRCs by array operations.
2. Shuffle by (group of buckets, part), a part being a share of the blocks. So a bucket that
   every document has is spread over as many tasks as the data need, and a
   document meets at most ``GROUPS`` tasks, however many partitions there are.
3. Gains. The buckets' totals of both corpora are combined before their shuffle,
   co-grouped by bucket, and each bucket's gain is computed there: at most ``BUCKETS`` numbers, which
   go back to the posting lists group by group.
4. Contributions. A posting partition turns its lists into each document's part of the
   sum, added up before they are sent; a sum by document reduces them.
5. Draw. Eligible documents are ranked by a running count over ranges of the score
   (``operators.ranking``), so no task sorts them all.

Edge cases: a null or empty text has no feature and weight 0; a null id is hashed as an empty
text and comes last among equal scores; rows with one id are documents of their own (equal
scores among them: in the order of their blocks); an empty target gives every bucket the gain
of a missing one; an empty table of documents gives an empty result; other columns are ignored.
A table that isn't a plain scan of files is written first, as tasks that run again must
make the same blocks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm.common import read
from quernstone.llm.pieces import grouped
from quernstone.llm.sharding import crc_table
from quernstone.operators.ranking import running
from quernstone.tables import plain_scan, scope, scratch, written

BUCKETS, RUNS = 10_000, 3
#: Percent of the eligible documents that are drawn, their least number of words, the seed.
SHARE, LEAST_WORDS, SEED = 5, 20, 42
#: Groups of buckets; parts of the blocks at least; text in a block; documents in a block.
GROUPS, PARTS, BLOCK_BYTES, BLOCK_DOCS = 16, 16, 4 << 20, 60_000
#: Words of one text that are hashed at once; sums that a task holds before it sends them.
STEP, HELD = 1 << 18, 2_000_000
#: Reversed polynomial of CRC-32 (a fixed value).
POLYNOMIAL = 0xEDB88320

POSTINGS = "g int, block long, n int, ids array<long>, words array<long>, totals array<long>, payload binary"

#: Letters and digits of ASCII, and all beyond it, stay (A-Z in lower case); the rest is a space.
KEEP = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


@lru_cache(maxsize=1)
def shift_tables() -> tuple:
    """Tables of what n further bytes make of a CRC: for n below 64, and for 64 * 2**k."""
    import numpy as np

    byte = np.arange(256, dtype=np.uint32)
    step = byte.copy()
    for _ in range(8):
        step = step >> np.uint32(1) ^ np.where(step & np.uint32(1), np.uint32(POLYNOMIAL), np.uint32(0))

    def once(x):
        return x >> np.uint32(8) ^ step[x & np.uint32(255)]

    small = np.empty((65, 4, 256), dtype=np.uint32)
    small[0] = np.stack([byte << np.uint32(8 * k) for k in range(4)])
    for n in range(64):
        small[n + 1] = once(small[n])
    large = [small[64]]
    for _ in range(25):
        large.append(applied(large[-1].reshape(-1), 0, large[-1]))
    return small[:64].reshape(-1).copy(), [t.reshape(-1).copy() for t in large], once


def applied(table, at, x):
    """``x`` through the table that begins at ``at``."""
    import numpy as np

    eight, low = np.uint32(8), np.uint32(255)
    out = table[at + (x & low)]
    for k in (1, 2, 3):
        x = x >> eight
        out = out ^ table[at + 256 * k + (x & low)]
    return out


def shifted(crc, lengths):
    """CRCs after as many further zero bytes."""
    import numpy as np

    small, large, _ = shift_tables()
    out = applied(small, (lengths & 63) * 1024, crc)
    left, k = lengths >> 6, 0
    while len(odd := np.flatnonzero(left >> k & 1)) or (left >> k).any():
        out[odd] = applied(large[k], 0, out[odd])
        k += 1
    return out


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(KEEP).split()


def buckets(words: list[bytes], doc) -> tuple:
    """(bucket, doc) of every run of words inside one document; ``doc`` numbers the words' documents."""
    import numpy as np

    once = shift_tables()[2]
    space = np.uint32(zlib.crc32(b" "))
    crc = np.fromiter(map(zlib.crc32, words), dtype=np.uint32, count=len(words))
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    found, docs, runs = [crc % np.uint32(BUCKETS)], [doc], crc
    for n in range(1, RUNS):
        runs = shifted(once(runs[:-1]) ^ space, lengths[n:]) ^ crc[n:]
        inside = doc[n:] == doc[:-n]
        found.append((runs % np.uint32(BUCKETS))[inside])
        docs.append(doc[n:][inside])
    return np.concatenate(found).astype(np.int64), np.concatenate(docs)


def tallied(texts: list) -> tuple:
    """(words of each text, keys, counts): keys are bucket * len(texts) + place, ascending."""
    import numpy as np

    d, sizes, keys, counts = len(texts), np.zeros(len(texts), dtype=np.int64), [], []
    lists: list[list[bytes]] = []
    for i, text in enumerate(texts):
        words = words_of(text)
        sizes[i] = len(words)
        if len(words) > STEP:  # alone, in steps that overlap
            total = np.zeros(BUCKETS, dtype=np.int64)
            for at in range(0, len(words), STEP):
                part = words[max(0, at - RUNS + 1) : at + STEP]
                total += np.bincount(buckets(part, np.zeros(len(part), dtype=np.int8))[0], minlength=BUCKETS)
                if at:  # the overlap's own runs were counted in the step before
                    head = words[at - RUNS + 1 : at]
                    total -= np.bincount(buckets(head, np.zeros(len(head), dtype=np.int8))[0], minlength=BUCKETS)
            some = np.flatnonzero(total)
            keys.append(some * d + i)
            counts.append(total[some])
            words = []
        lists.append(words)
    joined = [w for words in lists for w in words]
    if joined:
        doc = np.repeat(np.arange(d), [len(words) for words in lists])
        found, at = buckets(joined, doc)
        key, count = np.unique(found * d + at, return_counts=True)
        keys.append(key)
        counts.append(count)
    if not keys:
        return sizes, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    return sizes, key[order], count[order]


def planes(values) -> bytes:
    """Numbers below 2**32 as four planes of bytes, which compress well."""
    import numpy as np

    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unplaned(raw, n: int):
    import numpy as np

    return np.frombuffer(raw, dtype=np.uint8, count=4 * n).reshape(4, n).T.copy().view("<u4").reshape(-1).astype(np.int64)


def first_bucket(g: int) -> int:
    """Groups are ranges of buckets."""
    return -(-g * BUCKETS // GROUPS)


def packed(bucket, doc, count, low: int, high: int, compressor) -> tuple[list[int], bytes]:
    """Totals of the buckets from ``low`` to ``high``, and their posting lists: lengths, steps
    from document to document (the first from -1), counts."""
    import numpy as np

    lengths = np.bincount(bucket - low, minlength=high - low)
    totals = np.bincount(bucket - low, weights=count, minlength=high - low).astype(np.int64)
    before = np.concatenate(([-1], doc[:-1]))[: len(doc)]
    begins = np.cumsum(lengths) - lengths
    before[begins[lengths > 0]] = -1
    raw = len(doc).to_bytes(8, "little") + planes(lengths) + planes(doc - before - 1) + planes(count)
    return totals.tolist(), compressor.compress(raw)


def unpacked(payload: bytes, size: int, opened) -> tuple:
    """(bucket in its group, doc, count) of each posting."""
    import numpy as np

    raw = opened.decompress(payload)
    n = int.from_bytes(raw[:8], "little")
    lengths = unplaned(raw[8:], size)
    steps, counts = unplaned(raw[8 + 4 * size :], n), unplaned(raw[8 + 4 * size + 4 * n :], n)
    bucket = np.repeat(np.arange(size), lengths)
    total = np.cumsum(steps + 1)
    begins = np.cumsum(lengths) - lengths
    base = np.concatenate(([0], total))[begins]  # what stands before each list
    return bucket, total - np.repeat(base, lengths) - 1, counts


def postings(docs: DataFrame, id_col: str, text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows of ``POSTINGS``: for each block of documents and group of buckets that it has,
    the posting lists; ids and numbers of words with the first group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import zstandard
        from pyspark import TaskContext

        compressor = zstandard.ZstdCompressor(level=3)
        block = TaskContext.get().partitionId() << 32
        edges = [first_bucket(g) for g in range(GROUPS + 1)]

        def solve(ids: list, texts: list) -> pa.RecordBatch:
            sizes, key, count = tallied(texts)
            bucket, doc = key // max(len(texts), 1), key % max(len(texts), 1)
            at, rows = np.searchsorted(bucket, edges), []
            for g in range(GROUPS):
                low, high = at[g], at[g + 1]
                if g and low == high:
                    continue
                totals, payload = packed(bucket[low:high], doc[low:high], count[low:high], edges[g], edges[g + 1], compressor)
                rows.append((g, block, len(ids), ids if g == 0 else None, sizes.tolist() if g == 0 else None, totals, payload))
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
            names = ["g", "block", "n", "ids", "words", "totals", "payload"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        ids, texts, size = [], [], 0
        for some_ids, some_texts in grouped(batches):
            ids += some_ids
            texts += some_texts
            size += sum(len(t or "") for t in some_texts)
            if size >= block_bytes or len(ids) >= BLOCK_DOCS:
                yield solve(ids, texts)
                ids, texts, size = [], [], 0
                block += 1
        if ids:
            yield solve(ids, texts)

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, POSTINGS)


def totals_of(posted: DataFrame) -> DataFrame:
    """bucket, total over a corpus; each task adds its blocks up first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        total = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for g, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                total[first_bucket(g) : first_bucket(g + 1)] += t.values.to_numpy(zero_copy_only=False)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "total"])

    return posted.select("g", "totals").mapInArrow(run, "bucket long, total long").groupBy("bucket").agg(F.sum("total").alias("total"))


def gains(source: DataFrame, target: DataFrame) -> DataFrame:
    """g, gains (of the group's buckets in order) from the totals of two corpora."""
    spark = source.sparkSession
    every = spark.range(BUCKETS).withColumnRenamed("id", "bucket")
    both = source.select("bucket", F.col("total").alias("s")).join(target.select("bucket", F.col("total").alias("t")), "bucket", "full")
    both = written(both.na.fill(0, ["s", "t"]), "totals", BUCKETS)
    sums = both.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("all_s"), F.coalesce(F.sum("t"), F.lit(0)).alias("all_t"))
    rows = every.join(both, "bucket", "left").na.fill(0, ["s", "t"]).join(F.broadcast(sums))  # one row
    d = lambda c: F.col(c).cast("double")
    ratio = (d("t") + 1) * (d("all_s") + BUCKETS) / ((d("s") + 1) * (d("all_t") + BUCKETS))
    rows = rows.select("bucket", F.floor(F.lit(1000.0) * F.ln(ratio)).alias("gain"))
    group = F.floor(F.col("bucket") * GROUPS / F.lit(BUCKETS)).cast("int")
    listed = F.sort_array(F.collect_list(F.struct("bucket", "gain")))  # BUCKETS / GROUPS of them
    return rows.groupBy(group.alias("g")).agg(listed["gain"].alias("gains"))


def contributions(posted: DataFrame, gained: DataFrame) -> DataFrame:
    """block, at, weight (a part of the sum), and once for each document doc_id and words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import zstandard

        opened = zstandard.ZstdDecompressor()
        sums: dict[int, np.ndarray] = {}
        names = ["block", "at", "weight", "doc_id", "words", "named"]

        def sent() -> Iterator[pa.RecordBatch]:
            for block, total in sums.items():
                some = np.flatnonzero(total)
                none = pa.nulls(len(some), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), block)), pa.array(some), pa.array(total[some]), none, none, pa.array(np.zeros(len(some), dtype=bool))], names)
            sums.clear()

        held = 0
        for batch in batches:
            g, block, n, ids, words, payload, gain = (batch.column(i) for i in range(7))
            for i in range(batch.num_rows):
                first, size = first_bucket(g[i].as_py()), first_bucket(g[i].as_py() + 1)
                bucket, doc, count = unpacked(payload[i].as_py(), size - first, opened)
                worth = gain[i].values.to_numpy(zero_copy_only=False)[bucket] * count
                at, docs = block[i].as_py(), n[i].as_py()
                if at not in sums:
                    sums[at] = np.zeros(docs, dtype=np.int64)
                    held += docs
                np.add.at(sums[at], doc, worth)
                if ids[i].is_valid:
                    zero = pa.array(np.zeros(docs, dtype=np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(docs, at)), pa.array(np.arange(docs)), zero, ids[i].values, words[i].values, pa.array(np.ones(docs, dtype=bool))], names)
                if held > HELD:
                    yield from sent()
                    held = 0
        yield from sent()

    met = posted.drop("totals").join(F.broadcast(gained), "g")  # BUCKETS numbers
    return met.select("g", "block", "n", "ids", "words", "payload", "gains").mapInArrow(run, "block long, at long, weight long, doc_id long, words long, named boolean")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from the id's hash."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0))))


def weights(docs: DataFrame, target: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """block, at (they name a row), doc_id, words, weight of every row of ``docs``."""
    if not plain_scan(docs):
        docs = written(docs, "docs")
    parts = max(PARTS, 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // GROUPS)
    posted = postings(docs, id_col).withColumn("part", F.pmod(F.xxhash64("block"), F.lit(parts)))
    posted = written(posted.repartition("g", "part").drop("part"), "postings")
    wanted = postings(target.select(F.lit(0).alias("id"), "text"), "id")
    gained = gains(totals_of(posted), totals_of(wanted))
    sums = contributions(posted, gained).groupBy("block", "at")
    return sums.agg(F.max("doc_id").alias("doc_id"), F.max("words").alias("words"), F.sum("weight").alias("weight"))


def resampled(docs: DataFrame, target: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank (null: not drawn) for every row of ``docs``
    (doc_id, text), drawn to look like ``target`` (text)."""
    spark = docs.sparkSession
    outer = scope(spark)
    with scratch(spark):
        rows = weights(docs, target)
        score = F.col("weight") + noise(F.col("doc_id"), seed)
        rows = written(rows.withColumn("score", score), "weights", into=outer)
    fits = F.col("words") >= least_words
    drawn = rows.where(fits).count() * share // 100
    order = [-F.col("score"), F.col("doc_id").isNull(), F.col("doc_id"), F.col("block"), F.col("at")]
    ranked = running(rows.where(fits), [], order, out="rank").withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    both = ranked.unionByName(rows.where(~fits).withColumn("rank", F.lit(None).cast("long")))
    features = sum((F.greatest(F.col("words") - n, F.lit(0)) for n in range(1, RUNS)), F.col("words"))
    return both.select("doc_id", features.alias("n_features"), "weight", "score", "rank")


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def oracle() -> str:
    """The query in SQL, which has no CRC-32: it is computed byte by byte."""
    step = f"xor(c >> 8, ({crc_table()}::bigint[])[((xor(c, b)) & 255) + 1])"
    return f"""
with w as (select 'd' as corpus, row_number() over () as row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') as w from documents
  union all select 'b', row_number() over (), null, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') from benchmark),
f as (select corpus, row, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) as feature from w),
g as (select corpus, row, feature, count(*) as c from f group by all),
h as (select feature, hex(encode(feature)) as x, octet_length(encode(feature)) as n from (select distinct feature from g)),
k as (select feature, xor(list_reduce(list_transform(range(0, n), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::bigint), lambda c, b: {step}, 4294967295::bigint), 4294967295::bigint) % {BUCKETS} as bucket from h),
p as (select corpus, row, bucket, sum(c)::bigint as c from g join k using (feature) group by all),
t as (select bucket, coalesce(sum(c) filter (where corpus = 'd'), 0)::bigint as s, coalesce(sum(c) filter (where corpus = 'b'), 0)::bigint as t from p group by 1),
a as (select sum(s)::bigint as s, sum(t)::bigint as t from t),
n as (select bucket, floor(1000.0::double * ln((t.t + 1)::double * (a.s + {BUCKETS})::double / ((t.s + 1)::double * (a.t + {BUCKETS})::double)))::bigint as gain from t, a),
z as (select row, sum(c * gain)::bigint as weight from p join n using (bucket) where corpus = 'd' group by 1),
o as (select row, doc_id, len(w) as words, len(w) + greatest(len(w) - 1, 0) + greatest(len(w) - 2, 0) as n_features, coalesce(weight, 0) as weight,
        coalesce(weight, 0) + floor(-1000.0::double * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint + 0.5::double) / 4294967296.0::double)))::bigint as score
      from w left join z using (row) where corpus = 'd'),
r as (select row, row_number() over (order by score desc, doc_id nulls last, row) as rank from o where words >= {LEAST_WORDS})
select doc_id, n_features, weight, score, case when rank <= (select count(*) from r) * {SHARE} // 100 then rank end as rank from o left join r using (row)"""
