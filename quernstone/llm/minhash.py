"""Near duplicates by an inverted join on MinHash signature coordinates.

Sets. A text is lower-cased (A-Z) and cut into words at ASCII white space; its set is
its distinct shingles of five words (as 64-bit hashes), or the whole sequence where it
has fewer. Documents with equal sets (128 bits of the set's digest) are one *node*, so
copies are linked without any pair, and every later step works on nodes.

Signature. ``COORDINATES`` = 64 minima, each named by its place and value. A pair with
Jaccard similarity 0.75 agrees at 48 places on average, and at fewer than ``MATCHES`` =
30 with a probability of 4 in 10**7: pairs that share fewer coordinates are no candidates.

Join. Nodes are posted under each coordinate-value pair.

* Prefix: a node's coordinates are ordered by the length of their lists, shortest first.
  Two nodes that share ``MATCHES`` coordinates share one of the first
  ``COORDINATES - MATCHES + 1`` of both, so only these are posted; lists of one node need
  no posting, and a node with fewer than ``MATCHES`` other coordinates drops out. A
  passage that very many documents share has the longest lists, which come last: they
  are merged only for texts that consist of the passage by about half or more.
* Skip merging: the lists are merged in two rounds. In the first each list is met by two
  leaders only (the node whose lists are longest together, which in a group of near copies
  is the one most like all others, and one by hash). Lists whose nodes then lie in one
  component are skipped in the second round, as are pairs inside a component, so a large
  group of near copies never becomes all its pairs. The second round merges what is left,
  whole; long lists are dealt to blocks. Nodes enter it only if enough of their shingles
  occur in other components, in nodes of some size, for a link with one of that size (exact).
* Counting: shared coordinates are counted over the whole signatures; pairs with at least
  ``MATCHES`` are confirmed on their full sets, 100 * |A & B| >= 75 * |A | B|. The second
  round holds the pairs that are somewhat alike; there a pair becomes a row only once, in
  the first list that it shares, and only if one bit of ``FINE`` = 1024 further minima
  agrees at ``FINE_MATCHES`` places or more (a pair at 0.75 agrees at 896 on average, and at
  fewer than 842 with a probability of 6 in 10**7).

Components come from alternating stars. No list, bucket or group has a cap. Keys with
more than a share of all rows are spread over blocks in every join (``spread_join``).

Cost: the second round compares nodes of one prefix list that lie in different components.
Very many different documents that consist mostly (by half or more) of one passage, yet
are less than 75 % alike, are compared pair by pair.

Edge cases: null and empty texts have no set (n_shingles 0) and are linked with nothing;
a null id takes no part: its row keeps its own, null, component and is kept; rows with
an equal id are one document in the result only if they are equal in set, else one row
each (``drop_near_copies`` groups row numbers instead of ids, so there every row takes
part); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm.common import numbered, read, scope, scratch, spread_join, written
from quernstone.llm.components import star

SHINGLE, PERCENT = 5, 75
COORDINATES, MATCHES = 64, 30
#: Minima (one bit of each) and match threshold of the finer signature in the second round.
FINE, FINE_MATCHES = 1024, 842
#: Sizes of sets are told apart by this factor when links between components are bounded.
SIZES = 1.05
#: Nodes of a list that meet in one task, with as many others.
BLOCK = 512
#: Ids of candidate documents are broadcast up to this many rows (8 MB); beyond, the
#: texts are joined by a shuffle.
BROADCAST_IDS = 500_000
#: Orders nodes another way for the second leader.
SALT = 0x5DEECE66D1234567
#: Words whose hashes a worker keeps.
WORDS = 300_000

FINE_WORDS = [f"f{i}" for i in range(FINE // 64)]


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


@lru_cache(maxsize=1)
def constants() -> tuple[Any, ...]:
    """Random odd masks, factors and shingle factors, the same in every process."""
    import numpy as np

    draw = np.random.Generator(np.random.PCG64(20_240_607))
    numbers = draw.integers(0, 2**63, size=2 * (COORDINATES + FINE) + 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    masks, factors = numbers[16:].reshape(2, COORDINATES + FINE, 1)
    return masks, factors, numbers[:16], WordHashes()


def mixed(x: Any) -> Any:
    """Finaliser of 64-bit hashes (the constants are MurmurHash3's fixed values)."""
    import numpy as np

    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None) -> Any:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    import numpy as np

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    _, _, factors, known = constants()
    if len(known) > WORDS:
        known.clear()
    h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    n = min(SHINGLE, len(h))
    total = np.full(len(h) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        total += h[k : len(h) - n + 1 + k] * factors[k]
    return np.unique(mixed(total))


def digest(found: Any) -> tuple[int, int]:
    """128 bits of a set's digest, as two int64."""
    raw = hashlib.blake2b(found.tobytes(), digest_size=16).digest()
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


def minima(found: Any, begin: int, end: int, step: int) -> Any:
    """The minima ``begin`` to ``end`` of a set that is not empty."""
    import numpy as np

    masks, factors = (x[begin:end] for x in constants()[:2])
    low = np.full(end - begin, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(found), step):
        part = np.bitwise_xor(found[None, at : at + step], masks)
        part *= factors
        np.minimum(low, part.min(axis=1), out=low)
    return low


def signature(found: Any) -> Any:
    """The coordinates (int64): each minimum with its place."""
    import numpy as np

    low = minima(found, 0, COORDINATES, 512)
    return mixed(low + np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def fine_signature(found: Any) -> Any:
    """One bit of each of the further minima, as int64."""
    import numpy as np

    low = mixed(minima(found, COORDINATES, COORDINATES + FINE, 64))
    return np.packbits((low & np.uint64(1)).astype(np.uint8)).view(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n (set size), d1, d2 (digest), coords; null but for n if the set is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
        for batch in batches:
            for begin in range(0, batch.num_rows, 1024):
                part, rows = batch.slice(begin, 1024), []
                texts = part.column(1)
                for i in range(part.num_rows):
                    found = shingles(texts[i].as_py())
                    rows.append((len(found), *digest(found), signature(found)) if len(found) else (0, None, None, None))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["doc_id", "n", "d1", "d2", "coords"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, d1 long, d2 long, coords array<long>")


def sets_of(docs: DataFrame) -> DataFrame:
    """d1, d2, items, fine: the full sets and finer signatures of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                found = [s for s in (shingles(t.as_py()) for t in batch.column(0).slice(begin, 256)) if len(s)]
                names = [digest(s) for s in found]
                columns = [pa.array([d[k] for d in names], pa.int64()) for k in (0, 1)]
                columns += [pa.array([s.view("int64") for s in found], pa.list_(pa.int64())), pa.array([fine_signature(s) for s in found], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["d1", "d2", "items", "fine"])

    return docs.select("text").mapInArrow(run, "d1 long, d2 long, items array<long>, fine array<long>")


def close_in_size(x: Column, y: Column, percent: int = PERCENT) -> Column:
    return 100 * F.least(x, y) >= percent * F.greatest(x, y)


def finely_alike(a: str, b: str, matches: int = FINE_MATCHES) -> Column:
    """Enough of the further minima agree in their bit; JVM-side."""
    places = F.lit(0)
    for word in FINE_WORDS:
        places = places + F.bit_count(F.col(f"{a}.{word}").bitwiseXOR(F.col(f"{b}.{word}")))
    return places <= FINE - matches


def viable(nodes: DataFrame, matches: int = MATCHES) -> DataFrame:
    """Nodes that can have a partner, with ``fame`` (length of all their lists) and
    ``prefix`` (coordinates to post)."""
    posted = nodes.select("node", F.explode("coords").alias("key"))
    counts = written(posted.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "lists")
    lists = F.sort_array(F.collect_list(F.struct("size", "key"))).alias("lists")  # at most COORDINATES entries
    ordered = spread_join(posted, counts, ["key"], counts, by="node").groupBy("node").agg(lists).where(F.size("lists") >= matches)
    prefix = F.slice("lists", F.lit(1), F.size("lists") - (max(matches, 1) - 1))
    fame = F.aggregate("lists", F.lit(0).cast("long"), lambda s, x: s + x["size"])
    # equally famous nodes are set apart by their number's low bits
    fame = F.shiftleft(fame, 20) + F.col("node").bitwiseAND(F.lit((1 << 20) - 1))
    return ordered.select("node", fame.alias("fame"), prefix["key"].alias("prefix")).join(nodes, "node")


def sets_for(live: DataFrame, docs: DataFrame) -> DataFrame:
    """node, n, coords, items, fine of the nodes in ``live``, from one document of each."""
    ids = written(live.select("doc_id"), "wanted")
    texts = docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi")
    return live.select("node", "n", "d1", "d2", "coords").join(sets_of(texts).dropDuplicates(["d1", "d2"]), ["d1", "d2"]).drop("d1", "d2")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT, matches: int = MATCHES) -> DataFrame:
    """Those of ``pairs`` (a, b: nodes) that share enough coordinates and whose full sets
    are linked. Either may stand in very many pairs, so both sides are spread."""
    pairs = written(pairs, "pairs")
    x = sets.select(F.col("node").alias("a"), F.col("n").alias("xn"), F.col("coords").alias("xc"), F.col("items").alias("x"))
    y = sets.select(F.col("node").alias("b"), F.col("n").alias("yn"), F.col("coords").alias("yc"), F.col("items").alias("y"))
    often = lambda side: pairs.groupBy(side).agg(F.count(F.lit(1)).alias("size"))
    both = spread_join(spread_join(pairs, y, ["b"], often("b"), by="a"), x, ["a"], often("a"), by="b")
    both = both.where(close_in_size(F.col("xn"), F.col("yn"), percent) & (F.size(F.array_intersect("xc", "yc")) >= matches))
    both = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("same"), (F.col("xn") + F.col("yn")).alias("total"))
    return both.where(100 * F.col("same") >= percent * (F.col("total") - F.col("same"))).select("a", "b")


def led(live: DataFrame) -> DataFrame:
    """(a, b): the nodes of each posted list with the list's two leaders, b."""
    posted = live.select("node", "fame", F.explode("prefix").alias("key"))
    salted = F.min(F.col("node").bitwiseXOR(F.lit(SALT))).bitwiseXOR(F.lit(SALT))
    lists = posted.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.max_by("node", "fame").alias("first"), salted.alias("second")).where("size > 1")
    lists = written(lists, "leads")
    pairs = spread_join(posted.select("node", "key"), lists, ["key"], lists, by="node")
    pairs = pairs.select(F.col("node").alias("a"), F.explode(F.array("first", "second")).alias("b")).where("a <> b")
    return pairs.distinct()


def crossing(nodes: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Those of ``nodes`` (node, comp) that can be linked with a node of another component.
    A link with a set of m shingles takes (n + m) * percent / (100 + percent) common ones; they
    are counted for each class of sizes m. Exact."""
    size_class = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(SIZES))).cast("int")
    items = nodes.join(sets.select("node", "n", "items"), "node").select("node", "comp", size_class.alias("class"), F.explode("items").alias("item"))
    shared = items.groupBy("item", "class").agg(F.count(F.lit(1)).alias("size"), F.min("comp").alias("c0"), F.max("comp").alias("c1"))
    shared = written(shared, "shingles")
    facts = shared.select("item", F.col("class").alias("other"), "c0", "c1")
    met = spread_join(items.select("node", "comp", "item"), facts, ["item"], shared.groupBy("item").agg(F.sum("size").alias("size")), by="node")
    least = F.pow(F.lit(SIZES), F.col("other")) * (1 - 1e-9)
    met = met.where((F.col("c0") != F.col("comp")) | (F.col("c1") != F.col("comp")))
    same = met.groupBy("node", "other").agg(F.count(F.lit(1)).alias("same")).join(sets.select("node", "n"), "node")
    same = same.where(100 * least * SIZES * (1 + 1e-8) >= percent * F.col("n"))
    return same.where((100 + percent) * F.col("same") >= percent * (F.col("n") + F.greatest(least, F.lit(1.0)))).select("node").distinct()


def merged(live: DataFrame, sets: DataFrame, stars: DataFrame, percent: int = PERCENT, fine_matches: int = FINE_MATCHES) -> DataFrame:
    """(a, b), a < b: pairs from different components in lists that are not skipped."""
    at = live.select("node", "n", "prefix").join(stars, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")
    at = written(at, "components")

    def mixed(nodes: DataFrame, *keep: str) -> DataFrame:
        posted = nodes.select("node", "comp", *keep, F.explode("prefix").alias("key"))
        lists = posted.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("key", "size")
        lists = written(lists, "mixed-lists")
        return written(spread_join(posted, lists, ["key"], lists, by="node"), "mixed")

    able = crossing(mixed(at).select("node", "comp").distinct(), sets, percent)
    rest = mixed(at.join(able, "node", "left_semi"), "n", "prefix").join(sets.select("node", *[F.col("fine")[i].alias(f) for i, f in enumerate(FINE_WORDS)]), "node")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    x = rest.withColumn("part", F.pmod(F.xxhash64("node"), blocks).cast("int")).alias("x")
    y = rest.withColumn("part", F.explode(F.sequence(F.lit(0), blocks - 1))).alias("y")
    apart = (F.col("x.key") == F.col("y.key")) & (F.col("x.part") == F.col("y.part")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.comp") != F.col("y.comp"))
    first = F.array_intersect("x.prefix", "y.prefix")[0] == F.col("x.key")  # prefixes are in one order
    found = x.join(y, apart & close_in_size(F.col("x.n"), F.col("y.n"), percent) & finely_alike("x", "y", fine_matches) & first)
    return found.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))


def linked(nodes: DataFrame, docs: DataFrame, percent: int = PERCENT, matches: int = MATCHES, fine_matches: int = FINE_MATCHES) -> DataFrame:
    """(node, root) of all nodes that are linked with a smaller one."""
    live = written(viable(nodes, matches), "live")
    sets = written(sets_for(live, docs), "sets")
    edges = written(confirmed(led(live), sets, percent, matches), "links")
    stars = star(edges)
    more = written(confirmed(merged(live, sets, stars, percent, fine_matches), sets, percent, matches), "links")
    return star(more.unionByName(stars.select(F.col("node").alias("a"), F.col("root").alias("b")))) if more.limit(1).count() else stars


def near_groups(docs: DataFrame, percent: int = PERCENT, matches: int = MATCHES, fine_matches: int = FINE_MATCHES) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``. With ``matches`` and
    ``fine_matches`` 0 every pair that shares a coordinate is confirmed on its sets: a pair at exactly 75 %
    is lost with a probability of 1 in 10**38 instead of 1 in 10**6, at the cost of more candidates."""
    spark = docs.sparkSession
    outer = scope(spark)
    with scratch(spark):
        found, labels = labelled(docs, outer, percent, matches, fine_matches)
    known = found.where("doc_id is not null and d1 is not null")
    rows = spread_join(known.select("doc_id", "n", "d1", "d2"), labels.drop("size"), ["d1", "d2"], labels, by="doc_id", how="left")
    rows = rows.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    alone = found.where("doc_id is null or d1 is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return rows.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def labelled(docs: DataFrame, outer: str, percent: int, matches: int, fine_matches: int) -> tuple[DataFrame, DataFrame]:
    """The signatures of ``docs``, and (d1, d2, size, component_id) of the sets that have
    copies or links; both are written ``outer``, as the result reads them."""
    found = written(signatures(docs), "signatures", into=outer)
    known = found.where("doc_id is not null and d1 is not null")
    one = [F.first(c).alias(c) for c in ("n", "coords")]
    nodes = known.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("size"), F.min("doc_id").alias("doc_id"), *one)
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    roots = linked(nodes, docs.select(F.col("doc_id").cast("long"), "text"), percent, matches, fine_matches)
    members = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    least = members.join(nodes.select("node", "doc_id"), "node").groupBy("root").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("size"))
    least = written(least, "least")
    labels = spread_join(members, least.select("root", "least"), ["root"], least, by="node").select("node", "least")
    labels = nodes.select("d1", "d2", "node", "size", "doc_id").join(labels, "node", "left").where("size > 1 or least is not null")
    labels = written(labels.select("d1", "d2", "size", F.coalesce("least", "doc_id").alias("component_id")), "labels", into=outer)
    return found, labels


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(read(spark, sf_dir, "documents"))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with the first document (smallest id, null last) of each group of near
    duplicates. Groups are made of row numbers, so ids may be null or repeated."""
    rows, row = numbered(docs)
    groups = near_groups(rows.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias(row), "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), F.col(row).alias("row"))
    first = rows.select(row, "doc_id").join(groups, row).groupBy("component_id").agg(F.min(order).alias("first"))
    return rows.join(first.select(F.col("first.row").alias(row)), row, "left_semi").select(docs.columns)


ORACLE = r"""
with recursive words as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w
  from documents),
sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as s
  from words),
items as (select doc_id, len(s) as n, unnest(s) as item from sets),
common as (
  select a.doc_id as a, b.doc_id as b, any_value(a.n) as n, any_value(b.n) as m, count(*) as c
  from items a join items b on a.item = b.item and a.doc_id < b.doc_id group by 1, 2),
edges as (
  select a, b from common where 100 * c >= 75 * (n + m - c)
  union select b, a from common where 100 * c >= 75 * (n + m - c)),
reach(a, b) as (select a, b from edges union select r.a, e.b from reach r join edges e on r.b = e.a),
least as (select a, min(b) as b from reach group by a)
select doc_id, len(s) as n_shingles, least(doc_id, coalesce(b, doc_id)) as component_id,
       doc_id = least(doc_id, coalesce(b, doc_id)) as kept
from sets left join least on doc_id = a
"""
