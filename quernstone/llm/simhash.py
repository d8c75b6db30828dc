"""Near duplicates by SimHash: a byte-position inverted index with count filtering.

Fingerprint. A text is lower-cased (A-Z), cut into words at ASCII white space and into
shingles of three words, repeats included (the whole sequence, if there are fewer). A bit of
the 64-bit fingerprint is 1 if more than half of the shingles' XXH64 values have it.
Documents with one fingerprint are one *node*; later steps work on nodes.

Guarantee. Two fingerprints that differ in at most ``BITS`` = 3 bits differ in at most three
bytes, so they share at least ``SHARED`` = 5 of their 8 positional bytes.

Index. A list for one byte at one position would hold 1/256 of all nodes, so lists are
intersected before they are merged: nodes are posted under the bytes at *sets* of
positions, chosen so that any five shared positions contain one of the sets.

* Level 1: the four pairs (0,1) (2,3) (4,5) (6,7); of five positions two lie in one pair.
* Level 2, for lists longer than ``LIST``: of the other six positions at least three are
  shared, so two in one of two triples: six pairs more, four bytes together.
* Level 3, for lists still longer: one of the last four positions more, five bytes.
* Level 4: a quarter of the other 24 bits more, one of which must be equal; such a list
  has at most 2**18 nodes by construction.

The lengths are counted before each level, so only long lists are refined; whatever is left
above ``LIST`` is dealt to pairs of blocks.

Merge. In a list the shared positional bytes of each pair are tallied, pairs with
``SHARED`` or more are retained, and those verified on all 64 bits. A pair of which both
are linked already inside the list emits nothing, so a list emits a forest, not its pairs.
Components come from alternating stars.

Edge cases: null, empty and white texts have the fingerprint zero and are linked like any
other; a row with a null id is linked by its fingerprint, but its id is nobody's
component_id (null if the component has no id at all); repeated rows share a node; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm.common import read, scope, scratch, spread_join, written
from quernstone.llm.components import star

WORDS, SEED = 3, 42
BYTES, BITS = 8, 3
#: Positional bytes that a linked pair shares at least.
SHARED = BYTES - BITS
#: Nodes of a list that are compared in one place.
LIST = 2048
#: Shingles hashed before their bits are added up.
STEP = 1 << 15
LINKS = "a long, b long"


def fingerprint(text: str | None) -> int:
    """The fingerprint as an unsigned number."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = min(WORDS, len(words))
    m = len(words) - n + 1
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, m, STEP):
        upto = min(m, at + STEP)
        spans = zip(begins[at:upto].tolist(), ends[at + n - 1 : upto + n - 1].tolist(), strict=True)
        h = np.fromiter((xxh64_intdigest(joined[b:e], SEED) for b, e in spans), dtype="<u8", count=upto - at)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > m).astype(np.uint8), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (64 bits as a long) of every row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            texts = batch.column(1)
            found = np.fromiter((fingerprint(texts[i].as_py()) for i in range(batch.num_rows)), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def position_sets(held: tuple[int, ...] = ()) -> list[tuple[int, ...]]:
    """The sets of positions of the next level, each with those already held: whatever
    positions a pair shares (``SHARED`` at least, the held among them), one set is shared."""
    free = [p for p in range(BYTES) if p not in held]
    need = SHARED - len(held)  # shared positions among the free ones
    if need == 1:
        return [(*held, p) for p in free]
    step = len(free) // (need - 1)  # fewer boxes than shared positions: two are in one box
    return [(*held, *pair) for i in range(0, len(free), step) for pair in combinations(free[i : i + step], 2)]


def masks(sets: list[tuple[int, ...]]) -> list[int]:
    """Each set of positions as a mask of 64 bits (signed)."""
    return [signed(sum(0xFF << 8 * p for p in s)) for s in sets]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def quarters(held: tuple[int, ...]) -> list[int]:
    """Masks of the held bytes and a quarter of the other bits."""
    bits = [8 * p + b for p in range(BYTES) if p not in held for b in range(8)]
    step = -(-len(bits) // (BITS + 1))
    base = sum(0xFF << 8 * p for p in held)
    return [signed(base | sum(1 << b for b in bits[i : i + step])) for i in range(0, len(bits), step)]


def posted(nodes: DataFrame, found: list[int], column: str | None = None) -> DataFrame:
    """fp, mask, key (the masked bits) under each of the masks."""
    grid = F.array(*[F.lit(m).cast("long") for m in found]) if column is None else F.col(column)
    return nodes.withColumn("mask", F.explode(grid)).withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))


def sized(rows: DataFrame, lists: DataFrame) -> DataFrame:
    """``rows`` with the ``size`` of their lists; lists of one node drop out."""
    return spread_join(rows, lists, ["mask", "key"], lists, by="fp")


def lengths(rows: DataFrame) -> DataFrame:
    return written(rows.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "lists")


def index(nodes: DataFrame, most: int = LIST) -> DataFrame:
    """fp, mask, key, size: nodes in the lists that are to be merged."""
    levels = [position_sets()]
    levels += [[s for h in levels[0] for s in position_sets(h)]]
    levels += [[s for h in levels[1] for s in position_sets(h)]]
    finer: dict[int, list[int]] = {}  # the masks that refine each mask
    for level in range(2):
        for held in levels[level]:
            finer[masks([held])[0]] = masks(position_sets(held))
    for held in levels[2]:
        finer[masks([held])[0]] = quarters(held)
    rows, out = posted(nodes, masks(levels[0])), None
    for level in range(4):
        lists = lengths(rows)
        met = sized(rows, lists)
        short = met if level == 3 else met.where(F.col("size") <= most)
        out = short if out is None else out.unionByName(short)
        if level == 3 or not lists.where(F.col("size") > most).limit(1).count():
            return out
        table = F.create_map(*[x for m, fine in finer.items() for x in (F.lit(m).cast("long"), F.array(*[F.lit(f).cast("long") for f in fine]))])
        long_ = met.where(F.col("size") > most).select("fp", table[F.col("mask")].alias("fine"))
        rows = written(posted(long_, [], "fine").select("fp", "mask", "key").distinct(), "posted")
    raise AssertionError


def dealt(rows: DataFrame, most: int = LIST) -> DataFrame:
    """Lists longer than ``most`` in pairs of blocks: each node goes to every pair that its
    block is in. ``part`` is the node's block, ``cell`` the pair."""
    blocks = F.ceil(F.col("size") / most).cast("int")
    part = F.when(F.col("size") > most, F.pmod(F.xxhash64("fp"), blocks)).otherwise(0).cast("int")
    rows = rows.withColumns({"blocks": F.when(F.col("size") > most, blocks).otherwise(1), "part": part})
    other = F.sequence(F.lit(0), F.col("blocks") - 1)
    cell = F.transform(other, lambda o: F.least(o, F.col("part")) * F.col("blocks") + F.greatest(o, F.col("part")))
    return rows.select("fp", "mask", "key", F.explode(cell).alias("cell"))


def links_of(fps, runs) -> tuple:
    """Links among nodes sorted by list: ``runs`` numbers the lists. Pairs are compared at
    every distance inside their lists; returns a forest (places a and b)."""
    import numpy as np

    n = len(fps)
    label = np.arange(n)
    a_out, b_out = [], []
    active = np.arange(n - 1) if n > 1 else np.zeros(0, dtype=np.int64)
    ones = np.uint64(0x7F7F7F7F7F7F7F7F)
    distance = 1
    while True:
        active = active[active + distance < n]
        active = active[runs[active] == runs[active + distance]]
        if not len(active):
            break
        x = fps[active] ^ fps[active + distance]
        differing = np.bitwise_count(((x & ones) + ones | x) & ~ones)  # bytes that are not equal
        retained = np.flatnonzero(BYTES - differing >= SHARED)  # the tally of shared bytes
        hit = active[retained[np.bitwise_count(x[retained]) <= BITS]]  # verified
        hit = hit[label[hit] != label[hit + distance]]
        if len(hit):
            parent = {}

            def top(i: int, parent: dict = parent) -> int:
                while (up := parent.get(i, i)) != i:
                    parent[i] = i = parent.get(up, up)
                return i

            for i, u, v in zip(hit.tolist(), label[hit].tolist(), label[hit + distance].tolist(), strict=True):
                u, v = top(u), top(v)
                if u != v:
                    parent[max(u, v)] = min(u, v)
                    a_out.append(i)
                    b_out.append(i + distance)
            old = np.array(sorted(parent))
            new = np.array([top(i) for i in old.tolist()])
            at = np.minimum(np.searchsorted(old, label), len(old) - 1)
            label = np.where(old[at] == label, new[at], label)
        distance += 1
    return np.array(a_out, dtype=np.int64), np.array(b_out, dtype=np.int64)


def merged(rows: DataFrame) -> DataFrame:
    """(a, b): a forest of links for each list (mask, key, cell)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        kept = [np.zeros(0, dtype=np.int64)] * 4

        def solve(columns: list) -> pa.RecordBatch:
            mask, key, cell, fp = columns
            new = (mask[1:] != mask[:-1]) | (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])
            runs = np.concatenate(([0], np.cumsum(new)))[: len(fp)]
            a, b = links_of(fp.view(np.uint64), runs)
            return pa.RecordBatch.from_arrays([pa.array(fp[a]), pa.array(fp[b])], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            now = [np.concatenate((k, batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64))) for i, k in enumerate(kept)]
            # the last list may go on in the next batch
            last = np.flatnonzero((now[0] != now[0][-1]) | (now[1] != now[1][-1]) | (now[2] != now[2][-1]))
            begin = int(last[-1]) + 1 if len(last) else 0
            if begin:
                yield solve([c[:begin] for c in now])
            kept = [c[begin:] for c in now]
        if len(kept[0]):
            yield solve(kept)

    lists = rows.select("mask", "key", F.col("cell").cast("long").alias("cell"), "fp")
    return lists.repartition("mask", "key", "cell").sortWithinPartitions("mask", "key", "cell").mapInArrow(run, LINKS)


def simhash_groups(docs: DataFrame, most: int = LIST) -> DataFrame:
    """doc_id, fp, component_id for every row of ``docs``."""
    spark = docs.sparkSession
    outer = scope(spark)
    with scratch(spark):
        found = written(fingerprints(docs), "fingerprints", into=outer)
        nodes = written(found.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("size")), "nodes")
        links = written(merged(dealt(index(nodes.select("fp"), most), most)), "links")
        roots = star(links)
        members = roots.select(F.col("node").alias("fp"), "root").unionByName(roots.select(F.col("root").alias("fp"), "root").distinct())
        low = members.join(nodes, "fp").groupBy("root").agg(F.min("least").alias("low"), F.count(F.lit(1)).alias("size"))
        low = written(low, "low")
        named = spread_join(members, low.select("root", "low"), ["root"], low, by="fp").select("fp", "low")
        labels = nodes.join(named, "fp", "left").select("fp", "size", F.coalesce("low", "least").alias("component_id"))
        labels = written(labels, "labels", into=outer)
    return spread_join(found, labels.drop("size"), ["fp"], labels, by="doc_id").select("doc_id", "fp", "component_id")


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op11_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash_groups(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", hex_of(F.col("fp")).alias("fingerprint"), "component_id")


#: XXH64's primes (fixed values).
PRIMES = (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)


def oracle() -> str:
    """The query in SQL: XXH64 step by step, in 128-bit numbers modulo 2**64."""
    p1, p2, p3, p4, p5 = (f"{p}::uhugeint" for p in PRIMES)
    top = "18446744073709551616::uhugeint"
    mul = lambda a, b: f"(({a}) * {b} % {top})"
    add = lambda *x: f"(({' + '.join(x)}) % {top})"
    rot = lambda x, r: f"((({x}) << {r}) % {top} | (({x}) >> {64 - r}))"
    number = lambda at, n: "('0x' || " + " || ".join(f"substr(x, 2 * ({at}) + {2 * k + 1}, 2)" for k in reversed(range(n))) + ")::ubigint::uhugeint"
    turn = lambda acc, lane: mul(rot(add(acc, mul(lane, p2)), 31), p1)
    lanes = [f"list_reduce(list_transform(range(0, n // 32), lambda i: {number(f'32 * i + {8 * j}', 8)}), lambda c, b: {turn('c', 'b')}, {start % 2**64}::uhugeint)" for j, start in enumerate((SEED + PRIMES[0] + PRIMES[1], SEED + PRIMES[1], SEED, SEED - PRIMES[0]))]
    steps = [("h0", add(rot("v1", 1), rot("v2", 7), rot("v3", 12), rot("v4", 18)))]
    for j in range(1, 5):
        steps.append((f"h{j}", add(mul(f"xor(h{j - 1}, {turn('0::uhugeint', f'v{j}')})", p1), p4)))
    steps.append(("a", f"(case when n >= 32 then h4 else {(SEED + PRIMES[4]) % 2**64}::uhugeint end + n::uhugeint) % {top}"))
    steps.append(("b", f"list_reduce(list_transform(range(0, n % 32 // 8), lambda i: {number('32 * (n // 32) + 8 * i', 8)}), lambda c, b: {add(mul(rot('xor(c, ' + turn('0::uhugeint', 'b') + ')', 27), p1), p4)}, a)"))
    steps.append(("c", f"case when n % 8 >= 4 then {add(mul(rot('xor(b, ' + mul(number('8 * (n // 8)', 4), p1) + ')', 23), p2), p3)} else b end"))
    steps.append(("d", f"list_reduce(list_transform(range(4 * (n // 4), n), lambda i: {number('i', 1)}), lambda c, b: {mul(rot('xor(c, ' + mul('b', p5) + ')', 11), p1)}, c)"))
    steps.append(("e", mul("xor(d, d >> 33)", p2)))
    steps.append(("f", mul("xor(e, e >> 29)", p3)))
    steps.append(("h", "xor(f, f >> 32)"))
    ctes, last = [], "s0"
    for i, (name, sql) in enumerate(steps):
        ctes.append(f"s{i + 1} as (select *, {sql} as {name} from {last})")
        last = f"s{i + 1}"
    bits = " + ".join(f"case when 2 * sum(times * ((h >> {b}) & 1::uhugeint)::bigint) > sum(times) then {1 << b}::uhugeint else 0::uhugeint end" for b in range(64))
    return f"""
with recursive w as (select row_number() over () as row, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
r as (select row, unnest(case when len(w) < 3 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) end) as t from w where len(w) > 0),
g as (select row, t, count(*) as times from r group by all),
s0 as (select t, x, n, {', '.join(f'{sql} as v{j + 1}' for j, sql in enumerate(lanes))} from (select t, hex(encode(t)) as x, octet_length(encode(t)) as n from (select distinct t from g))),
{', '.join(ctes)},
q as (select row, {bits} as fp from g join {last} using (t) group by row),
p as (select doc_id, coalesce(fp, 0::uhugeint) as fp from w left join q using (row)),
n as (select fp, min(doc_id) as least from p group by fp),
l as (select a.fp as a, b.fp as b from n a join n b on a.fp <> b.fp and bit_count(xor(a.fp, b.fp)::hugeint) <= 3),
reach(a, b) as (select a, b from l union select r.a, l.b from reach r join l on r.b = l.a),
m as (select n.fp, least(any_value(n.least), min(o.least)) as low from n left join reach on reach.a = n.fp left join n o on o.fp = reach.b group by n.fp)
select doc_id, lower(lpad(to_hex(fp::ubigint), 16, '0')) as fingerprint, low as component_id from p join m using (fp)"""
