import hashlib
import os
import re
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from quernstone import tables
from quernstone.llm import components, exact_dedup, minhash, simhash, token_store
from quernstone.llm.common import drop_rows, numbered
from quernstone.llm.pieces import tokenizer_path
from quernstone.operators import joins

ROWS = "doc_id long, text string"


def brute_exact(rows):
    norm = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    return {i: (min(groups[norm(t)]), len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows}


@pytest.mark.parametrize("heavy", [1, 256])
def test_exact_groups(spark, heavy, monkeypatch):
    monkeypatch.setattr(joins, "HOT_ROWS", 3)
    rows = [(i, t) for i, t in enumerate(["a b", "a  b", None, "", "c", " ", "a\tb", "d"] * 5 + ["hot"] * 40)]
    found = exact_dedup.exact_groups(exact_dedup.digests(spark.createDataFrame(rows, ROWS)), heavy=heavy)
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], bytes(r["sha"]).hex()) for r in found.collect()}
    assert got == brute_exact(rows)
    assert {r["doc_id"] for r in found.where("kept").collect()} == {v[0] for v in got.values()}


def test_exact_edges(spark, docs, empty):
    found = exact_dedup.exact_groups(exact_dedup.digests(docs)).collect()
    assert len(found) == 10
    assert {r["doc_id"]: r["keep_id"] for r in found if r["doc_id"] in (1, 2, 4, 5, 6)} == {1: 1, 2: 1, 4: 4, 5: 4, 6: 4}
    assert exact_dedup.exact_groups(exact_dedup.digests(empty)).count() == 0
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns and kept.count() == 7
    twice = docs.where("doc_id = 4").unionByName(docs.where("doc_id = 4"))
    assert exact_dedup.exact_groups(exact_dedup.digests(twice)).where("kept").count() == 1
    assert exact_dedup.drop_copies(twice).count() == 1


def shingle_set(text):
    w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_near(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {i: (len(sets[i]), top(i), top(i) == i) for i in ids}


def test_near_groups_equal_brute_force(spark, prose):
    found = minhash.near_groups(spark.createDataFrame(prose, ROWS)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in found} == brute_near(prose)


def test_without_match_thresholds(spark, prose):
    """The exact way: shared coordinates only propose pairs, none is turned away by their number."""
    found = minhash.near_groups(spark.createDataFrame(prose, ROWS), matches=0, fine_matches=0).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in found} == brute_near(prose)


def test_large_group_of_near_copies_and_exact_copies(spark):
    base = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join(base[:i] + [f"x{i}"] + base[i + 1 :])) for i in range(60)] + [(100 + i, " ".join(base).upper()) for i in range(50)]
    found = minhash.near_groups(spark.createDataFrame(rows, ROWS)).collect()
    assert {r["component_id"] for r in found} == {0} and sum(r["kept"] for r in found) == 1


def test_near_edges(spark, docs, empty):
    found = {r["doc_id"]: r for r in minhash.near_groups(docs).collect()}
    assert len(found) == 10
    assert all(found[i]["n_shingles"] == 0 and found[i]["component_id"] == i for i in (1, 2, 3))
    assert [found[i]["component_id"] for i in (4, 5, 6)] == [4, 4, 4]
    assert found[None]["kept"] and found[None]["component_id"] is None
    assert minhash.near_groups(empty).count() == 0
    assert minhash.drop_near_copies(docs).columns == docs.columns


def test_signature_counts_similarity():
    a, b = minhash.shingles(" ".join(f"w{i}" for i in range(400))), minhash.shingles(" ".join(f"w{i}" for i in range(40, 400)))
    ca, cb = minhash.signature(a), minhash.signature(b)
    same = len(set(ca.tolist()) & set(cb.tolist()))
    assert len(ca) == minhash.COORDINATES and same == int((ca == cb).sum()) >= minhash.MATCHES
    fine = minhash.fine_signature(a), minhash.fine_signature(b)
    places = sum(bin((int(x) ^ int(y)) & (2**64 - 1)).count("1") for x, y in zip(*fine, strict=True))
    assert minhash.FINE - places >= minhash.FINE_MATCHES


def test_spread_keys_and_blocks_change_nothing(spark, prose, monkeypatch):
    """Every key of more than two rows is spread, and lists are merged in blocks of two."""
    monkeypatch.setattr(joins, "HOT_ROWS", 2)
    monkeypatch.setattr(joins, "HOT_KEYS", 10**6)
    monkeypatch.setattr(minhash, "BLOCK", 2)
    monkeypatch.setattr(minhash, "BROADCAST_IDS", 0)
    monkeypatch.setattr(components, "FEW", 0)
    rows = prose[:100] + [(1000 + i, prose[0][1]) for i in range(20)]
    found = minhash.near_groups(spark.createDataFrame(rows, ROWS)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in found} == brute_near(rows)


def test_passage_in_different_texts(spark):
    """Texts that share half of their words are compared and stay apart; a chain of near
    copies is one group although its ends are not alike."""
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, passage + " " + " ".join(f"own{i}x{k}" for k in range(45))) for i in range(40)]
    rows += [(100 + i, " ".join(f"c{k}" for k in range(8 * i, 8 * i + 100))) for i in range(12)]
    found = minhash.near_groups(spark.createDataFrame(rows, ROWS)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in found} == brute_near(rows)
    assert {r["component_id"] for r in found if r["doc_id"] >= 100} == {100}


def test_very_long_text(spark):
    words = [f"v{i * i % 9973}" for i in range(400_000)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:399_000], "end"])), (3, "short text of six words here")]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_groups(spark.createDataFrame(rows, ROWS)).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


@pytest.mark.parametrize("few", [0, 10**6])
def test_components(spark, monkeypatch, few):
    monkeypatch.setattr(components, "FEW", few)
    monkeypatch.setattr(joins, "HOT_ROWS", 10)
    hub = [(50, i) for i in range(100, 160)] + [(i, 50) for i in range(10, 40)]
    chain = [(i, i + 1) for i in range(1000, 1030)]
    edges = spark.createDataFrame([*hub, *chain, (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in components.star(edges).collect()}
    want = {n: 10 for e in hub for n in e if n != 10} | {i: 1000 for i in range(1001, 1031)}
    assert got == want
    assert components.star(edges.where("a < 0")).count() == 0


def test_components_take_few_jobs(spark):
    """Edges that are stars already are seen to be so, without a round that changes nothing."""
    edges = spark.createDataFrame([(i, i % 3) for i in range(3, 40)], "a long, b long")
    spark.sparkContext.setJobGroup("stars", "stars")
    try:
        got = components.star(edges).collect()
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    assert {tuple(r) for r in got} == {(i, i % 3) for i in range(3, 40)}
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("stars")) <= 9


def test_drop_rows_keeps_null_ids(spark, docs):
    gone = spark.createDataFrame([(4,), (None,)], "doc_id long")
    assert sorted(str(r[0]) for r in drop_rows(docs, gone).select("doc_id").collect()) == sorted(map(str, [1, 2, 3, 5, 6, 7, 8, 9, None]))
    assert F is not None


def long_text(seed):
    return " ".join(f"{seed}w{i}" for i in range(80))


@pytest.mark.parametrize("drop", [exact_dedup.drop_copies, minhash.drop_near_copies])
def test_rows_are_dropped_not_ids(spark, drop):
    alone = [(None, long_text(f"n{i}")) for i in range(6)]
    rows = [*alone, (7, long_text("own")), (7, long_text("copy")), (3, long_text("copy")), (None, long_text("copy")), (9, long_text("twice")), (9, long_text("twice"))]
    kept = [tuple(r) for r in drop(spark.createDataFrame(rows, ROWS)).collect()]
    assert sorted(map(str, kept)) == sorted(map(str, [*alone, (7, long_text("own")), (3, long_text("copy")), (9, long_text("twice"))]))


@pytest.mark.parametrize("drop", [exact_dedup.drop_copies, minhash.drop_near_copies])
def test_rows_of_files_are_dropped(spark, drop, tmp_path):
    """Rows of Parquet files are numbered by file and place, nothing is copied."""
    rows = [(i % 7 if i % 5 else None, long_text(f"t{i // 2}")) for i in range(40)]
    spark.createDataFrame(rows, ROWS).withColumn("row_number", F.lit("clash")).repartition(5).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    with tables.scratch(spark) as folder:
        kept = drop(docs).cache()
        kept.count()
        made = os.listdir(folder.removeprefix("file://"))
    assert kept.columns == docs.columns and sorted(r["text"] for r in kept.collect()) == sorted({t for _, t in rows})
    assert not any(name.startswith("numbered-") for name in made)
    assert not os.path.exists(folder.removeprefix("file://"))


def test_near_copies_without_ids_are_dropped(spark):
    rows = [(None, long_text("a")), (None, long_text("a") + " more"), (2, long_text("b") + " more"), (None, long_text("b")), (1, None), (None, None)]
    kept = [tuple(r) for r in minhash.drop_near_copies(spark.createDataFrame(rows, ROWS)).collect()]
    assert len(kept) == 4 and (2, rows[2][1]) in kept and kept.count((None, None)) == 1 and (1, None) in kept


def derived(spark, folder):
    """Tables whose rows share a place in a file, or have none."""
    rows = [(3, long_text("c")), (1, long_text("a")), (2, long_text("a") + " x")]
    spark.createDataFrame(rows, ROWS).coalesce(1).write.parquet(f"{folder}/rows")
    docs = spark.read.parquet(f"{folder}/rows")
    more = F.array("text", F.concat(F.lit("p "), F.col("doc_id").cast("string"), F.lit(" of its own kind")))
    other = docs.select(F.col("doc_id").alias("k"), F.lit(1).alias("one"))
    return {
        "exploded": docs.select("doc_id", F.explode(more).alias("text")),
        "joined": docs.join(other.unionByName(other), docs["doc_id"] == other["k"]).select("doc_id", "text"),
        "union": docs.unionByName(docs),
        "memory": spark.createDataFrame(rows + rows[:1], ROWS),
    }


def brute_kept(rows, near):
    left, out = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)), []
    norm = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t or "")
    for i, t in left:
        same = (lambda a, b: bool(a & b) and 100 * len(a & b) >= 75 * len(a | b)) if near else (lambda a, b: a == b)
        of = shingle_set if near else norm
        if not any(same(of(t), of(u)) for _, u in out):
            out.append((i, t))
    return sorted(out)


@pytest.mark.parametrize("kind", ["exploded", "joined", "union", "memory"])
def test_rows_without_a_place_of_their_own(spark, tmp_path, kind):
    df = derived(spark, str(tmp_path))[kind]
    rows = [tuple(r) for r in df.collect()]
    marked, row = numbered(df)
    assert marked.select(row).distinct().count() == len(rows)
    assert sorted(tuple(r) for r in exact_dedup.drop_copies(df).collect()) == brute_kept(rows, False)
    assert sorted(tuple(r) for r in minhash.drop_near_copies(df).collect()) == brute_kept(rows, True)


def test_calls_side_by_side(spark, prose):
    """Calls in threads of one session have tables of their own."""
    docs = spark.createDataFrame(prose, ROWS).repartition(3)
    near = lambda: {r["doc_id"]: r["component_id"] for r in minhash.near_groups(docs).collect()}
    sims = lambda: {r["doc_id"]: r["component_id"] for r in simhash.simhash_groups(docs).collect()}

    def store():
        path = token_store.store(docs, tokenizer_path("byte_bpe_50k.json"))
        return {r["doc_id"]: r["n_tokens"] for r in token_store.read_back(spark, path).collect() if r["verified"]}

    jobs = [near, store, near, sims, near]
    with ThreadPoolExecutor(len(jobs)) as pool:
        got = [f.result() for f in [pool.submit(j) for j in jobs]]
    assert got[0] == got[2] == got[4] == near() and got[3] == sims()
    assert len(got[1]) == len(prose)


def test_scratch_is_deleted(spark, prose):
    docs = spark.createDataFrame(prose, ROWS)
    with tables.scratch(spark) as folder:
        assert minhash.near_groups(docs).count() == len(prose)
        left = os.listdir(folder.removeprefix("file://"))
        assert sorted(n.split("-")[0] for n in left) == ["labels", "signatures"]  # what the result reads
    assert not os.path.exists(folder.removeprefix("file://"))
