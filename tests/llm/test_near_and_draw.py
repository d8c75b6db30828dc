"""SimHash groups, fill-in-the-middle and importance resampling against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernstone.llm import fim, resample, simhash

TEXTS = "doc_id long, text string"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# --- SimHash ------------------------------------------------------------------------------


def brute_fingerprint(text):
    import xxhash

    w = [x for x in re.split("[\x20\x09-\x0d]+", lower(text)) if x]
    runs = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    """The smallest place that each place reaches over at most three differing bits."""
    fps, label = np.array(fps, dtype=np.uint64), np.arange(len(fps))
    near = [np.flatnonzero(np.bitwise_count(fps ^ f) <= 3) for f in fps]
    changed = True
    while changed:
        changed = False
        for n in near:
            low = label[n].min()
            if (label[n] != low).any():
                label[n], changed = low, True
    return label.tolist()


def test_any_five_shared_bytes_share_a_list():
    from itertools import combinations

    for shared in combinations(range(8), 5):
        held = [s for s in simhash.position_sets() if set(s) <= set(shared)]
        assert held
        for s in held:
            finer = [t for t in simhash.position_sets(s) if set(t) <= set(shared)]
            assert finer and all(set(s) <= set(t) for t in finer)
            for t in finer:
                assert any(set(u) <= set(shared) for u in simhash.position_sets(t))
    assert [len(s) for s in (simhash.position_sets(), simhash.position_sets((0, 1)), simhash.position_sets((0, 1, 2, 5)))] == [4, 6, 4]


def test_quarters_keep_three_bits_apart():
    held = (0, 2, 3, 5, 6)
    base = sum(0xFF << 8 * p for p in held)
    free = [b for b in range(64) if not base >> b & 1]
    found = [m & (1 << 64) - 1 for m in simhash.quarters(held)]
    assert len(found) == 4 and all(m & base == base for m in found)
    assert sorted(b for m in found for b in free if m >> b & 1) == free


def random_fingerprints(n, seed):
    draw, out = random.Random(seed), [0]
    while len(out) < n:
        base = draw.choice(out) if draw.random() < 0.7 else draw.getrandbits(64)
        for _ in range(draw.randint(0, 6)):
            base ^= 1 << draw.randrange(64)
        out.append(base)
    return out


@pytest.mark.parametrize("most", [2, 8, 2048])
def test_links_of_random_fingerprints(spark, most):
    fps = sorted(set(random_fingerprints(500, 3)) | {f << 40 for f in range(300)})  # the second: one key in five bytes
    rows = spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp long").repartition(3)
    links = simhash.merged(simhash.dealt(simhash.index(rows, most), most)).collect()
    at = {simhash.signed(f): i for i, f in enumerate(fps)}
    assert all(bin((r["a"] ^ r["b"]) & (1 << 64) - 1).count("1") <= 3 for r in links)
    label = list(range(len(fps)))
    for _ in fps:
        before = list(label)
        for r in links:
            label[at[r["a"]]] = label[at[r["b"]]] = min(label[at[r["a"]]], label[at[r["b"]]])
        if label == before:
            break
    assert label == brute_components(fps)


def test_a_list_gives_a_forest():
    fps = np.arange(0, 512, dtype=np.uint64)  # all linked by steps of one bit
    a, b = simhash.links_of(fps, np.zeros(512, dtype=np.int64))
    assert len(a) == 511
    assert len(simhash.links_of(fps[:0], np.zeros(0, dtype=np.int64))[0]) == 0


def check_groups(rows, found):
    fps = [brute_fingerprint(t) for _, t in rows]
    label = brute_components(fps)
    low = {}
    for (i, _), c in zip(rows, label, strict=True):
        low[c] = i if low.get(c) is None else low[c] if i is None else min(i, low[c])
    want = Counter((i, f"{f:016x}", low[c]) for (i, _), f, c in zip(rows, fps, label, strict=True))
    assert Counter((r["doc_id"], r["fp"], r["component_id"]) for r in found) == want


def groups(df):
    return simhash.simhash_groups(df).withColumn("fp", simhash.hex_of(F.col("fp"))).collect()


def test_groups_equal_brute_force(spark, prose):
    check_groups(prose, groups(spark.createDataFrame(prose, TEXTS).repartition(5)))


def test_group_edges(spark, docs, empty):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    check_groups(rows, groups(docs))
    check_groups(rows + rows, groups(docs.unionByName(docs)))
    assert groups(empty) == []
    lone = spark.createDataFrame([(None, "only a null id"), (None, "only a null id"), (5, "x " * 2_000_000)], TEXTS)
    check_groups([(r["doc_id"], r["text"]) for r in lone.collect()], groups(lone))


def test_fingerprint_in_steps(monkeypatch):
    draw = random.Random(2)
    text = " ".join(draw.choice(("Aa", "b", "ÀÉ", "d e", "f")) for _ in range(500))
    want = brute_fingerprint(text)
    assert simhash.fingerprint(text) == want
    monkeypatch.setattr(simhash, "STEP", 7)
    assert simhash.fingerprint(text) == want


# --- fill in the middle -------------------------------------------------------------------


def brute_form(doc_id, text):
    text, h = text or "", hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if h4 % 100 < 20:
        return doc_id, n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return doc_id, n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


def test_forms_equal_brute_force(spark, docs, empty):
    draw = random.Random(9)
    parts = ["a", "é", "😀", "<", ">", "P", "<P", "S>", "<M", "\n", "é", "<P>", "\0"]
    rows = [(i, "".join(draw.choice(parts[:11] if i % 3 else parts) for _ in range(draw.randint(0, 40)))) for i in range(400)]
    rows += [(r["doc_id"], r["text"]) for r in docs.collect()] + [(1000, "long 一 " * 600_000), (7, "x"), (7, "x")]
    found = fim.transformed(spark.createDataFrame(rows, TEXTS).repartition(3)).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert Counter(tuple(r)[:6] for r in found) == Counter(brute_form(i, t) for i, t in rows)
    assert Counter((r["doc_id"], r["back"]) for r in found) == Counter((i, t or "") for i, t in rows)
    assert {r["form"] for r in found} == {"plain", "psm", "spm"}
    assert fim.transformed(empty).count() == 0


@pytest.mark.parametrize("unit,pattern", [("words", r"\s+|\S+"), ("lines", r"[^\n]*\n|[^\n]+")])
def test_other_units(unit, pattern):
    for text in ("one two　 three\n\n four", "x", " ", "\n", "a\nb\n\nc ", "é 😀\n"):
        points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
        edges = fim.boundaries(points, unit)
        assert [text[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)] == re.findall(pattern, text)


def test_unit_rate_and_seed(spark):
    rows = spark.createDataFrame([(i, "one two three") for i in range(200)], TEXTS)
    assert fim.transformed(rows, rate=0).where("form <> 'plain'").count() == 0
    assert fim.transformed(rows, rate=100, spm=100).where("form <> 'spm'").count() == 0
    found = fim.transformed(rows, unit="words", rate=100)
    assert {r["prefix_chars"] for r in found.collect()} <= {0, 3, 4, 7, 8, 13} and {r["n"] for r in found.collect()} == {5}
    assert fim.transformed(rows, seed=2).exceptAll(fim.transformed(rows)).count() > 0
    with pytest.raises(ValueError):
        fim.transformed(rows, unit="bytes")


# --- importance resampling ----------------------------------------------------------------


def features(text):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text))
    return Counter(zlib.crc32(" ".join(w[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(w) - n + 1)), len(w)


def brute_draw(rows, target):
    found = [features(t) for _, t in rows]
    s, t = Counter(), Counter()
    for c, _ in found:
        s.update(c)
    for x in target:
        t.update(features(x)[0])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000)))) for b in range(10_000)]
    out = []
    for (i, _), (c, words) in zip(rows, found, strict=True):
        weight = sum(gain[b] * k for b, k in c.items())
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, sum(c.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), words))
    able = sorted((x for x in out if x[4] >= 20), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    return out, {x[0]: k + 1 for k, x in enumerate(able[: 5 * len(able) // 100])}


def check_draw(spark, rows, target, df=None):
    df = spark.createDataFrame(rows, TEXTS).repartition(4) if df is None else df
    got = resample.resampled(df, spark.createDataFrame([(t,) for t in target], "text string")).collect()
    out, rank = brute_draw(rows, target)
    assert Counter((r["doc_id"], r["n_features"], r["weight"], r["score"]) for r in got) == Counter(x[:4] for x in out)
    assert {r["doc_id"]: r["rank"] for r in got if r["rank"]} == rank
    return got


def test_draw_equals_brute_force(spark, prose, docs):
    rows = prose * 2 + [(None, "null id " * 30)]
    rows = [(None if i is None else k, t) for k, (i, t) in enumerate(rows)]
    target = [t for _, t in prose[:7]] + [None, "", "Two WORDS"]
    got = check_draw(spark, rows, target)
    assert sum(r["rank"] is not None for r in got) >= 5
    check_draw(spark, [(r["doc_id"], r["text"]) for r in docs.collect()], target, docs)


def test_draw_edges(spark, prose, empty):
    none = spark.createDataFrame([], "text string")
    assert resample.resampled(empty, none).count() == 0
    check_draw(spark, prose, [])
    long_ = [(0, "Word é9 " * 400_000), (1, "x" * 200_000 + " y"), (2, None), (2, None)]
    check_draw(spark, long_, ["word", "x y"])


@pytest.mark.parametrize("step", [5, 1 << 18])
def test_tallies_in_small_steps(prose, monkeypatch, step):
    monkeypatch.setattr(resample, "STEP", step)
    texts = [t for _, t in prose[:9]] + ["", None]
    sizes, key, count = resample.tallied(texts)
    got = {i: Counter() for i in range(len(texts))}
    for k, c in zip(key.tolist(), count.tolist(), strict=True):
        if c:
            got[k % len(texts)][k // len(texts)] += c
    for i, t in enumerate(texts):
        want, words = features(t)
        assert got[i] == want and sizes[i] == words


def test_crc_of_runs():
    words = [b"a", b"bc", bytes(70), b"x" * 5000, b"\xc3\xa9" * 3, b"d"]
    found, _ = resample.buckets(words, np.zeros(6, dtype=np.int64))
    want = [zlib.crc32(b" ".join(words[i : i + n])) % 10_000 for n in (1, 2, 3) for i in range(7 - n)]
    assert found.tolist() == want


def test_postings_unpack():
    import zstandard

    bucket, doc, count = np.array([3, 3, 5, 9]), np.array([0, 70_000, 2, 0]), np.array([1, 300, 70_000, 2])
    totals, payload = resample.packed(bucket, doc, count, 3, 10, zstandard.ZstdCompressor())
    assert totals == [301, 0, 70_000, 0, 0, 0, 2]
    got = resample.unpacked(payload, 7, zstandard.ZstdDecompressor())
    assert [x.tolist() for x in got] == [[0, 0, 2, 6], doc.tolist(), count.tolist()]
    got = resample.unpacked(resample.packed(bucket[:0], doc[:0], count[:0], 3, 10, zstandard.ZstdCompressor())[1], 7, zstandard.ZstdDecompressor())
    assert [len(x) for x in got] == [0, 0, 0]
