import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from quernstone.llm import ann, language_id, sharding, toxicity, url_filter

ENDINGS = {"aa": ("tion", "the", "ing", "and"), "bb": ("und", "sch", "ung", "ein"), "cc": ("que", "eau", "les", "oux")}


def test_language(spark, docs, empty):
    draw = random.Random(5)
    rows = [(i, " ".join(draw.choice(ENDINGS[lang]) + draw.choice("xyz") for _ in range(30)), lang) for i, lang in enumerate(list(ENDINGS) * 60)]
    df = spark.createDataFrame([*rows, (900, None, "aa"), (901, "12 !", "aa"), (902, "tion", None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["p"] for r in df.select("doc_id", language_id.identified(df).alias("p")).collect()}
    held = [(i, lang) for i, _, lang in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i]["lang"] == lang for i, lang in held]) > 0.95
    assert got[900]["lang"] == got[901]["lang"] == "und" and got[900]["score"] == 0
    assert all(0 <= p["score"] <= 1 for p in got.values())
    kept = language_id.keep_identified(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, [4, 5, 6, 8, 9, None]))
    assert language_id.keep_identified(empty).count() == 0
    nothing = language_id.keep_identified(docs.withColumn("lang", F.lit(None).cast("string")))
    assert sorted(str(r["doc_id"]) for r in nothing.collect()) == sorted(map(str, [4, 5, 6, 8, 9, None]))
    told = {r["doc_id"]: r["lang"] for r in language_id.keep_identified(df).collect()}
    assert told[902] in ENDINGS and 900 not in told and all(told[i] == lang for i, _, lang in rows)


def test_every_language_is_learned(spark):
    """Forty languages, one of which has long texts only; the sample is bounded all the same."""
    draw = random.Random(6)
    names = [f"l{k:02}" for k in range(40)]
    parts = {n: ["".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3)) for _ in range(12)] for n in names}
    text = lambda n, size: " ".join(draw.choice(parts[n]) + draw.choice(parts[n]) for _ in range(size))
    rows = [(i, text(n, 4_000 if n == "l39" else 40), n) for i, n in enumerate(names * 15)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert all(len(t) > language_id.SAMPLE_CHARS for _, t, n in rows if n == "l39")
    learned = language_id.sample(df)
    assert {n for n, _ in learned} == set(names) and len(learned) <= language_id.SAMPLE_ROWS
    assert max(len(t) for _, t in learned) <= language_id.SAMPLE_CHARS and sum(len(t) for _, t in learned) <= language_id.SAMPLE_TOTAL
    got = {r["doc_id"]: r["p"]["lang"] for r in df.select("doc_id", language_id.identified(df).alias("p")).collect()}
    held = [(i, n) for i, _, n in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i] == n for i, n in held]) > 0.95
    assert all(got[i] == n for i, n in held if n == "l39") and any(n == "l39" for _, n in held)


def test_sample_has_a_bound(spark, monkeypatch):
    monkeypatch.setattr(language_id, "SAMPLE_ROWS", 8)
    monkeypatch.setattr(language_id, "SAMPLE_TOTAL", 40)
    rows = [(i, "some text of words", f"l{i % 4}") for i in range(200)]
    learned = language_id.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(learned) <= 8 and {n for n, _ in learned} == {"l0", "l1", "l2", "l3"} and sum(len(t) for _, t in learned) <= 40


def test_kernel_is_the_presence_kernel():
    rows = [("a", "abab abc"), ("b", "xyz xyy")] * 3
    model = language_id.train(rows)
    table, flags = language_id.symbols_of(model["letters"]), np.zeros(language_id.SPACE, dtype=bool)
    text = "ab c"
    want = {*"abc", " ", "ab", "b ", " c", "ab ", "b c"}
    assert len(language_id.grams(text, table, flags)) == len(want) and not flags.any()


def brute_language(rows, texts):
    """Scores of each language by the definitions: presence kernel, landmarks, ridge."""
    counts = {}
    for _, t in rows:
        for c in set(t.lower()):
            if c.isalpha():
                counts[c] = counts.get(c, 0) + 1
    letters = set(sorted(counts, key=lambda c: (-counts[c], c))[: language_id.LETTERS])

    def spectrum(t):
        out = []
        for c in t.lower():
            x = " " if not c.isalpha() else c if c in letters else "?"
            if x != " " or not out or out[-1] != " ":
                out.append(x)
        return {"".join(out[i : i + n]) for n in (1, 2, 3) for i in range(len(out) - n + 1)}

    kernel = lambda a, b: len(a & b) / (len(a) * len(b)) ** 0.5
    langs = sorted({lang for lang, _ in rows})
    sets = [spectrum(t) for _, t in rows]
    each = language_id.LANDMARKS // len(langs)
    marks = [i for lang in langs for i in [j for j, r in enumerate(rows) if r[0] == lang][:each]]
    cross = np.array([[kernel(a, sets[m]) for m in marks] for a in sets])
    within = np.array([[kernel(sets[a], sets[m]) for m in marks] for a in marks])
    target = np.array([[1.0 if lang == x else -1.0 for x in langs] for lang, _ in rows])
    solved = np.linalg.lstsq(cross.T @ cross + language_id.RIDGE * len(rows) * (within + 1e-6 * np.eye(len(marks))), cross.T @ target, rcond=None)[0]
    raw = np.array([[kernel(spectrum(t), sets[m]) for m in marks] for t in texts]) @ solved
    soft = np.exp(language_id.SHARPNESS * (raw - raw.max(axis=1, keepdims=True)))
    return langs, soft / soft.sum(axis=1, keepdims=True)


def test_language_equals_brute_force(spark):
    draw = random.Random(11)
    text = lambda lang: " ".join(draw.choice(ENDINGS[lang]) + draw.choice(["x", "y", "é", "1", "-", "Q"]) for _ in range(draw.randint(3, 25)))
    rows = [(lang, text(lang)) for lang in list(ENDINGS) * 25]
    texts = [text(lang) for lang in list(ENDINGS) * 10] + ["tion und que", "ñandú", rows[0][1], rows[0][1]]
    langs, want = brute_language(rows, texts)
    predict = language_id.predictor(spark, language_id.train(rows))
    got = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", predict(F.col("text")).alias("p")).orderBy("i").collect()
    for r, w in zip(got, want, strict=True):
        assert abs(r["p"]["score"] - w.max()) < 2e-3
        if np.sort(w)[-1] - np.sort(w)[-2] > 5e-3:
            assert r["p"]["lang"] == langs[int(w.argmax())]
    assert got[-1]["p"] == got[-2]["p"]


def brute_dictionaries(rows, model):
    """Both dictionaries from the sample: two rows in three of each class; ordinary windows, and
    the toxic documents' marked words in windows, trained by zstandard."""
    import re
    from collections import Counter

    import zstandard

    of = [[t for i, t in enumerate(t for c, t in rows if c == k) if i % 3 != 2] for k in (0, 1)]
    window = lambda words: [" " + " ".join(words[i : i + 6]) for i in range(0, len(words), 6)]
    plain = zstandard.train_dictionary(toxicity.ORDINARY_BYTES, [w.encode() for t in of[0] for w in window(t.lower().split())]).as_bytes()
    seen = [Counter(o for t in texts for o in {w[:k] for w in re.findall(r"\w+", t.lower()) for k in (4, 5, 6) if len(w) >= k}) for texts in of]
    n, m = len(of[1]), len(of[0])
    marks = {o for o, c in seen[1].items() if c >= max(4, 0.02 * n) and (c + 0.5) / n >= 20 * (seen[0][o] + 0.5) / m}
    whole = Counter(w for t in of[1] for w in set(re.findall(r"\w+", t.lower())))
    told = []
    for t in of[1]:
        for w in sorted(set(re.findall(r"\w+", t.lower()))):
            opening = next((w[:k] for k in (4, 5, 6) if len(w) >= k and w[:k] in marks), None)
            if opening:
                told.append(w if whole[w] >= 0.05 * n else opening)
    samples = ["".join(" " + w for w in told[i : i + 6]).encode() for i in range(0, len(told), 6)]
    contents = []
    for size in toxicity.SIZES:
        try:
            contents.append(zstandard.train_dictionary(size, samples).as_bytes())
        except zstandard.ZstdError:
            contents.append(b"".join(dict.fromkeys(samples))[-size:])
    chosen = model["pair"][1][: len(model["pair"][1]) - len(plain)]
    assert chosen in contents
    return plain, chosen + plain


def test_toxic_scores_equal_brute_force(spark):
    """Scores recomputed from the two dictionaries: windows, lengths, features, calibration."""
    import math

    import zstandard

    draw = random.Random(12)
    words = ["".join(draw.choice("abcdefgh") for _ in range(5)) for _ in range(60)]
    rows = []
    for i in range(240):
        t = [draw.choice(words) for _ in range(30)] + (["zzkrumpf", "wwknorz"] if i % 3 == 0 else [])
        draw.shuffle(t)
        rows.append((int(i % 3 == 0), " ".join(t)))
    model = toxicity.train(rows)
    assert model["pair"] == brute_dictionaries(rows, model)
    texts = [*(t for _, t in rows[:40]), None, "", "zzkrumpf", rows[0][1], "x" * 100_000, " ".join(words * 400)]
    score = toxicity.scorer(spark, model)
    got = [r["s"] for r in spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", score(F.col("text")).alias("s")).orderBy("i").collect()]
    length = []
    for content in model["pair"]:
        table = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        length.append(lambda w, d=table: len(zstandard.ZstdCompressor(level=toxicity.LEVEL, dict_data=d, write_content_size=False, write_dict_id=False, write_checksum=False).compress(w)))
    for text, s in zip(texts, got, strict=True):
        w = (text or "").lower().split()
        cut = [(" " + " ".join(w[i : i + toxicity.WORDS])).encode() for i in range(0, len(w), toxicity.WORDS)]
        margins = [length[0](x) - length[1](x) for x in cut] or [0]
        top = [*sorted(margins, reverse=True)[:3], 0, 0][:3]
        above = [sum(m >= k for m in margins) for k in (2, 3, 4, 5, 6)]
        n = math.log1p(len(margins))
        x = [*(min(max(t, -2), 12) for t in top), *(math.log1p(a) for a in above), *(a / len(margins) for a in above), n, top[0] * n / 10]
        z = sum((v - m) / d * b for v, m, d, b in zip(x, model["mean"], model["spread"], model["b"][:-1], strict=True)) + model["b"][-1]
        assert abs(s - 1 / (1 + math.exp(-min(max(z, -30), 30)))) < 1e-9
    assert got[0] == got[43]


def test_words_of_the_sample_are_not_all_held():
    """The driver holds one ordinary text's words at a time, not those of all."""
    import random
    import tracemalloc

    from quernstone.llm.toxicity import apart

    draw = random.Random(5)
    text = lambda: " ".join(f"{draw.choice('abcdefgh')}{draw.randrange(600)}" for _ in range(1500))
    ordinary, toxic = [text() for _ in range(100)], [text() + " badword" for _ in range(20)]
    tracemalloc.start()
    try:
        found = apart(toxic, ordinary)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert found == [b" badword"] * 20
    assert peak < 4_000_000


def test_toxicity(spark, docs, empty):
    draw = random.Random(6)
    words = ["".join(draw.choice("abcdefgh") for _ in range(6)) for _ in range(80)]
    rows, marks = [], []
    for i in range(500):
        text = [draw.choice(words) for _ in range(60)]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(4):
                text[draw.randrange(60)] = draw.choice(("zzkrumpf", "vvquatsch", "wwknorz"))
        rows.append((i, " ".join(text)))
        marks.append((i, int(toxic), 1))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([*marks, (None, 1, 0), (3, None, 0)], "doc_id long, toxic int, quality int")
    got = {r["doc_id"]: r["s"] for r in df.select("doc_id", toxicity.toxicity(df, labels).alias("s")).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == (i % 4 == 0) for i in held]) > 0.9
    assert toxicity.keep_civil(docs, labels).columns == docs.columns
    scores = [r[0] for r in docs.select(toxicity.toxicity(docs, labels, df)).collect()]
    assert len(scores) == 10 and all(0 <= s <= 1 for s in scores)
    assert toxicity.keep_civil(empty, labels).count() == 0
    assert {r[0] for r in docs.select(toxicity.toxicity(docs, labels.where("doc_id < 0"))).collect()} == {0.0}


def test_sharding_law(spark, docs, empty):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.monotonically_increasing_id().alias("row"))
    placed = sharding.assign(rows, F.col("doc_id"), [1.0] * 40).cache()
    grown = {r["doc_id"]: r["shard"] for r in sharding.assign(rows, F.col("doc_id"), [1.0] * 41).collect()}
    for r in placed.collect():
        assert r["grown_shard"] == grown[r["doc_id"]] and r["grown_shard"] in (r["shard"], 40)
    slotted = sharding.with_slots(placed, block_rows=20).collect()
    for shard in range(40):
        slots = sorted(r["slot"] for r in slotted if r["shard"] == shard)
        assert slots == list(range(len(slots))) and len(slots) > 30
    heavy = sharding.assign(rows, F.col("doc_id"), [3.0, 1.0]).groupBy("shard").count().collect()
    assert 0.7 < {r["shard"]: r["count"] for r in heavy}[0] / 3000 < 0.8
    edge = sharding.assign(docs.drop("row").withColumn("row", F.monotonically_increasing_id()), F.col("doc_id"), [1.0] * 3)
    assert sharding.with_slots(edge).count() == 10
    assert sharding.with_slots(sharding.assign(empty.select("doc_id", F.col("row").cast("long")), F.col("doc_id"), [1.0])).count() == 0


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    for c in "?#":
        rest = rest.split(c, 1)[0]
    host, slash, path = rest.partition("/")
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), slash + path


def test_sharding_query(spark, tmp_path):
    """The whole query against hashlib, zlib and the definitions, with null and repeated keys."""
    import hashlib
    import math

    rows = [(i, None if i % 9 == 0 else "" if i % 7 == 0 else f"text é {i}" * (i % 5)) for i in range(400)] + [(5, "again"), (5, "again"), (None, "no id")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sharding.op5_rendezvous_sharding(spark, str(tmp_path)).collect()

    def shard(key, n):
        u = [(int(hashlib.md5(f"{key}:{s}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52 for s in range(n)]
        return min(range(n), key=lambda s: (-math.log(u[s]), s))

    facts = lambda i, t: (i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()), shard("" if i is None else i, 40), shard("" if i is None else i, 41))
    assert sorted(map(str, ((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["grown_shard"]) for r in got))) == sorted(str(facts(*r)) for r in rows)
    for s in range(40):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert {r["law"] for r in got} == {"key"}


URLS = [None, "", "no scheme/x", "http://A.Example.NET/en/1?x", "http://example.net/de/1", "http://x.org/fr/", "http://org/en", "https://q.example.com/de/x#y", "http://example.com", "http://notexample.com/de/1", "a://b://c/d", "http://x.net", "http://x.NET?a/b", "http://ÄX.org/fr/x"]


def test_url_parts_and_rules(spark):
    rows = spark.createDataFrame([(i, u, "clash", 1) for i, u in enumerate(URLS)], "page_id long, url string, host string, salt int")
    got = {r["page_id"]: r for r in url_filter.judge(rows).collect()}
    for i, url in enumerate(URLS):
        host, path = parts(url)
        best = max(((v, h, p) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)), key=lambda r: len(r[1] + r[2]), default=None)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, best and best[1] + best[2])
        assert got[i]["verdict"] == (best[0] if best else "allow")
    assert url_filter.judge(rows.where("page_id < 0")).count() == 0


def test_templates_learn_from_labels(spark):
    rows = [(i, f"http://h.test/{'bad' if i % 2 else 'good'}/{'x' if i % 4 < 2 else 'y'}/{i}.html", (1 if i % 2 else 0) if i % 5 else None) for i in range(400)]
    rows += [(1000 + i, f"http://h.test/user/{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}/page", None) for i in range(100)]
    df = spark.createDataFrame(rows, "page_id long, url string, mark int")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(df, rules=(), label="mark").collect()}
    assert all(got[i] == ("block" if i % 2 else "allow") for i in range(400))
    assert all(got[1000 + i] == "allow" for i in range(100))
    leaves = url_filter.judge
    assert leaves is not None


def brute_tree(rows):
    """page_id -> verdict by the same tree in plain Python; rows: (page_id, url, mark)."""
    import re
    from collections import defaultdict

    literal = lambda s: s[0] not in "{*"

    def shape(s):
        m = re.search(r"(\.[A-Za-z]{1,5})$", s)
        end = m[1] if m else ""
        stem = s[: len(s) - len(end)]
        if re.fullmatch(r"[0-9]+", stem):
            return "{n}" + end
        if re.fullmatch(r"[0-9a-fA-F-]{8,}", stem):
            return "{h}" + end
        if re.search(r"[0-9]", stem):
            return "{x}" + end
        return "{l}" + end if len(stem) > 40 or stem[:1] in ("{", "*") else s

    leaf_of, leaves = {}, defaultdict(lambda: [0, 0])
    for i, url, mark in rows:
        host, path = parts(url)
        segments = [s for s in path.split("/") if s]
        leaf = tuple([shape(s) for s in segments[: url_filter.DEPTH]] + (["**"] if len(segments) > url_filter.DEPTH else []))
        leaf_of[i] = (host, leaf)
        c = leaves[host, leaf]
        c[0] += mark == 1
        c[1] += mark == 0
    node = {k: k[1] for k in leaves}
    at = lambda n, d: n[d] if len(n) > d else None
    blank = lambda n, d: n[:d] + ("*",) + n[d + 1 :]
    for d in range(url_filter.DEPTH):
        kinds = defaultdict(set)
        for (host, _), n in node.items():
            if at(n, d) and literal(n[d]):
                kinds[host, n[:d]].add(n[d])
        node = {k: blank(n, d) if at(n, d) and literal(n[d]) and len(kinds[k[0], n[:d]]) > url_filter.FAN_OUT else n for k, n in node.items()}
    merges = 0
    for d in range(url_filter.DEPTH):
        kids = defaultdict(lambda: defaultdict(lambda: [0, 0]))
        for k, n in node.items():
            if at(n, d) and literal(n[d]):
                kids[k[0], blank(n, d)][n[d]][0] += leaves[k][0]
                kids[k[0], blank(n, d)][n[d]][1] += sum(leaves[k])
        good = set()
        for group, children in kids.items():
            known = {c: v for c, v in children.items() if v[1]}
            wb, wl = (sum(v[j] for v in known.values()) for j in (0, 1))
            if len(known) > 1:
                p = (wb + 1) / (wl + 2)
                if all(abs(b / n - wb / wl) <= url_filter.Z * (p * (1 - p) * (1 / n + 1 / wl)) ** 0.5 for b, n in known.values()):
                    good |= {(*group, c) for c in known}
        merges += len(good)
        node = {k: blank(n, d) if at(n, d) and literal(n[d]) and (k[0], blank(n, d), n[d]) in good else n for k, n in node.items()}
    total = [sum(v[j] for v in leaves.values()) for j in (0, 1)]
    base = (total[0] + 1) / (sum(total) + 2)
    hosts, nodes = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for k, v in leaves.items():
        for j in (0, 1):
            hosts[k[0]][j] += v[j]
            nodes[k[0], node[k]][j] += v[j]
    alpha = url_filter.ALPHA

    def bad(k):
        b, a = nodes[k[0], node[k]]
        hb, ha = hosts[k[0]]
        prior = (hb + alpha * base) / (hb + ha + alpha)
        return b + a >= url_filter.MIN_LABELS and (b + alpha * prior) / (b + a + alpha) >= url_filter.PURITY

    return {i: "block" if bad(k) else "allow" for i, k in leaf_of.items()}, merges


def test_tree_equals_brute_force(spark):
    """Several hosts: branches that merge, branches whose labels differ, wide ones, branches
    without labels, too few labels."""
    draw, rows = random.Random(9), []
    for h in range(6):
        for i in range(600):
            first = draw.choice(["shop", "blog", "spam", "ads"])
            second = draw.choice("abcdef") if first != "ads" else f"u{''.join(draw.choice('abcdefghij') for _ in range(3))}"
            third = draw.choice(["x.html", f"{i}.html", "p/q/r/s"])
            share = {"shop": 0.05, "blog": 0.5 if second < "c" else 0.02, "spam": 0.95, "ads": 0.9}[first] if h < 4 else 0.5
            mark = int(draw.random() < share) if draw.random() < 0.6 and not (first == "shop" and second == "f") else None
            rows.append((len(rows), f"https://h{h}.test/{first}/{second}/{third}?q", mark))
    rows += [(9000 + i, f"https://few.test/spam/{i}", 1) for i in range(5)] + [(9100 + i, f"https://none.test/a/{i}", None) for i in range(30)]
    want, merges = brute_tree(rows)
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, mark int"), rules=(), label="mark").collect()}
    assert got == want and merges > 20
    assert 300 < sum(v == "block" for v in want.values()) < 2500


def test_repeated_pages_and_equal_rules(spark):
    rows = spark.createDataFrame([(1, "http://a.b/x/1"), (1, "http://a.b/x/1"), (None, "http://a.b/y")], "page_id long, url string")
    rules = (("allow", "b", "/x/"), ("block", "b", "/y"), ("block", "a.b", "/"))  # a.b/ and b/x/ are equally long
    got = [tuple(r)[3:] for r in url_filter.judge(rows, rules=rules).orderBy(F.col("page_id").asc_nulls_last()).collect()]
    assert got == [("a.b/", "block"), ("a.b/", "block"), ("a.b/", "block")]


def test_neighbours(spark):
    draw = np.random.default_rng(2)
    centres = draw.normal(size=(12, 16)) * 3
    x = centres[draw.integers(0, 12, 3000)] + draw.normal(size=(3000, 16))
    x[5] = x[7]
    bad = [(5000, None), (5100, [0.0] * 16), (5200, [float("nan")] * 16), (5300, [1.0]), (5400, [1.0] * 15 + [None]), (None, [1.0] * 16)]
    df = spark.createDataFrame([*((i, v.tolist()) for i, v in enumerate(x)), *bad], "vec_id long, embedding array<double>").withColumn("v", F.lit("clash"))
    found = ann.search(df, F.col("id") % 100 == 0).collect()
    model = ann.fit(x, 3000)
    assert 2 * model["visits"] < model["w"].shape[1]  # the router prunes
    hit = 0
    for q in range(0, 3000, 100):
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in found if r["query_id"] == q)
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        best = np.lexsort((np.arange(3000), d))[:10]
        assert [m[0] for m in mine] == list(range(1, 11)) and all(m[2] == d[m[1]] for m in mine)
        hit += len({m[1] for m in mine} & set(best.tolist()))
    assert hit / 300 >= 0.9
    assert {r["query_id"] for r in found} == set(range(0, 3000, 100))
    few = ann.search(df.where("vec_id < 4"), F.col("id") == 0).orderBy("rank").collect()
    assert [r["rank"] for r in few] == [1, 2, 3]
    assert ann.search(df.where("vec_id < 0"), F.col("id") == 0).count() == 0
    twice = df.where("vec_id < 40").unionByName(df.where("vec_id < 2"))
    got = ann.search(twice, F.col("id") == 0).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 11)) and 0 not in {r["vec_id"] for r in got}
