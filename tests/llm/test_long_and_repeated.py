"""Texts of some megabytes, repeated and null ids, through the earlier operators."""

import hashlib
import zlib
from collections import Counter

import numpy as np
from tokenizers import Tokenizer

from quernstone.llm import bpe, exact_dedup, language_id, packing, sharding, token_store, url_filter
from quernstone.llm.pieces import tokenizer_path

BYTE, WORD = tokenizer_path(bpe.TABLE), tokenizer_path(packing.TABLE)
TEXTS = "doc_id long, text string"
LONG = " ".join(f"word{i * 7919 % 10_007} é{i}" for i in range(200_000))  # 3 MB
REPEATED = [(7, "one two three"), (7, "one two three"), (7, "another text"), (None, "no id"), (None, "no id"), (3, None), (3, ""), (9, LONG)]


def test_exact_groups_of_long_texts(spark):
    rows = [(1, LONG), (2, LONG.replace(" ", "\t \n")), (3, LONG + "x"), (4, LONG[:-1])]
    found = exact_dedup.exact_groups(exact_dedup.digests(spark.createDataFrame(rows, TEXTS))).collect()
    assert {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in found} == {1: (1, 2), 2: (1, 2), 3: (3, 1), 4: (4, 1)}
    assert {bytes(r["sha"]).hex() for r in found if r["doc_id"] == 2} == {hashlib.sha256(LONG.encode()).hexdigest()}


def test_language_of_long_texts(spark):
    parts = {"aa": "tion the ing and", "bb": "und sch ung ein"}
    rows = [(i, f"{parts[n]} {i} " * 10, n) for i, n in enumerate(list(parts) * 40)] + [(900 + k, (t + " ") * 200_000, n) for k, (n, t) in enumerate(parts.items())]
    df = spark.createDataFrame(rows, TEXTS + ", lang string")
    got = {r["doc_id"]: r["p"]["lang"] for r in df.select("doc_id", language_id.identified(df).alias("p")).collect()}
    assert got[900] == "aa" and got[901] == "bb"


def test_shard_of_a_long_text(spark, tmp_path):
    spark.createDataFrame([(1, LONG), (2, None)], TEXTS).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["size"], r["text_crc32"]) for r in sharding.op5_rendezvous_sharding(spark, str(tmp_path)).collect()}
    assert got == {1: (len(LONG.encode()) + 16, zlib.crc32(LONG.encode())), 2: (16, 0)}


def test_long_urls(spark):
    path = "/en/" + "segment/" * 300_000
    rows = spark.createDataFrame([(1, "http://a.example.net" + path + "?q"), (2, "http://x.net" + path), (3, "http://" + "h" * 2_000_000)], "page_id long, url string")
    got = {r["page_id"]: r for r in url_filter.judge(rows).collect()}
    assert (got[1]["path"], got[1]["rule"], got[1]["verdict"]) == (path, "example.net/en/", "allow")
    assert got[2]["verdict"] == "block" and len(got[3]["host"]) == 2_000_000 and got[3]["verdict"] == "allow"


def test_bpe_equals_the_librarys_decode(spark):
    library = Tokenizer.from_file(BYTE)
    found = bpe.digests(spark.createDataFrame(REPEATED, TEXTS), BYTE).collect()

    def want(text):
        ids = library.encode(text or "", add_special_tokens=False).ids
        return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()

    assert Counter(tuple(r) for r in found) == Counter((i, *want(t)) for i, t in REPEATED)


def test_store_of_repeated_and_null_ids(spark):
    library = Tokenizer.from_file(BYTE)
    path = token_store.store(spark.createDataFrame(REPEATED, TEXTS).repartition(3), BYTE)
    got = sorted(token_store.read_back(spark, path).collect(), key=lambda r: r["start"])
    ids = [(i, [*library.encode(t or "", add_special_tokens=False).ids, 2]) for i, t in REPEATED]
    facts = Counter((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes()), True) for i, x in ids)
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"], r["verified"]) for r in got) == facts
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    known = [r["doc_id"] for r in got if r["doc_id"] is not None]
    assert known == sorted(known)


def test_packing_of_repeated_and_null_ids(spark):
    library = Tokenizer.from_file(WORD)
    rows = packing.packed(spark.createDataFrame(REPEATED, TEXTS).repartition(3), WORD, with_ids=True).collect()
    want = Counter((i, t) for i, x in ((i, [*library.encode(t or "", add_special_tokens=False).ids, 2]) for i, t in REPEATED) for t in x)
    assert Counter((r["doc_id"], t) for r in rows for t in np.frombuffer(bytes(r["ids"]), "<u4").tolist()) == want
    sequences = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert sequences.get(r["sequence_id"], 0) == r["offset"]
        sequences[r["sequence_id"]] = r["offset"] + r["length"]
    assert all(n <= 4096 and n & (n - 1) == 0 for n in sequences.values())


