"""Byte-pair encoding and decoding by a tokenization automaton.

Compilation (after Berglund, Martens and van der Merwe, "Constructing a BPE
tokenization DFA"): the automaton starts as one state with an arc for each byte token.
The merges are then applied in order. The gadget of a merge (u, v) -> w

* adds an arc w wherever an arc u leads, to a copy of the state that v leads to, and
* splits the state that u leads to, taking the arc v out of it.

A path spells a token sequence, and the paths that remain are exactly the encodings.
States are named by the token that leads to them. A copied state shares the arcs of the
state it was copied from as they were at that merge, so each gadget is kept as one
entry with its time, and ``arc`` follows copies back in time; answers are tabled.

Encoding a word runs a deterministic automaton over its bytes. Its state is the prefix
read, with the last token of the prefix's encoding and the state before that token;
transitions are resolved once from the arcs and then table-driven. The word's ids are
the arc labels on the way back. Decoding emits the labels' bytes.

The byte automaton's states are prefixes of words, made as they are met: all of them are
not finite in number, and those of one vocabulary's words would not fit. Tables have
documented bounds; a full table is emptied, which changes no result.

Edge cases: null and empty texts have no ids (the hash of the empty string); strings of
special tokens in a text give the special id, as the library does by default; repeated
ids are encoded row by row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from quernstone.llm.common import read
from quernstone.llm.pieces import PieceTable, grouped, tokenizer_path

#: The published splitting pattern of this vocabulary family (fixed value).
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Prefix states, answered arcs and words that a worker keeps; longer words than LONG
#: bytes are encoded without keeping their prefixes.
STATES, ARCS, KNOWN, LONG = 300_000, 300_000, 200_000, 200

TABLE = "byte_bpe_50k.json"


def byte_symbols() -> list[str]:
    """The printable stand-in for each byte: itself if printable in Latin-1, else the
    next character from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Automaton:
    def __init__(self, vocabulary: dict[str, int], merges: Iterable, special: dict[str, int]):
        symbols = byte_symbols()
        back = {s: b for b, s in enumerate(symbols)}
        self.special = special
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        size = 1 + max([*vocabulary.values(), *special.values()])
        self.labels: list[bytes] = [b""] * size
        for token, i in vocabulary.items():
            self.labels[i] = token.encode() if token in special else bytes(back[c] for c in token)
        for token, i in special.items():
            self.labels[i] = token.encode()
        self.token: dict[bytes, int] = {bytes([b]): vocabulary[s] for b, s in enumerate(symbols) if s in vocabulary}
        #: Gadgets: when a pair's arc is taken out; when and from which pair a token is made.
        self.removed: dict[tuple[int, int], int] = {}
        self.made: list[tuple[int, int, int]] = [(-1, -1, -1)] * size
        for time, pair in enumerate(merges):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.gadget(time, vocabulary[left], vocabulary[right], vocabulary[left + right])
        self.longest = max(map(len, self.token))
        self.arcs: dict[int, bool] = {}
        self.words: dict[str, list[int]] = {}
        self.reset()

    def gadget(self, time: int, u: int, v: int, w: int) -> None:
        self.removed.setdefault((u, v), time)
        if self.labels[w] not in self.token:
            self.token[self.labels[w]] = w
            self.made[w] = (time, u, v)

    def arc(self, state: int, token: int) -> bool:
        """Does an arc ``token`` leave the state that the token ``state`` leads to?"""
        key = state << 32 | token
        if (known := self.arcs.get(key)) is None:
            if len(self.arcs) >= ARCS:
                self.arcs.clear()
            known = self.arcs[key] = self.arc_at(state, token, len(self.removed) + 1)
        return known

    def arc_at(self, p: int, t: int, before: int) -> bool:
        """The same, counting gadgets earlier than ``before`` only."""
        while True:
            p_time, _, p_right = self.made[p]
            t_time, t_left, t_right = self.made[t]
            out = self.removed.get((p, t))
            if out is not None and out < before:
                return False
            if p_time < 0 and t_time < 0:
                return True
            if p_time > t_time:  # the state is a copy of its right part's, made at p_time
                p, before = p_right, p_time
            elif t_time > p_time:  # the arc was added beside its left part's arc at t_time
                if t_left == p == t_right:
                    return False
                t, before = t_left, t_time
            else:  # a token after itself: its state was copied when its arc was added
                p, t, before = p_right, t_left, p_time

    def reset(self) -> None:
        self.step: dict[int, int] = {}
        self.last, self.cut, self.parent, self.tail = [-1], [0], [0], [b""]

    def extend(self, state: int, byte: int) -> int:
        """The transition from ``state`` on ``byte``, resolved and tabled."""
        text = self.tail[state] + bytes([byte])
        known, at = self.token.get, state  # ``at`` stands before the last n bytes
        for n in range(1, len(text) + 1):
            token = known(text[-n:])
            if token is not None and (at == 0 or self.arc(self.last[at], token)):
                self.last.append(token)
                self.cut.append(at)
                self.parent.append(state)
                self.tail.append(text[-self.longest + 1 :] if self.longest > 1 else b"")
                self.step[state << 8 | byte] = new = len(self.last) - 1
                return new
            at = self.parent[at]
        raise ValueError(f"byte {byte} is not in the vocabulary")

    def word(self, word: bytes) -> list[int]:
        if len(word) > LONG:
            return self.long_word(word)
        if len(self.last) > STATES:
            self.reset()
        step, state = self.step, 0
        for byte in word:
            state = step.get(state << 8 | byte) or self.extend(state, byte)
        out = []
        while state:
            out.append(self.last[state])
            state = self.cut[state]
        return out[::-1]

    def long_word(self, word: bytes) -> list[int]:
        last, cut = [-1] * (len(word) + 1), [0] * (len(word) + 1)
        for end in range(1, len(word) + 1):
            for start in range(max(0, end - self.longest), end):
                token = self.token.get(word[start:end])
                if token is not None and (start == 0 or self.arc(last[start], token)):
                    last[end], cut[end] = token, start
                    break
        out, at = [], len(word)
        while at:
            out.append(last[at])
            at = cut[at]
        return out[::-1]

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for part in self.split_special.split(text) if self.split_special else [text]:
            if part in self.special:
                out.append(self.special[part])
            else:
                for word in WORDS.findall(part):
                    if (ids := self.words.get(word)) is None:
                        ids = self.word(word.encode())
                        if len(word) <= LONG:
                            if len(self.words) >= KNOWN:
                                self.words.clear()
                            self.words[word] = ids
                    out += ids
        return out

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.labels.__getitem__, ids)).decode("utf-8", errors="replace")


@lru_cache(maxsize=2)
def automaton(path: str) -> Automaton:
    with open(path, encoding="utf-8") as f:
        table = json.load(f)
    special = {x["content"]: x["id"] for x in table["added_tokens"]}
    return Automaton(table["model"]["vocab"], table["model"]["merges"], special)


@lru_cache(maxsize=2)
def encoder(path: str) -> PieceTable:
    own = automaton(path)
    return PieceTable(lambda pieces: [array("I", own.encode(p)).tobytes() for p in pieces])


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array of int) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for doc_ids, texts in grouped(batches):
            ids = [x.astype("int32") for x in encode.many(texts)]
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: ``encoded``, decoded again, with
    the digests taken where the ids are made, so that ids don't travel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, labels = encoder(path), automaton(path).labels
        decimal = [str(i) for i in range(len(labels))]
        for doc_ids, texts in grouped(batches):
            counts, ids_sha, text_sha = [], [], []
            for found in encode.many(texts):
                ids = found.tolist()
                decoded = b"".join(map(labels.__getitem__, ids)).decode("utf-8", errors="replace")
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                text_sha.append(hashlib.sha256(decoded.encode()).hexdigest())
            columns = [pa.array(doc_ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read(spark, sf_dir, "documents"), tokenizer_path(TABLE))
