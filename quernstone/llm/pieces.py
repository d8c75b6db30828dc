"""Encoding of whole texts through a cache of pieces.

A text is cut before every space that stands between two characters that are not white
space. Both vocabularies' own splitting patterns always begin a new word there, so the
pieces' ids, joined, are the whole text's ids. A worker keeps the ids of pieces it has
met (Zipf's law makes most of them hits); what it drops changes no
result. Very long texts cost memory for themselves only.

``PieceTable`` does the same for the byte vocabulary with arrays, many texts at a time,
and cuts finer; ``WordTable`` for the lower-case vocabulary. Pieces that are one word of
Latin letters go to the library's model without its normalizer and splitting pattern.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Pieces in each of the two generations of a worker's cache.
CACHE_PIECES = 350_000

#: White space other than space and line feed.
OTHER_WHITE = re.compile(r"[^\S \n]")
SAFE = re.compile(r"(?<=\S) (?=\S)")
#: One word of letters of ASCII and Latin-1: with or without the space before it; after
#: white space or none.
LETTERS = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+"
SPACED, WORD = re.compile(f" ?{LETTERS}"), re.compile(f"[ \t\n\r\x0b\x0c]*({LETTERS})")


@lru_cache(maxsize=1)
def shown_bytes() -> dict[int, int]:
    """The character that byte-level vocabularies write for each byte that is not itself."""
    hidden = [b for b in range(256) if b not in {*range(33, 127), *range(161, 173), *range(174, 256)}]
    return {b: 256 + n for n, b in enumerate(hidden)}


def shown(word: str) -> str:
    """A word of letters, or a space and a word, as byte-level vocabularies write it."""
    return word.replace(" ", "\u0120") if word.isascii() else word.encode().decode("latin-1").translate(shown_bytes())


def cut(text: str) -> tuple[str, list[str]]:
    """The first piece, and the others without the space that each begins with."""
    plain = not ("  " in text or " \n" in text or "\n " in text or OTHER_WHITE.search(text))
    parts = text.split(" ") if plain else SAFE.split(text)
    return parts[0], parts[1:]


class PieceCache:
    """``encode`` takes pieces and returns the ids of each as bytes (uint32, little-endian).

    Two generations: a full one becomes the older one, whose pieces come back when they
    are met again, and the one before it is dropped. So frequent pieces stay."""

    before = " "

    @staticmethod
    def word(piece: str) -> str | None:
        """The piece as the model takes it, if it is one word for certain."""
        return shown(piece) if SPACED.fullmatch(piece) else None

    def __init__(self, encode: Callable[[list[str]], list[bytes]], limit: int = CACHE_PIECES):
        self.encode, self.limit, self.known, self.older = encode, limit, {}, {}

    def joined(self, parts: list[str]) -> bytes:
        known = self.known
        if missing := set(parts).difference(known):
            if len(known) + len(missing) > self.limit:
                self.older, self.known = known, {}
                known, missing = self.known, set(parts)
            older = self.older
            known.update([(p, older[p]) for p in missing if p in older])
            if new := list(missing.difference(older)):
                known.update(zip(new, self.encode([self.before + p for p in new]), strict=True))
        return b"".join(map(known.__getitem__, parts))

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        head, rest = cut(text)
        return self.encode([head])[0] + self.joined(rest)


class WordCache(PieceCache):
    """For a lower-case vocabulary that drops white space: pieces end at any space or
    line feed."""

    before = ""

    @staticmethod
    def word(piece: str) -> str | None:
        found = WORD.fullmatch(piece)
        return shown(found[1].lower()) if found else None

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if text.isascii() and "<|" not in text:  # the vocabulary is lower case: fewer pieces
            text = text.lower()
        return self.joined(list(filter(None, text.replace("\n", " ").split(" "))))


#: Bytes of text that ``PieceTable`` works on at once, and bytes of pieces it keeps.
GROUP_BYTES, KEPT_BYTES = 1 << 20, 48 << 20
#: What the array rules don't cover: special tokens, control characters, and white space
#: beyond ASCII. Such texts are cut at spaces only.
ODD = re.compile(r"<\||[\x00-\x08\x0e-\x1f\x7f]|[^\S \t\n\r\x0b\x0c]")
#: The same, to be looked for one by one, which takes a small part of the pattern's time.
ODD_ASCII = ["<|", *map(chr, [*range(9), *range(14, 32), 127])]
ODD_WHITE = [c for c in map(chr, range(128, 0x10000)) if c.isspace()]
#: Classes of bytes.
OTHER, LETTER, DIGIT, MARK, WHITE, EDGE = range(6)


def odd(text: str) -> bool:
    """Has ``text`` an ``ODD`` part?"""
    return any(map(text.__contains__, ODD_ASCII)) or not text.isascii() and any(map(text.__contains__, ODD_WHITE))


@lru_cache(maxsize=1)
def byte_classes() -> tuple:
    """The class of each byte; powers of the hash's base and of its inverse."""
    import numpy as np

    kinds = np.full(256, OTHER, dtype=np.uint8)
    for b in range(128):
        c = chr(b)
        kinds[b] = LETTER if c.isalpha() else DIGIT if c.isdigit() else WHITE if c.isspace() else MARK
    kinds[0] = EDGE
    base = 0x9E3779B97F4A7C15
    back = pow(base, -1, 1 << 64)
    with np.errstate(over="ignore"):
        powers, inverse = (np.full(2 * GROUP_BYTES, x, dtype=np.uint64) for x in (base, back))
        powers[0] = inverse[0] = 1
        np.cumprod(powers, out=powers)
        np.cumprod(inverse, out=inverse)
    return kinds, powers, inverse


def long_parts(text: str) -> list[str]:
    """A text of more than ``GROUP_BYTES`` characters in parts, cut before a space that
    stands between two characters that are not white space."""
    parts, begin = [], 0
    while len(text) - begin > GROUP_BYTES:
        at = text.find(" ", begin + GROUP_BYTES)
        while at >= 0 and (text[at - 1].isspace() or text[at + 1 : at + 2].isspace() or at + 1 == len(text)):
            at = text.find(" ", at + 1)
        if at < 0:
            break
        parts.append(text[begin:at])
        begin = at
    return [*parts, text[begin:]]


class PieceTable:
    """Ids of many texts by array operations, for the byte vocabulary (its published
    pattern splits letters, digits, other marks, and single spaces before them).

    Texts without ``ODD`` parts are laid in one array of bytes and cut

    * before white space that follows a character that is none,
    * after a single white space other than a space,
    * between letters of ASCII and Latin-1, ASCII digits and marks, but not between ``'``
      and a letter,

    where the pattern always begins a new word, whatever stands on the left. A piece is
    looked up by a 64-bit polynomial hash in an open-addressed table, and the ids are
    gathered. The pieces' stored bytes are gathered too and compared with the texts, so
    that no hash collision can pass; new pieces are encoded in one call."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], bits: int = 21, kept_bytes: int = KEPT_BYTES):
        self.encode, self.bits, self.kept_bytes, self.slow = encode, bits, kept_bytes, self.plain(encode)
        self.clear()

    #: How ``ODD`` texts are encoded.
    plain = PieceCache
    word = staticmethod(PieceCache.word)

    def prepared(self, whole: bytes) -> bytes:
        """What is cut and looked up, byte for byte."""
        return whole

    def clear(self) -> None:
        import numpy as np

        self.keys, self.where = np.zeros(1 << self.bits, dtype=np.uint64), np.zeros(1 << self.bits, dtype=np.int32)
        self.count = 0
        #: ends of each piece's bytes and ids in the two stores
        self.byte_ends, self.id_ends = np.zeros(1 << 16, dtype=np.int32), np.zeros(1 << 16, dtype=np.int32)
        self.bytes, self.stored = np.zeros(1 << 20, dtype=np.uint8), np.zeros(1 << 18, dtype=np.uint32)

    def find(self, hashes):
        """The number of each piece, or -1."""
        import numpy as np

        slot = (hashes * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - self.bits)).astype(np.int64)
        key = self.keys[slot]
        out = np.where(key == hashes, self.where[slot], -1)
        left = np.flatnonzero((key != hashes) & (key != 0))
        while len(left):
            slot[left] = slot[left] + 1 & (1 << self.bits) - 1
            key = self.keys[slot[left]]
            hit = key == hashes[left]
            out[left[hit]] = self.where[slot[left[hit]]]
            left = left[~hit & (key != 0)]
        return out

    def place(self, hashes) -> None:
        """Gives new, distinct hashes the next numbers."""
        import numpy as np

        numbers = np.arange(self.count, self.count + len(hashes))
        slot = (hashes * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - self.bits)).astype(np.int64)
        left = np.arange(len(hashes))
        while len(left):
            free = left[self.keys[slot[left]] == 0]
            self.keys[slot[free]] = hashes[free]
            won = free[self.keys[slot[free]] == hashes[free]]
            self.where[slot[won]] = numbers[won]
            left = left[self.keys[slot[left]] != hashes[left]]
            slot[left] = slot[left] + 1 & (1 << self.bits) - 1

    def add(self, hashes, raw: list[bytes]) -> None:
        import numpy as np

        ids = [b"" if p == b"\0" else None for p in raw]
        new = self.encode([p.decode() for p, i in zip(raw, ids, strict=True) if i is None])
        new.reverse()
        ids = [new.pop() if i is None else i for i in ids]
        if (self.count + len(raw)) * 2 > 1 << self.bits:
            raise OverflowError("too many pieces")
        self.place(hashes)
        n = self.count
        self.byte_ends, begin = grown(self.byte_ends, n + len(raw) + 1), int(self.byte_ends[n])
        self.byte_ends[n + 1 : n + len(raw) + 1] = begin + np.cumsum([len(p) for p in raw])
        self.bytes = grown(self.bytes, int(self.byte_ends[n + len(raw)]))
        self.bytes[begin : self.byte_ends[n + len(raw)]] = np.frombuffer(b"".join(raw), dtype=np.uint8)
        self.id_ends, begin = grown(self.id_ends, n + len(raw) + 1), int(self.id_ends[n])
        self.id_ends[n + 1 : n + len(raw) + 1] = begin + np.cumsum([len(p) // 4 for p in ids])
        self.stored = grown(self.stored, int(self.id_ends[n + len(raw)]))
        self.stored[begin : self.id_ends[n + len(raw)]] = np.frombuffer(b"".join(ids), dtype="<u4")
        self.count += len(raw)

    def many(self, texts: list[str | None]) -> list:
        """An array of uint32 for each text."""
        import numpy as np

        out: list = [None] * len(texts)
        group, size = [], 0
        for i, text in enumerate(texts):
            if text and len(text) > GROUP_BYTES:
                out[i] = np.concatenate([self.part(p) for p in long_parts(text)])
            elif text and odd(text):
                out[i] = self.one(text)
            else:
                raw = (text or "").encode()
                if group and size + len(raw) > GROUP_BYTES:
                    self.solve(group, out)
                    group, size = [], 0
                group.append((i, raw))
                size += len(raw) + 1
        if group:
            self.solve(group, out)
        return out

    def part(self, text: str):
        if odd(text):
            return self.one(text)
        out: list = [None]
        self.solve([(0, text.encode())], out)
        return out[0]

    def one(self, text: str):
        import numpy as np

        return np.frombuffer(self.slow.ids(text), dtype="<u4")

    def solve(self, group: list[tuple[int, bytes]], out: list) -> None:
        import numpy as np

        kinds, powers, inverse = byte_classes()
        whole = b"\0" + b"\0".join(raw for _, raw in group) + b"\0"
        if len(whole) > len(powers):
            for i, raw in group:
                out[i] = self.one(raw.decode())
            return
        whole = self.prepared(whole)
        b = np.frombuffer(whole, dtype=np.uint8)
        kind = kinds[b]
        if not whole.isascii():
            latin = np.flatnonzero(b == 0xC3)  # Latin-1 letters; the two signs among them are OTHER
            latin = latin[(b[latin + 1] != 0x97) & (b[latin + 1] != 0xB7)]
            kind[latin] = kind[latin + 1] = LETTER
        white = kind == WHITE
        left, right = kind[:-1], kind[1:]
        cut = np.empty(len(b) + 1, dtype=bool)
        cut[0] = cut[-1] = True
        inner = cut[1:-1]
        np.not_equal(left, right, out=inner)
        inner &= (left != OTHER) & (right != OTHER) | white[1:]  # known classes; all before white space
        inner &= ~((b[:-1] == 39) & (right == LETTER))
        inner |= (left == EDGE) | (right == EDGE)
        after = white[:-1] & ~white[1:] & (right != EDGE)  # from white space to a word
        single = (b[:-1] != 32) & ~np.concatenate(([False], white[:-2]))
        inner &= ~after | single
        inner |= after & single
        starts = np.flatnonzero(cut)
        starts, ends = starts[:-1], starts[1:]
        with np.errstate(over="ignore"):
            total = np.zeros(len(b) + 1, dtype=np.uint64)
            np.cumsum((b.astype(np.uint64) + np.uint64(1)) * powers[: len(b)], out=total[1:])
            hashes = (total[ends] - total[starts]) * inverse[starts]
        hashes[hashes == 0] = 1
        at = self.find(hashes)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new, first = np.unique(hashes[missing], return_index=True)
            if (self.count + len(new)) * 2 > 1 << self.bits or self.byte_ends[self.count] > self.kept_bytes:
                self.clear()
                new, first = np.unique(hashes, return_index=True)
                missing = np.arange(len(hashes))
            spans = zip(starts[missing[first]].tolist(), ends[missing[first]].tolist(), strict=True)
            self.add(new, [whole[s:e] for s, e in spans])
            at = self.find(hashes)
        begins, lengths = self.byte_ends[at], self.byte_ends[at + 1] - self.byte_ends[at]
        same = (lengths == ends - starts).all() and (self.bytes[np.repeat(begins - starts, lengths) + np.arange(len(b))] == b).all()
        if not same:  # two pieces with one hash: the texts are encoded the plain way
            for i, raw in group:
                out[i] = self.one(raw.decode())
            return
        lengths = self.id_ends[at + 1] - self.id_ends[at]
        upto = np.concatenate(([0], np.cumsum(lengths)))
        ids = self.stored[np.repeat(self.id_ends[at] - upto[:-1], lengths) + np.arange(upto[-1])]
        edges = upto[np.flatnonzero(kind[starts] == EDGE)]
        for (i, _), begin, end in zip(group, edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            out[i] = ids[begin:end]


class WordTable(PieceTable):
    """The same for the lower-case vocabulary, which drops white space: its pattern begins a
    new word at all those places, too. ASCII letters are looked up in lower case, but not
    before other characters, with which they may be composed first."""

    plain = WordCache
    word = staticmethod(WordCache.word)

    def prepared(self, whole: bytes) -> bytes:
        import numpy as np

        lower = whole.lower()
        if whole.isascii():
            return lower
        was, now = np.frombuffer(whole, dtype=np.uint8), np.frombuffer(lower, dtype=np.uint8).copy()
        kept = np.flatnonzero(was[1:] > 127)
        now[kept] = was[kept]
        return now.tobytes()


def grown(array, size: int):
    """``array``, or a copy of at least ``size`` places."""
    import numpy as np

    if size <= len(array):
        return array
    more = np.zeros(max(size, 2 * len(array)), dtype=array.dtype)
    more[: len(array)] = array
    return more


def grouped(batches: Iterator, id_at: int = 0, text_at: int = 1) -> Iterator[tuple[list, list]]:
    """(ids, texts) of Arrow batches, in groups of about ``GROUP_BYTES``."""
    for batch in batches:
        begin, texts = 0, batch.column(text_at)
        while begin < batch.num_rows:
            end, size = begin, 0
            while end < batch.num_rows and (end == begin or size < GROUP_BYTES):
                value = texts[end]
                size += value.as_buffer().size if value.is_valid else 0
                end += 1
            yield batch.column(id_at).slice(begin, end - begin).to_pylist(), texts.slice(begin, end - begin).to_pylist()
            begin = end


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def library_encoder(path: str, kind: type = PieceCache) -> PieceCache:
    """Pieces encoded by the tokenizers library with the vocabulary at ``path``."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()

    special = {i: t.content for i, t in tokenizer.get_added_tokens_decoder().items() if t.special and not (t.lstrip or t.rstrip or t.single_word or t.normalized)}
    mark, between = min(special.items(), default=(None, ""))
    model = tokenizer.model

    def encode(pieces: list[str]) -> list[bytes]:
        words = list(map(kind.word, pieces))
        rest = iter(joined([p for p, w in zip(pieces, words, strict=True) if w is None]))
        return [next(rest) if w is None else array("I", [t.id for t in model.tokenize(w)]).tobytes() for w in words]

    def joined(pieces: list[str]) -> list[bytes]:
        # one call for all: pieces on either side of a special token don't meet
        text = between.join(pieces)
        if not between or text.count(between) != len(pieces) - 1:
            return [array("I", e.ids).tobytes() for e in tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        ids = tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
        raw, begin, out = array("I", ids).tobytes(), 0, []
        while True:
            try:
                end = ids.index(mark, begin)
            except ValueError:
                return [*out, raw[4 * begin :]]
            out.append(raw[4 * begin : 4 * end])
            begin = end + 1

    return kind(encode)


def library_table(path: str) -> PieceTable:
    return library_encoder(path, PieceTable)


def texts_of(batches: Iterator, id_at: int = 0, text_at: int = 1) -> Iterator[tuple[int | None, str | None]]:
    """(id, text) of Arrow batches, one row at a time, so that one batch's texts
    exist as Python strings only while they are used."""
    for batch in batches:
        ids, texts = batch.column(id_at), batch.column(text_at)
        for i in range(batch.num_rows):
            yield ids[i].as_py(), texts[i].as_py()
