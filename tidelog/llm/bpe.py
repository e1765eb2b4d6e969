"""Byte-level BPE over whole batches of texts at once.

A text is cut into pre-tokens by rules on character classes, computed for a batch of texts in arrays. Each
distinct pre-token is encoded once per task and its ids are kept in a hash table; the ids of a text are
gathered from there. Every pre-token found by its hash is compared with the one that was kept, character by character, so two
that share a hash get ids of their own. The vocabulary comes from a tokenizer file of the `tokenizers` library. Texts that hold one of
its special tokens go to that library itself.
"""

from __future__ import annotations

import json
from functools import cache

import numpy as np
import regex
import tiktoken
from tokenizers import Tokenizer

from tidelog.llm.common import ragged

#: Fixed value: the pre-token pattern of this family of tokenizers.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
SPACE, LETTER, NUMBER, OTHER, END = range(5)
#: Distinct pre-tokens and their ids that a task keeps before it starts anew.
MAX_WORDS = 1 << 19
MAX_IDS = 1 << 23
#: Bytes of text that are encoded at once, unless one text is longer.
PIECE = 1 << 19


@cache
def classes() -> np.ndarray:
    """The class of every code point."""
    table = np.full(0x110000, OTHER, np.uint8)
    text = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, text):
            table[ord(m[0][0]) : ord(m[0][-1]) + 1] = kind if ord(m[0][-1]) - ord(m[0][0]) + 1 == len(m[0]) else table[ord(m[0][0]) : ord(m[0][-1]) + 1]
            if ord(m[0][-1]) - ord(m[0][0]) + 1 != len(m[0]):
                table[[ord(c) for c in m[0]]] = kind
    return table


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones stand for themselves,
    the others follow from 256 in their order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least the first n powers of an odd base and of its inverse, modulo 2**64. One table serves all callers."""
    global _powers
    if len(_powers[0]) < n:
        base = 0x9E3779B97F4A7C15 | 1
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            out = np.full(n, b, np.uint64)
            out[0] = 1
            both.append(np.cumprod(out, dtype=np.uint64))
        _powers = both[0], both[1]
    return _powers


def hash_runs(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run values[start:end], from prefix sums."""
    up, down = powers(len(values) + 1)
    mixed = (values.astype(np.uint64) + np.uint64(0x632BE5AB)) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(mixed * up[: len(values)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    h += (ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def pretokens(points: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Where pre-tokens start, given code points and their classes. Each text is followed by a point of class END."""
    n = len(points)
    change = np.empty(n, bool)
    change[0] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:])
    start = change.copy()
    # After white space: its last character opens a pre-token, alone or, if a blank, with what follows.
    body = np.flatnonzero(change[1:] & (kind[:-1] == SPACE) & (kind[1:] != END)) + 1
    start[body - 1] = True
    start[body[points[body - 1] == 32]] = False
    # A single quote that is its whole run and is not preceded by a blank may open a contraction.
    quote = np.flatnonzero((points == 39) & change)
    quote = quote[quote + 1 < n]
    quote = quote[start[quote] & (kind[quote + 1] == LETTER)]
    if len(quote):
        wide = np.r_[points, [0, 0, 0]]
        for word in CONTRACTIONS:
            hit = quote
            for k, c in enumerate(word):
                hit = hit[wide[hit + 1 + k] == ord(c)]
            if len(hit):
                start[hit + 1] = False
                start[hit + 1 + len(word)] = True
                quote = np.setdiff1d(quote, hit)
    return start


class BatchEncoder:
    """Encodes lists of texts to ids as the tokenizer does with add_special_tokens=False."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        self.path, self._tokenizer = path, None
        self.special = [t["content"] for t in model["added_tokens"]]
        special = set(self.special)
        byte = byte_of()
        words = {bytes(byte[c] for c in w): i for w, i in model["model"]["vocab"].items() if w not in special}
        self.engine = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=words, special_tokens={})
        self.pieces = {i: w for w, i in words.items()} | {t["id"]: t["content"].encode() for t in model["added_tokens"]}
        self._clear()

    @property
    def tokenizer(self) -> Tokenizer:
        """The library's tokenizer, loaded when a text needs it."""
        if self._tokenizer is None:
            self._tokenizer = Tokenizer.from_file(self.path)
            self._tokenizer.no_truncation()
            self._tokenizer.no_padding()
        return self._tokenizer

    def _clear(self) -> None:
        self.keys = np.zeros(1 << 16, np.uint64)
        self.slot = np.full(1 << 16, -1, np.int64)
        self.count = 0
        self.begin, self.size = np.zeros(1 << 15, np.int64), np.zeros(1 << 15, np.int64)
        self.ids, self.used = np.zeros(1 << 17, np.int32), 0
        self.at, self.length = np.zeros(1 << 15, np.int64), np.zeros(1 << 15, np.int64)
        self.points, self.written = np.zeros(1 << 17, np.uint32), 0
        self.odd: dict[str, int] = {}

    def _find(self, h: np.ndarray) -> np.ndarray:
        """The number of each hashed word, -1 for unknown ones."""
        mask = np.uint64(len(self.keys) - 1)
        place = (h & mask).astype(np.int64)
        got = self.slot[place]
        wrong = np.flatnonzero((got >= 0) & (self.keys[place] != h))
        while len(wrong):
            place[wrong] = (place[wrong] + 1) & int(mask)
            got[wrong] = self.slot[place[wrong]]
            wrong = wrong[(got[wrong] >= 0) & (self.keys[place[wrong]] != h[wrong])]
        return got

    def _insert(self, h: np.ndarray, numbers: np.ndarray) -> None:
        mask = len(self.keys) - 1
        place = (h & np.uint64(mask)).astype(np.int64)
        todo = np.arange(len(h))
        while len(todo):
            free = todo[self.slot[place[todo]] < 0]
            self.slot[place[free]] = numbers[free]  # of those that want one place, one gets it
            won = free[self.slot[place[free]] == numbers[free]]
            self.keys[place[won]] = h[won]
            todo = todo[self.slot[place[todo]] != numbers[todo]]
            place[todo] = (place[todo] + 1) & mask

    def _store(self, words: list[str], points: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Encodes new words, whose code points are given one after the other; their numbers."""
        encode = self.engine.encode_ordinary
        found = [encode(w) for w in words]
        size = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((i for x in found for i in x), np.int32, int(size.sum()))
        n = self.count + len(words)
        while n > len(self.begin):
            self.begin, self.size, self.at, self.length = (np.resize(x, 2 * len(x)) for x in (self.begin, self.size, self.at, self.length))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        while self.written + len(points) > len(self.points):
            self.points = np.resize(self.points, 2 * len(self.points))
        fresh = slice(self.count, n)
        self.begin[fresh], self.size[fresh] = self.used + np.cumsum(size) - size, size
        self.at[fresh], self.length[fresh] = self.written + np.cumsum(length) - length, length
        self.ids[self.used : self.used + len(flat)] = flat
        self.points[self.written : self.written + len(points)] = points
        self.used, self.written, self.count = self.used + len(flat), self.written + len(points), n
        return np.arange(fresh.start, n)

    def _learn(self, h: np.ndarray, words: list[str], points: np.ndarray, length: np.ndarray) -> None:
        numbers = self._store(words, points, length)
        if 2 * self.count > len(self.keys):
            old, before = self.keys[self.slot >= 0], self.slot[self.slot >= 0]
            cells = 4 << self.count.bit_length()
            self.keys, self.slot = np.zeros(cells, np.uint64), np.full(cells, -1, np.int64)
            self._insert(old, before)
        self._insert(h, numbers)

    def _other(self, number: np.ndarray, body: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Which of the words in `body`, one after the other, are not the kept ones of these numbers."""
        same = self.length[number] == length
        if not same.all():
            wrong = np.flatnonzero(~same)
            begin = np.cumsum(length) - length
            rest = np.flatnonzero(same)
            return np.union1d(wrong, rest[self._other(number[rest], body[ragged(begin[rest], length[rest])], length[rest])])
        unlike = np.flatnonzero(self.points[ragged(self.at[number], length)] != body)
        return np.unique(np.searchsorted(np.cumsum(length), unlike, "right"))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after the other, and the texts' limits in them."""
        odd = [i for i, t in enumerate(texts) if any(s in t for s in self.special)] if any(s in "".join(texts) for s in self.special) else []
        if odd:
            own = {i: np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, np.int32) for i in odd}
            ids, ends = self._plain(["" if i in own else t for i, t in enumerate(texts)])
            parts = [own.get(i, ids[ends[i] : ends[i + 1]]) for i in range(len(texts))]
            return np.concatenate(parts), np.r_[0, np.cumsum([len(p) for p in parts])]
        return self._plain(texts)

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not texts:
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        whole = "\0".join(texts) + "\0"
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        stops = np.cumsum(size + 1) - 1
        kind = classes()[points]
        kind[stops] = END
        start = np.flatnonzero(pretokens(points, kind))
        end = np.r_[start[1:], len(points)]
        real = kind[start] != END
        text_of = np.searchsorted(stops, start[real])
        start, end = start[real], end[real]
        length = end - start
        body = points[kind != END]
        h = hash_runs(points, start, end)
        number = self._find(h)
        new = np.flatnonzero(number < 0)
        if len(new):
            if self.count + len(new) > MAX_WORDS or self.used > MAX_IDS or self.written > MAX_IDS:
                self._clear()
                new = np.arange(len(h))
            keys, first = np.unique(h[new], return_index=True)
            at = new[first]
            self._learn(keys, [whole[a:b] for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)], points[ragged(start[at], length[at])], length[at])
            number = self._find(h)
        other = self._other(number, body, length)
        if len(other):
            # Another word has this one's hash: it is known by itself.
            words = [whole[a:b] for a, b in zip(start[other].tolist(), end[other].tolist(), strict=True)]
            fresh = {w: i for w, i in zip(reversed(words), reversed(other.tolist()), strict=True) if w not in self.odd}
            at = np.fromiter(fresh.values(), np.int64, len(fresh))
            self.odd.update(zip(fresh, self._store(list(fresh), points[ragged(start[at], length[at])], length[at]).tolist(), strict=True))
            number[other] = [self.odd[w] for w in words]
        count = self.size[number]
        ids = self.ids[ragged(self.begin[number], count)]
        per_text = np.bincount(text_of, count, len(texts)).astype(np.int64)
        return ids, np.r_[0, np.cumsum(per_text)]

    @property
    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes of all tokens, and by id where a token's bytes start and how many they are."""
        if not hasattr(self, "_table"):
            top = max(self.pieces) + 1
            size = np.array([len(self.pieces.get(i, b"")) for i in range(top)])
            data = np.frombuffer(b"".join(self.pieces.get(i, b"") for i in range(top)), np.uint8)
            self._table = data, np.cumsum(size) - size, size
        return self._table

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The UTF-8 of the texts decoded from ids, special tokens included; malformed bytes become U+FFFD."""
        data, begin, size = self.table
        count = size[ids]
        flat = data[ragged(begin[ids], count)].tobytes()
        stops = np.r_[0, np.cumsum(count)][ends]
        out = []
        for a, b in zip(stops[:-1].tolist(), stops[1:].tolist(), strict=True):
            piece = flat[a:b]
            out.append(piece.decode("utf-8", "replace").encode())
        return out


_encoders: dict[str, BatchEncoder] = {}


def encoder(path: str) -> BatchEncoder:
    """This process's encoder for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = BatchEncoder(path)
    return _encoders[path]
