"""Byte-level BPE ids by the tokenizers library, with a bounded cache of pieces.

The pre-tokenizer of a byte-level vocabulary cuts a text into pieces (a word with the space before
it, a number, a run of marks, a contraction, white space) that are encoded each on its own. Here the
cuts are found for many texts at once in numpy, each piece is looked up by a hash, and only pieces
not seen before go to the library. ids equal Tokenizer.encode(text, add_special_tokens=False).ids,
also for texts of one piece, of white space or with the strings of special tokens.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np

from .common import mix

U = np.uint64
CACHE = 1_000_000  # pieces kept, about 40 bytes each; a job whose Python workers live on beside others takes fewer
PART = 1 << 18  # characters that are cut at a time; longer texts are cut in parts
LONG = 64  # pieces of more characters are encoded each time instead of kept
OTHER, LETTER, NUMBER, SPACE, UNKNOWN = range(5)
# Contractions that are pieces of their own, and the characters of white space.
SHORT, LONGER = "stmd", ("re", "ve", "ll")
WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"


def kinds() -> np.ndarray:
    """Kind of every code point; those that Python's tables don't have, but the library's may, are unknown."""
    kind = {"L": LETTER, "N": NUMBER}
    named = {name: kind.get(name[0], OTHER) for name in "Lu Ll Lt Lm Lo Mn Mc Me Nd Nl No Pc Pd Ps Pe Pi Pf Po Sm Sc Sk So Zs Zl Zp Cc Cf Cs Co".split()} | {"Cn": UNKNOWN}
    out = np.fromiter(map(named.__getitem__, map(unicodedata.category, map(chr, range(0x110000)))), np.uint8, 0x110000)
    out[[ord(c) for c in WHITE]] = SPACE
    return out


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}


def piece_starts(code: np.ndarray, kind: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Places where a piece begins; first: whether a text begins there."""
    n = len(code)
    joined = np.zeros(n, bool)  # of one text with the place before
    joined[1:] = ~first[1:]
    start = ~joined
    start[1:] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    last = np.flatnonzero(space[:-1] & ~space[1:] & joined[1:])  # the last white space before something else
    start[last] = True
    start[last[code[last] == 32] + 1] = False  # a space belongs to what follows
    mark = np.flatnonzero((code[:-1] == 39) & start[:-1] & joined[1:] & (kind[1:] == LETTER))
    if len(mark):
        a = code[mark + 1]
        there = np.minimum(mark + 2, n - 1)
        b = np.where((mark + 2 < n) & joined[there], code[there], 0)
        size = np.where(np.isin(a, [ord(c) for c in SHORT]), 2, 0)
        for x, y in LONGER:
            size = np.where((a == ord(x)) & (b == ord(y)), 3, size)
        mark, size = mark[size > 0], size[size > 0]
        start[mark + 1] = False
        end = mark + size
        start[end[end < n]] = True
    return start


class Table:
    """64-bit keys and their numbers in open addressing; lookups and inserts of whole arrays."""

    def __init__(self, bits: int):
        self.bits = bits
        self.key, self.number, self.n = np.zeros(1 << bits, U), np.zeros(1 << bits, np.int32), 0

    def slots(self, key: np.ndarray) -> np.ndarray:
        return (key >> U(64 - self.bits)).astype(np.int64)

    def find(self, key: np.ndarray) -> np.ndarray:
        """Number of each key, -1 where it is new."""
        at = self.slots(key)
        have = self.key[at]
        out = np.where(have == key, self.number[at], -1)
        left = np.flatnonzero((have != key) & (have != 0))
        while len(left):
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
            have = self.key[at[left]]
            hit = have == key[left]
            out[left[hit]] = self.number[at[left[hit]]]
            left = left[~hit & (have != 0)]
        return out

    def add(self, key: np.ndarray, number: np.ndarray) -> None:
        """Distinct new keys."""
        at = self.slots(key)
        left = np.arange(len(key))
        while len(left):
            free = left[self.key[at[left]] == 0]
            self.key[at[free]] = key[free]  # of keys that meet in a slot the last one stays
            won = free[self.key[at[free]] == key[free]]
            self.number[at[won]] = number[won]
            left = left[self.key[at[left]] != key[left]]
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
        self.n += len(key)


class Encoder:
    """Ids of whole texts. At `cache` pieces the cache starts anew."""

    def __init__(self, path: str, cache: int = CACHE):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            how = json.load(f)
        cuts = how["pre_tokenizer"] or {}
        if how["normalizer"] or cuts.get("type") != "ByteLevel" or cuts["add_prefix_space"] or not cuts["use_regex"] or how["model"]["ignore_merges"]:
            raise ValueError("not a plain byte-level vocabulary")
        self.library = Tokenizer.from_file(path)
        self.model, self.letters = self.library.model, byte_letters()
        named = sorted((t.content for t in self.library.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, named))) if named else None
        self.type = np.uint16 if self.library.get_vocab_size() <= 1 << 16 else np.uint32
        self.kinds, self.cache = kinds(), cache
        r = np.random.default_rng(20240711)
        self.values = r.integers(1, 1 << 63, 0x110000, dtype=U) * U(2) + U(1)
        base = 0x5851F42D4C957F2D
        count = PART + LONG + 2
        self.up, self.down = (np.cumprod(np.concatenate([[U(1)], np.full(count, b, U)]), dtype=U) for b in (base, pow(base, -1, 1 << 64)))
        self.clear()

    def clear(self) -> None:
        self.table = Table(max(10, (2 * self.cache).bit_length()))
        self.starts, self.lengths = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.flat, self.used = np.zeros(4096, self.type), 0

    def encoded(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many of them each piece has), by the library's model."""
        tokenize, letters = self.model.tokenize, self.letters
        ids = [[t.id for t in tokenize(p.encode().decode("latin1").translate(letters))] for p in pieces]
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), self.type, int(n.sum())), n

    def keep(self, key: np.ndarray, pieces: list[str]) -> None:
        ids, n = self.encoded(pieces)
        first = self.table.n
        while first + len(pieces) > len(self.starts):
            self.starts, self.lengths = (np.concatenate([a, np.zeros_like(a)]) for a in (self.starts, self.lengths))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.starts[first : first + len(pieces)] = self.used + np.cumsum(n) - n
        self.lengths[first : first + len(pieces)] = n
        self.used += len(ids)
        self.table.add(key, np.arange(first, first + len(pieces), dtype=np.int32))

    def part(self, text: str, code: np.ndarray, kind: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, place of the piece of each id)."""
        at = np.flatnonzero(piece_starts(code, kind, first))
        end = np.append(at[1:], len(code))
        prefix = np.zeros(len(code) + 1, U)
        if len(code) > len(self.up):
            self.up, self.down = (np.cumprod(np.concatenate([[U(1)], np.full(len(code), b, U)]), dtype=U) for b in (int(self.up[1]), int(self.down[1])))
        np.cumsum(self.values[code] * self.up[: len(code)], out=prefix[1:])
        key = mix((prefix[end] - prefix[at]) * self.down[at] + (end - at).astype(U)) | U(1)
        number = self.table.find(key)
        new = number < 0
        big = np.flatnonzero(new & (end - at > LONG))
        new[big] = False
        if new.any():
            where = np.flatnonzero(new)
            fresh, one = np.unique(key[where], return_index=True)
            one = where[one]
            self.keep(fresh, [text[a:b] for a, b in zip(at[one].tolist(), end[one].tolist(), strict=True)])
            number[where] = self.table.find(key[where])
        n = np.where(number >= 0, self.lengths[number], 0)
        if not len(big):
            ends = np.cumsum(n)
            take = np.repeat(self.starts[number] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)
            return self.flat[take], np.repeat(at, n)
        ids, own = self.encoded([text[a:b] for a, b in zip(at[big].tolist(), end[big].tolist(), strict=True)])
        source = self.starts[number]
        n[big], source[big] = own, len(self.flat) + np.cumsum(own) - own
        ends = np.cumsum(n)
        take = np.repeat(source - ends + n, n) + np.arange(ends[-1])
        return np.concatenate([self.flat, ids])[take], np.repeat(at, n)

    def together(self, text: str, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many of them each text has) of texts of `sizes` characters, joined."""
        if self.table.n > self.cache:
            self.clear()
        code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        kind, ends = self.kinds[code], np.cumsum(sizes)
        if (self.special and self.special.search(text)) or (kind == UNKNOWN).any():
            return self.apart(text, sizes)
        first = np.zeros(len(code) + 1, bool)
        first[ends - sizes] = True
        first = first[:-1]
        if not len(code):
            return np.zeros(0, self.type), np.zeros(len(sizes), np.int64)
        ids, place = self.part(text, code, kind, first)
        return ids, np.diff(np.searchsorted(place, np.concatenate([[0], ends])))

    def apart(self, text: str, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same where special tokens or unknown code points occur: the texts that hold any go to the library whole."""
        ids, at = [], 0
        for size in sizes.tolist():
            one = text[at : at + size]
            odd = (self.special and self.special.search(one)) or (self.kinds[np.frombuffer(one.encode("utf-32-le"), np.uint32)] == UNKNOWN).any()
            ids.append(np.array(self.library.encode(one, add_special_tokens=False).ids, self.type) if odd else self.together(one, np.array([size]))[0])
            at += size
        return np.concatenate(ids), np.array([len(x) for x in ids])

    def ids(self, text: str | None) -> np.ndarray:
        """Ids of one text of any length; a long one is cut in parts before single spaces between other characters."""
        text = text or ""
        if len(text) <= PART:
            return self.together(text, np.array([len(text)]))[0]
        if self.special and self.special.search(text):
            return self.apart(text, np.array([len(text)]))[0]
        out, at = [], 0
        while at < len(text):
            end, size = len(text), PART
            while at + size < len(text):
                cut = next((m.start() + 1 for m in re.finditer(r"\S (?=\S)", text[at + size - 4096 : at + size])), 0)
                if cut:
                    end = at + size - 4096 + cut
                    break
                size += PART
            out.append(self.together(text[at:end], np.array([end - at]))[0])
            at = end
        return np.concatenate(out)

    def column(self, texts) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids, how many of them each row has) for runs of rows of an Arrow column; nulls are empty."""
        i, held, size = 0, [], 0
        for k, cell in enumerate(texts):
            text = cell.as_py() or ""
            if held and size + len(text) > PART:
                yield i, *self.together("".join(held), np.array([len(t) for t in held]))
                i, held, size = k, [], 0
            if len(text) > PART:
                ids = self.ids(text)
                yield k, ids, np.array([len(ids)])
                i = k + 1
                continue
            held.append(text)
            size += len(text)
        if held:
            yield i, *self.together("".join(held), np.array([len(t) for t in held]))


def with_ends(ids: np.ndarray, sizes: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids as 32-bit numbers with end_id behind each text's, where each text now ends)."""
    ends = np.cumsum(sizes)
    return np.insert(ids.astype("<u4"), ends, end_id), ends + np.arange(1, len(sizes) + 1)


_open: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, cache: int = CACHE) -> Encoder:
    """One encoder for each Python worker, vocabulary and size of cache."""
    if (path, cache) not in _open:
        _open[path, cache] = Encoder(path, cache)
    return _open[path, cache]


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
