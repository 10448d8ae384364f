"""Cut texts into units that a byte-level BPE encodes independently, and remember units' ids.

The pre-tokenising pattern never matches across a single blank or newline between two characters that are
not white space, nor from an ASCII letter or digit to ASCII punctuation or between letter and digit, nor
from punctuation (but the apostrophe of contractions) to a letter or digit. So a text's ids are the ids of
its units end to end. Cuts, look-ups and the output are numpy operations on a chunk of texts at once; a
unit of up to 15 bytes is its own exact 128-bit key in an open hash table, longer ones are keys of a
dictionary. The memory is bounded (``limit`` units) and only saves time: what it lacks is encoded again.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .rolling import U, mix

SHORT = 15  # bytes of a unit that fits a key, beside its length
LONG = 64  # longer units are not remembered
_BLANK, _LETTER, _DIGIT, _PUNCT, _QUOTE, _OTHER = range(6)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[33:127] = _PUNCT
_CLASS[48:58] = _DIGIT
_CLASS[65:91] = _CLASS[97:123] = _LETTER
_CLASS[39] = _QUOTE
_CLASS[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = _BLANK
#: True where a token ends between two classes, whatever stands around them.
_ENDS = np.zeros((6, 6), bool)
_ENDS[_LETTER, [_DIGIT, _PUNCT, _QUOTE]] = _ENDS[_DIGIT, [_LETTER, _PUNCT, _QUOTE]] = True
_ENDS[_PUNCT, [_LETTER, _DIGIT]] = _ENDS[_QUOTE, _DIGIT] = True
_ENDS = _ENDS.ravel()
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def classes(data: np.ndarray) -> np.ndarray:
    """The class of each byte; bytes of white space beyond ASCII are blank."""
    out = _CLASS[data]
    for lead, rest in ((0xC2, ((0x85,), (0xA0,))), (0xE1, ((0x9A, 0x80),)), (0xE2, (*((0x80, x) for x in (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)), (0x81, 0x9F))), (0xE3, ((0x80, 0x80),))):
        at = np.flatnonzero(data == lead)
        if not len(at):
            continue
        for tail in rest:
            hit = at[at + len(tail) < len(data)]
            for k, x in enumerate(tail, 1):
                hit = hit[data[hit + k] == x]
            for k in range(len(tail) + 1):
                out[hit + k] = _BLANK
    return out


def cut(data: np.ndarray, offsets: np.ndarray, whole: tuple[bytes, ...] = ()) -> np.ndarray:
    """Where units start, texts' own starts included. Nothing is cut inside a string of ``whole``."""
    n = len(data)
    start = np.zeros(n + 1, bool)
    if n:
        kind = classes(data)
        start[1:n] = _ENDS[kind[:-1] * 6 + kind[1:]]
        solid = kind != _BLANK
        single = np.zeros(n, bool)  # one blank between two solid bytes
        single[1:-1] = solid[:-2] & solid[2:]
        at = np.flatnonzero(single & ((data == 32) | (data == 10)))
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        at = at[~edge[at] & ~edge[at + 1]]
        start[at] = True
        start[at[data[at] == 10] + 1] = True
        raw = data.tobytes() if whole else b""
        for x in whole:
            p = raw.find(x)
            while p >= 0:
                start[p + 1 : p + len(x)] = False
                p = raw.find(x, p + 1)
        start[offsets] = True
    return np.flatnonzero(start[:n])


def _grown(a: np.ndarray, n: int) -> np.ndarray:
    if n <= len(a):
        return a
    out = np.zeros(max(n, len(a) * 3 // 2), a.dtype)
    out[: len(a)] = a
    return out


class Units:
    """``encode_many(units)`` gives the ids of all units end to end (uint32) and how many each has.

    Up to ``limit`` units stay; the first that come do, which in natural text are the frequent ones.
    """

    def __init__(self, encode_many: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], limit: int = 1 << 20, whole: tuple[bytes, ...] = ()):
        self.encode_many, self.limit, self.whole = encode_many, limit, whole
        self.bits = max(4, int(2 * limit - 1).bit_length())
        self.low, self.high = (np.zeros(1 << self.bits, np.uint64) for _ in range(2))
        self.unit = np.full(1 << self.bits, -1, np.int32)
        self.long: dict[bytes, int] = {}
        self.n = self.n_ids = 0
        self.first, self.count, self.ids = np.zeros(1 << 10, np.int64), np.zeros(1 << 10, np.int64), np.zeros(1 << 12, np.uint32)

    def _slot(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return (mix(low ^ mix(high)) >> U(64 - self.bits)).astype(np.int64)

    def _find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Numbers of the units with these keys, -1 where there is none."""
        out = np.full(len(low), -1, np.int64)
        todo, slot = np.arange(len(low)), self._slot(low, high)
        while len(todo):
            unit = self.unit[slot]
            hit = (self.low[slot] == low[todo]) & (self.high[slot] == high[todo])
            out[todo[hit]] = unit[hit]
            go = ~hit & (unit >= 0)
            todo, slot = todo[go], (slot[go] + 1) & (len(self.unit) - 1)
        return out

    def _put(self, low: np.ndarray, high: np.ndarray, unit: np.ndarray) -> None:
        todo, slot = np.arange(len(low)), self._slot(low, high)
        while len(todo):
            free = self.unit[slot] < 0
            self.unit[slot[free]] = unit[todo[free]]  # of several that want a slot the last gets it
            won = self.unit[slot] == unit[todo]
            self.low[slot[won]], self.high[slot[won]] = low[todo[won]], high[todo[won]]
            todo, slot = todo[~won], (slot[~won] + 1) & (len(self.unit) - 1)

    def _add(self, units: list[bytes]) -> np.ndarray:
        """Encodes new units; their numbers."""
        ids, count = self.encode_many(units)
        n, m = self.n + len(units), self.n_ids + len(ids)
        self.first, self.count, self.ids = _grown(self.first, n), _grown(self.count, n), _grown(self.ids, m)
        self.ids[self.n_ids : m] = ids
        self.count[self.n : n] = count
        self.first[self.n : n] = self.n_ids + np.cumsum(count) - count
        made = np.arange(self.n, n)
        self.n, self.n_ids = n, m
        return made

    def encode(self, data: np.ndarray, offsets: np.ndarray, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end and their offsets; ``end`` is put after each text."""
        offsets = offsets - offsets[0]
        s = cut(data, offsets, self.whole)
        size = np.diff(np.append(s, len(data)))
        raw = data.tobytes() + bytes(16)
        number = np.empty(len(s), np.int64)
        short, long = np.flatnonzero(size <= SHORT), np.flatnonzero(size > SHORT)

        word = np.ndarray(len(data) + 8, "<u8", raw, strides=(1,))
        low = word[s[short]] & _MASK[np.minimum(size[short], 8)]
        high = word[s[short] + 8] & _MASK[np.maximum(size[short] - 8, 0)] | size[short].astype(np.uint64) << U(56)
        number[short] = found = self._find(low, high)
        new = np.flatnonzero(found < 0)
        new = new[np.lexsort((high[new], low[new]))]
        one = np.ones(len(new), bool)
        one[1:] = (low[new[1:]] != low[new[:-1]]) | (high[new[1:]] != high[new[:-1]])
        which = new[one]
        units = [raw[a : a + b] for a, b in zip(s[short[which]].tolist(), size[short[which]].tolist(), strict=True)]
        stay = min(len(which), self.limit - self.n)  # the first of them are remembered

        names = [raw[a : a + b] for a, b in zip(s[long].tolist(), size[long].tolist(), strict=True)]
        extra = [x for x in dict.fromkeys(names) if x not in self.long]
        extra.sort(key=lambda x: len(x) > LONG)
        if stay == len(which):  # short ones come first, then long ones while there is room
            keep = min(self.limit - self.n - stay, sum(len(x) <= LONG for x in extra))
        else:
            keep = 0
        made = self._add(units + extra)
        mark = (int(made[stay + keep]), int(self.first[made[stay + keep]])) if stay + keep < len(made) else (self.n, self.n_ids)
        self._put(low[which[:stay]], high[which[:stay]], made[:stay])
        number[short[new]] = made[np.cumsum(one) - 1]
        here = dict(zip(extra, made[len(units) :].tolist(), strict=True))
        number[long] = [here[x] if x in here else self.long[x] for x in names]
        self.long.update(zip(extra[:keep], made[len(units) : len(units) + keep].tolist(), strict=True))

        texts = np.searchsorted(s, offsets)  # each text's first unit
        if end is not None:
            number = np.insert(number, texts[1:], -1)
            texts = texts + np.arange(len(offsets))
        many = np.where(number >= 0, self.count[number], 1)
        stop = np.concatenate([[0], np.cumsum(many)])
        out = self.ids[np.repeat(self.first[number] - stop[:-1], many) + np.arange(stop[-1])] if len(many) else np.zeros(0, np.uint32)
        if end is not None:
            out[stop[texts[1:]] - 1] = end
        self.n, self.n_ids = mark  # what is not remembered goes
        return out, stop[texts]
