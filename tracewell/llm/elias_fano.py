"""Elias-Fano sequences and an n-gram trie of three orders over them, in flat arrays that can be memory-mapped.

A non-decreasing sequence of n integers below u keeps floor(log2(u / n)) low bits of each packed, and the high parts as
unary gaps in a bit vector: about 2 + log2(u / n) bits each. All operations take arrays of queries; what selects bits is
expanded from the mapped words when a sequence is first asked, and lives as long as its reader.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np

U1 = np.uint64(1)
#: Code of what a trie does not have.
ABSENT = 255


def _places(words, bit: int):
    """Places of the bits that are `bit`, in order."""
    places = np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little") == bit)
    return places.astype(np.int32) if len(words) < 1 << 25 else places


class EliasFano:
    """Sequence built from sorted values, or from the arrays of another one."""

    NAMES = ("head", "low", "high")

    def __init__(self, head, low, high):
        self.head, self.low, self.high = head, low, high
        self.n, self.bits = int(head[0]), int(head[1])
        self.buckets = len(high) * 64 - self.n

    @classmethod
    def build(cls, values) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        bits = max(0, (top // max(1, n)).bit_length() - 1)
        lows = values & np.uint64((1 << bits) - 1)
        low = np.zeros((n * bits + 63) // 64 + 2, np.uint64)
        if bits and n:
            at = np.arange(n, dtype=np.int64) * bits
            word, off = at >> 6, (at & 63).astype(np.uint64)
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            low[word[first]] = np.bitwise_or.reduceat(lows << off, first)
            over = off + np.uint64(bits) > np.uint64(64)  # one value of each word at most
            low[word[over] + 1] |= lows[over] >> (np.uint64(64) - off[over])
        place = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        ones = np.zeros((((int(place[-1]) if n else 0) + 2 + 63) // 64 + 1) * 64, np.uint8)
        ones[place] = 1
        high = np.packbits(ones, bitorder="little").view(np.uint64)
        return cls(np.array([n, bits], np.int64), low, high)

    def arrays(self, prefix: str) -> dict:
        return {f"{prefix}_{k}": getattr(self, k) for k in self.NAMES}

    @classmethod
    def load(cls, arrays: dict, prefix: str) -> EliasFano:
        return cls(*(arrays[f"{prefix}_{k}"] for k in cls.NAMES))

    @cached_property
    def ones(self):
        """Select of set bits, expanded from the map when first asked for."""
        return _places(self.high, 1)

    @cached_property
    def zeros(self):
        return _places(self.high, 0)

    def _low(self, i):
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        at = i * self.bits
        word, off = at >> 6, (at & 63).astype(np.uint64)
        got = self.low[word] >> off
        spill = np.where(off > 0, self.low[word + 1] << (np.uint64(64) - np.maximum(off, U1)), np.uint64(0))
        return (got | spill) & np.uint64((1 << self.bits) - 1)

    def access(self, i):
        """Values at indices i."""
        i = np.asarray(i, np.int64)
        high = (self.ones[i] - i).astype(np.uint64)
        return (high << np.uint64(self.bits)) | self._low(i)

    def successor(self, x):
        """For each x the index of the first value that is not smaller (n if none), and whether it equals x."""
        x = np.asarray(x, np.uint64)
        bucket = (x >> np.uint64(self.bits)).astype(np.int64)
        at = np.full(len(x), self.n, np.int64)
        equal = np.zeros(len(x), bool)
        rows = np.flatnonzero(bucket < self.buckets - 1)
        b = bucket[rows]
        begin, end = np.zeros(len(rows), np.int64), self.zeros[b] - b
        inner = b > 0
        begin[inner] = self.zeros[b[inner] - 1] - (b[inner] - 1)
        want = x[rows] & np.uint64((1 << self.bits) - 1)
        lo, hi = begin.copy(), np.minimum(end, self.n)
        begin = hi.copy()
        while True:  # lower bound among the low parts of the bucket
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) >> 1
            less = self._low(mid) < want[open_]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
        at[rows] = lo
        inside = np.flatnonzero(lo < begin)
        equal[rows[inside]] = self._low(lo[inside]) == want[inside]
        return at, equal

    def nbytes(self) -> int:
        return self.low.nbytes + self.high.nbytes + self.head.nbytes


class Level:
    """Lists of rising numbers, one for each parent, found through monotone pointers.

    Numbers are stored relative to their parent: each list continues from the last value of the list before, so that the
    whole level is one increasing sequence; a look-up adds the number to that base and searches the successor.
    """

    def __init__(self, pointers: EliasFano, values: EliasFano):
        self.pointers, self.values = pointers, values

    @classmethod
    def build(cls, sizes, numbers) -> Level:
        """sizes: of the lists; numbers: those of all lists in turn."""
        sizes, numbers = np.asarray(sizes, np.int64), np.asarray(numbers, np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        last = numbers[starts[1:][sizes > 0] - 1] + 1
        base = np.zeros(len(sizes), np.int64)
        base[sizes > 0] = np.concatenate([[0], np.cumsum(last)[:-1]]) if len(last) else []
        return cls(EliasFano.build(starts), EliasFano.build(np.repeat(base, sizes) + numbers))

    def arrays(self, prefix: str) -> dict:
        return self.pointers.arrays(f"{prefix}_pointers") | self.values.arrays(f"{prefix}_values")

    @classmethod
    def load(cls, arrays: dict, prefix: str) -> Level:
        return cls(EliasFano.load(arrays, f"{prefix}_pointers"), EliasFano.load(arrays, f"{prefix}_values"))

    def begins(self, parents):
        """Where the lists of parents begin; 0 for -1."""
        out = np.zeros(len(parents), np.int64)
        known = np.flatnonzero(parents >= 0)
        out[known] = self.pointers.access(parents[known])
        return out

    def find(self, parents, many, numbers):
        """Index of each number in its parent's list, -1 if it is not there or the parent is -1; many: numbers of each parent in turn."""
        out = np.full(len(numbers), -1, np.int64)
        some = np.flatnonzero((parents >= 0) & (many > 0))
        begin, end, base = self.pointers.access(parents[some]).astype(np.int64), self.pointers.access(parents[some] + 1).astype(np.int64), np.zeros(len(some), np.uint64)
        later = begin > 0
        base[later] = self.values.access(begin[later] - 1) + U1
        rows = np.flatnonzero(np.repeat((parents >= 0) & (many > 0), many))
        which = np.repeat(np.arange(len(some)), many[some])
        wanted = np.asarray(numbers, np.int64)[rows]
        real = wanted >= 0
        rows, which, wanted = rows[real], which[real], wanted[real]
        at, equal = self.values.successor(base[which] + wanted.astype(np.uint64))
        hit = equal & (at >= begin[which]) & (at < end[which])
        out[rows[hit]] = at[hit]
        return out


class Trie:
    """Contexts v with their counts; words w after v; words u before v; words w after u v, by their place among those after v.

    Probabilities are codes of 8 bits: p2 of (v, w), what (u, v) leaves to the lower order, p3 of (u, v, w).
    """

    LEVELS, PLAIN = ("words", "befores", "triples"), ("totals", "p2", "rest", "p3")

    def __init__(self, contexts: EliasFano, levels: dict, plain: dict):
        self.contexts, self.levels, self.plain = contexts, levels, plain

    def arrays(self) -> dict:
        out = self.contexts.arrays("contexts")
        for k in self.LEVELS:
            out |= self.levels[k].arrays(k)
        return out | {k: self.plain[k] for k in self.PLAIN}

    @classmethod
    def load(cls, arrays: dict) -> Trie:
        return cls(EliasFano.load(arrays, "contexts"), {k: Level.load(arrays, k) for k in cls.LEVELS}, {k: arrays[k] for k in cls.PLAIN})

    def find(self, ids, many_words, words, many_befores, befores, many_triples, places):
        """(counts, p2, rest, p3) of what is asked for; ABSENT where the trie does not have it.

        ids: contexts; words and befores: 32-bit, in turn for each of them; places: for each of befores in turn, which of
        `words` follow it.
        """
        at, known = self.contexts.successor(ids)
        at = np.where(known, at, -1)
        counts = np.zeros(len(ids), np.int64)
        counts[known] = self.plain["totals"][at[known]]
        w = self.levels["words"].find(at, many_words, words)
        u = self.levels["befores"].find(at, many_befores, befores)
        begin = np.repeat(np.repeat(self.levels["words"].begins(at), many_befores), many_triples)
        place = np.where(w[places] >= 0, w[places] - begin, -1)
        x = self.levels["triples"].find(u, many_triples, place)
        code = lambda k, i: np.where(i >= 0, self.plain[k][np.maximum(i, 0)], ABSENT) if len(self.plain[k]) else np.full(len(i), ABSENT)
        return counts, code("p2", w).astype(np.uint8), code("rest", u).astype(np.uint8), code("p3", x).astype(np.uint8)
