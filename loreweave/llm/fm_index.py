"""FM-index over integer symbols: wavelet-tree ranks, batched backward search, sampled suffix positions."""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of text sorted by the ``depth`` symbols at least that begin there, by prefix doubling."""
    n = len(text)
    _, rank = np.unique(text, return_inverse=True)
    rank = rank.astype(np.int64) + 1
    size = 1
    order = np.argsort(rank, kind="stable")
    while size < depth:
        key = rank << 32
        key[: n - size] |= rank[size:]
        order = np.argsort(key)
        sorted_key = key[order]
        new = np.concatenate(([True], sorted_key[1:] != sorted_key[:-1]))
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        size *= 2
        if rank[order[-1]] == n:
            break
    return order


class Bits:
    """A compressed bit vector with rank: 64-bit blocks by number in a table of the distinct ones, and the count of ones
    before each block. Where the text repeats itself, most blocks are alike, and a number takes one or two bytes.
    """

    def __init__(self, bits: np.ndarray) -> None:
        n = len(bits)
        packed = np.packbits(bits, bitorder="little")
        words = np.zeros(n // 64 + 1, np.uint64)
        words.view(np.uint8)[: len(packed)] = packed
        self.before = np.zeros(len(words), np.int32)
        np.cumsum(np.bitwise_count(words[:-1]), dtype=np.int32, out=self.before[1:])
        self.table, block = np.unique(words, return_inverse=True)
        self.block = block.astype(np.min_scalar_type(len(self.table)))

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before place i."""
        w = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.table[self.block[w]] & low)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.table[self.block[i >> 6]] >> (i & 63).astype(np.uint64)) & np.uint64(1)


class WaveletTree:
    """Levels of bits from the highest; at each, zeros go left and ones right (levelwise layout)."""

    def __init__(self, symbols: np.ndarray) -> None:
        top = int(symbols.max()) if len(symbols) else 0
        self.depth = max(1, top.bit_length())
        self.levels: list[Bits] = []
        self.zeros: list[int] = []
        s = symbols
        for d in range(self.depth - 1, -1, -1):
            bit = ((s >> d) & 1).astype(bool)
            self.levels.append(Bits(bit))
            s = np.concatenate((s[~bit], s[bit]))
            self.zeros.append(int(len(bit) - bit.sum()))
        #: Where each symbol's path begins at the last level; it doesn't depend on the place that is asked for.
        self.start = np.zeros(1 << self.depth, np.int64)
        every = np.arange(1 << self.depth)
        for level, (bits, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            one = ((every >> (self.depth - 1 - level)) & 1).astype(bool)
            a = bits.rank(self.start)
            self.start = np.where(one, zeros + a, self.start - a)

    def rank(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often symbol stands before lo and before hi."""
        start = self.start[symbol]
        for level, (bits, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            one = ((symbol >> (self.depth - 1 - level)) & 1).astype(bool)
            b, c = bits.rank(lo), bits.rank(hi)
            lo = np.where(one, zeros + b, lo - b)
            hi = np.where(one, zeros + c, hi - c)
        return lo - start, hi - start

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at places i, and how often each stands before its place."""
        symbol, start = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
        for bits, zeros in zip(self.levels, self.zeros, strict=True):
            one = bits.get(i).astype(bool)
            a, b = bits.rank(start), bits.rank(i)
            symbol = symbol << 1 | one
            start = np.where(one, zeros + a, start - a)
            i = np.where(one, zeros + b, i - b)
        return symbol, i - start


class FMIndex:
    """Over symbols of at least 1; sorted deep enough for patterns of up to ``depth`` symbols.

    Suffixes that agree in that many symbols may stand in any order; no pattern that is allowed can tell them apart.
    """

    def __init__(self, text: np.ndarray, depth: int, every: int = 0, marks: np.ndarray | None = None) -> None:
        """every: keeps each so-many-th text place, for locate(); 0 keeps none. marks: whether to mark the suffix at each
        place of text, for marked(). Of the suffix order itself, nothing else is kept.

        locate() walks from suffix to suffix, so for it the order must be whole.
        """
        body = np.concatenate((text.astype(np.int64), [0]))
        self.n = len(body)
        order = suffix_order(body, len(body) if every else depth)
        self.tree = WaveletTree(body[order - 1])
        self.first = np.concatenate(([0], np.cumsum(np.bincount(body))))
        if every:
            kept = order % every == 0
            self.sampled = Bits(kept)
            self.samples = order[kept]
        if marks is not None:
            self.marks = Bits(np.append(marks, False)[order])

    def marked(self, row: np.ndarray) -> np.ndarray:
        return self.marks.get(row).astype(bool)

    def step(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the patterns with one more symbol in front."""
        a, b = self.tree.rank(symbol, lo, hi)
        return self.first[symbol] + a, self.first[symbol] + b

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of patterns, the rows of a matrix; zeros stand in front of shorter ones."""
        n = len(patterns)
        lo, hi = np.zeros(n, np.int64), np.full(n, self.n, np.int64)
        live = np.arange(n)
        for c in range(patterns.shape[1] - 1, -1, -1):
            live = live[(hi[live] > lo[live]) & (patterns[live, c] > 0)]
            if not len(live):
                break
            known = patterns[live, c] < len(self.first) - 1
            hi[live[~known]] = lo[live[~known]]
            live = live[known]
            lo[live], hi[live] = self.step(patterns[live, c], lo[live], hi[live])
        return lo, hi

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Text places of rows, by walking to the nearest sampled place in front."""
        row, steps, out = row.copy(), 0, np.zeros(len(row), np.int64)
        live = np.arange(len(row))
        while len(live):
            done = self.sampled.get(row[live]).astype(bool)
            hit = live[done]
            out[hit] = self.samples[self.sampled.rank(row[hit])] + steps
            live = live[~done]
            symbol, before = self.tree.access(row[live])
            row[live] = self.first[symbol] + before
            steps += 1
        return out
