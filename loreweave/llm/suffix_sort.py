"""Multikey quicksort of suffixes, eight bytes to a character."""

from __future__ import annotations

import numpy as np

#: At and below so many suffixes, multikey quicksort hands over to a comparison sort.
SMALL = 512


class Suffixes:
    """The suffixes of some bytes, which can be sorted by up to ``deepest`` leading bytes."""

    def __init__(self, data: bytes, deepest: int) -> None:
        self.data = data
        self.eight = np.lib.stride_tricks.sliding_window_view(np.frombuffer(data + bytes(8 * (-(-deepest // 8) + 1)), np.uint8), 8)

    def sort(self, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorts the suffixes that begin at the given places by their first ``depth`` bytes.

        Around the character of a pivot, suffixes part into less, equal and greater; only the equal part goes on to
        the next character. Returns the order, and for each place in it whether the string there equals the one before.
        """
        data, eight, steps = self.data, self.eight, -(-depth // 8)
        last = np.uint64(0xFFFFFFFFFFFFFFFF) << np.uint64(8 * (-depth % 8))

        def character(idx: np.ndarray, d: int) -> np.ndarray:
            c = eight[at[idx] + 8 * d].view(">u8")[:, 0].astype(np.uint64)
            return c & last if d == steps - 1 else c

        order = np.arange(len(at))
        same = np.zeros(len(at), bool)
        todo: list[tuple[int, int, int, np.ndarray | None]] = [(0, len(at), 0, None)]
        while todo:
            lo, hi, d, c = todo.pop()
            n = hi - lo
            if n < 2:
                continue
            idx = order[lo:hi]
            if d == steps:
                same[lo + 1 : hi] = True
            elif n <= SMALL:
                keys = [data[p + 8 * d : p + depth] for p in at[idx].tolist()]
                by = sorted(range(n), key=keys.__getitem__)
                order[lo:hi] = idx[by]
                same[lo + 1 : hi] = [keys[x] == keys[y] for x, y in zip(by, by[1:], strict=False)]
            else:
                if c is None:
                    c = character(idx, d)
                some = c[:: max(1, n // 127)]
                pivot = np.partition(some, len(some) // 2)[len(some) // 2]
                less, more = np.flatnonzero(c < pivot), np.flatnonzero(c > pivot)
                a, b = len(less), n - len(more)
                order[lo:hi] = np.concatenate((idx[less], idx[np.flatnonzero(c == pivot)], idx[more]))
                todo += [(lo, lo + a, d, c[less]), (lo + a, lo + b, d + 1, None), (lo + b, hi, d, c[more])]
        return order, same


def equal_strings(data: bytes, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of strings that stand one behind another in data: which distinct string each is, and the first of each.

    Strings of one length are sorted; equal ones are neighbours then. Distinct strings are numbered as they first occur.
    """
    at = np.cumsum(lengths) - lengths
    suffixes = Suffixes(data, int(lengths.max(initial=0)))
    by = np.argsort(lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(lengths[by])) + 1
    found, n = np.empty(len(lengths), np.int64), 0
    for idx in np.split(by, cuts) if len(by) else ():
        order, same = suffixes.sort(at[idx], int(lengths[idx[0]]))
        found[idx[order]] = n + np.cumsum(~same) - 1
        n += int((~same).sum())
    first = np.full(n, len(lengths))
    np.minimum.at(first, found, np.arange(len(lengths)))
    rank = np.empty(n, np.int64)
    rank[np.argsort(first)] = np.arange(n)
    return rank[found], np.sort(first)
