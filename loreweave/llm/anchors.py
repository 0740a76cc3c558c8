"""Content-defined anchors: which positions of a text stand for its windows.

A window is a fixed number of units (bytes or words). Its anchor is the run of K units in it whose hash is least,
the leftmost on ties. Equal windows have equal anchors at equal offsets, wherever they stand, so windows need to be
compared only where anchors are equal, and one anchor stands for a whole run of windows.
"""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240229)
#: A random 64-bit code for each byte value, and odd multipliers.
BYTE_CODES = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MULTIPLIERS = _RNG.integers(1, 1 << 62, 16, dtype=np.uint64) * np.uint64(4) + np.uint64(3)
_BASE = np.uint64(0x9E3779B97F4A7C15)
BLOCK_UNITS = 1 << 17
#: Bytes of words that are hashed at once.
STEP_BYTES = 1 << 17


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    return h * np.uint64(0xBF58476D1CE4E5B9) ^ (h >> np.uint64(33))


def word_spans(wordy: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of runs of wordy bytes, none across documents: where they start, their lengths, and the first of each document.

    offsets: where documents begin, and the end.
    """
    brk = np.zeros(len(wordy) + 1, bool)
    brk[offsets] = True
    before = np.concatenate(([False], wordy[:-1]))
    starts = np.flatnonzero(wordy & (~before | brk[:-1]))
    after = np.concatenate((wordy[1:], [False]))
    ends = np.flatnonzero(wordy & (~after | brk[1:])) + 1
    return starts, ends - starts, np.searchsorted(starts, offsets)


def word_codes(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit code for each word, from its bytes and their places in it; works on STEP_BYTES bytes at a time."""
    out = np.empty(len(starts), np.uint64)
    if not len(starts):
        return out
    powers = np.cumprod(np.full(min(int(lengths.max()), STEP_BYTES), _BASE))
    total = np.cumsum(lengths)
    i = 0
    while i < len(starts):
        if lengths[i] > STEP_BYTES:
            out[i] = _long_code(raw[starts[i] : starts[i] + lengths[i]], powers)
            i += 1
            continue
        j = int(np.searchsorted(total, total[i] - lengths[i] + STEP_BYTES, side="right"))
        s, n = starts[i:j], lengths[i:j]
        ends = np.cumsum(n)
        within = np.arange(ends[-1]) - np.repeat(ends - n, n)
        v = BYTE_CODES[raw[np.repeat(s, n) + within]] * powers[within]
        out[i:j] = np.add.reduceat(v, ends - n)
        i = j
    return mix(out)


def _long_code(word: np.ndarray, powers: np.ndarray) -> int:
    whole, code = 1 << 64, 0
    for i in range(0, len(word), STEP_BYTES):
        part = word[i : i + STEP_BYTES]
        code += int((BYTE_CODES[part] * powers[: len(part)]).sum()) * pow(int(_BASE), i, whole)
    return code % whole


def gram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """A hash for each run of k codes; k is a power of two."""
    h, size, level = codes, 1, 0
    while size < k:
        h = h[:-size] * _MULTIPLIERS[level] + h[size:]
        size, level = size * 2, level + 1
    return mix(h)


def sliding_min(keys: np.ndarray, w: int) -> np.ndarray:
    size, m = 1, keys
    while size * 2 <= w:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    return np.minimum(m[: len(keys) - w + 1], m[w - size : len(keys) - size + 1]) if size < w else m


def find_anchors(codes: np.ndarray, bounds: np.ndarray, window: int, k: int) -> tuple[np.ndarray, ...]:
    """Anchors of all windows inside documents.

    bounds: where documents begin, and the end. Returns for each anchor, in the order of the text: its place, the
    first and the last window start that it stands for, and its 64-bit hash.
    """
    found: list[tuple[np.ndarray, ...]] = []
    i, n = 0, len(bounds) - 1
    while i < n:
        j = i + 1
        while j < n and bounds[j + 1] - bounds[i] <= BLOCK_UNITS:
            j += 1
        lo, hi = int(bounds[i]), int(bounds[j])
        if hi - lo >= window:
            h = gram_hashes(codes[lo:hi], k)
            place = np.arange(len(h), dtype=np.uint64)
            least = sliding_min((h & np.uint64(0xFFFFFFFF00000000)) | place, window - k + 1)
            inside = np.ones(hi - lo, bool)
            ends = bounds[i + 1 : j + 1] - lo
            back = np.minimum(window - 1, np.diff(bounds[i : j + 1]))
            cut = np.zeros(hi - lo + 1, np.int64)
            np.add.at(cut, ends - back, 1)
            np.add.at(cut, ends, -1)
            inside &= np.cumsum(cut[:-1]) == 0
            at = np.flatnonzero(inside)
            if len(at):
                anchor = (least[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
                new = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
                last = np.concatenate((new[1:] - 1, [len(at) - 1]))
                a = anchor[new]
                found.append((a + lo, at[new] + lo, at[last] + lo, h[a]))
        i = j
    if not found:
        return (*(np.empty(0, np.int64) for _ in range(3)), np.empty(0, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))
