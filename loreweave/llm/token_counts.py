"""Token counts of a byte-level BPE tokenizer file, by heap-and-linked-list merging."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loreweave.llm.common import documents
from loreweave.llm.pretokens import Memo, byte_alphabet, split

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
#: Bytes, about, that a worker remembers pre-tokens in.
MEMO = 200 << 20
#: From so many bytes on, a pre-token's symbols are packed in arrays.
LONG = 512
#: Pairs that are looked up at once.
BLOCK = 1 << 20


def count_after_merges(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """How many symbols are left when no ranked pair is adjacent.

    A heap holds the ranked adjacent pairs by rank and place; symbols are a doubly linked list. The lowest rank, and of
    equal ones the leftmost, merges first. An entry whose symbols have changed since it was pushed is passed over.
    """
    n = len(symbols)
    if n < 2:
        return n
    text = symbols
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, i + 1, a, b) for i, (a, b) in enumerate(zip(text, text[1:], strict=False)) if (r := ranks.get((a, b))) is not None]
    heapify(heap)
    merges = 0
    while heap:
        _, i, j, a, b = heappop(heap)
        if after[i] != j or text[i] is not a or text[j] is not b:
            continue
        merged = a + b
        text[i], text[j] = merged, ""
        k = after[j]
        after[i], after[j] = k, -1
        merges += 1
        if k < n:
            before[k] = i
            if (r := ranks.get((merged, text[k]))) is not None:
                heappush(heap, (r, i, k, merged, text[k]))
        h = before[i]
        if h >= 0 and (r := ranks.get((text[h], merged))) is not None:
            heappush(heap, (r, h, i, text[h], merged))
    return n - merges


class Packed:
    """Merges of long pre-tokens in arrays: under 40 bytes for each byte.

    ordered: whether each symbol is made before a merge takes it, as in any file that was learned. Then a merge never makes
    room for one of a lower rank, and all places of a rank can be merged in one turn.
    """

    def __init__(self, ranks: dict[tuple[str, str], int], alphabet: list[str]) -> None:
        ids: dict[str, int] = {}
        of = lambda x: ids.setdefault(x, len(ids))
        self.byte = np.array([of(c) for c in alphabet], np.int32)
        pairs = sorted(ranks, key=ranks.__getitem__)
        self.left, self.right = (np.array([of(p[i]) for p in pairs], np.int64) for i in (0, 1))
        self.made = np.array([of(a + b) for a, b in pairs], np.int32)
        keys = self.left << 32 | self.right
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        first: dict[int, int] = {}
        for rank, made in enumerate(self.made.tolist()):
            first.setdefault(made, rank)
        self.ordered = all(first.get(x, -1) < r for r, two in enumerate(zip(self.left.tolist(), self.right.tolist(), strict=True)) for x in two)

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols, -1 if it has none."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], -1)

    def count(self, raw: bytes) -> int:
        """How many symbols are left when no ranked pair is adjacent.

        A heap holds the ranks that some place has; their places wait in arrays. The lowest rank is popped, and its places
        merge from left to right; of places that overlap, as in a run of one symbol, every other one. Symbols are a doubly
        linked list in arrays.
        """
        symbol = self.byte[np.frombuffer(raw, np.uint8)]
        n = len(symbol)
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        waiting: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def push(places: np.ndarray) -> None:
            """Places whose symbol has another behind it."""
            for i in range(0, len(places), BLOCK):
                some = places[i : i + BLOCK]
                rank = self.ranks_of(symbol[some], symbol[after[some]])
                some, rank = some[rank >= 0], rank[rank >= 0]
                order = np.argsort(rank, kind="stable")
                some, rank = some[order], rank[order]
                first = np.flatnonzero(np.concatenate(([True], rank[1:] != rank[:-1]))) if len(rank) else []
                for r, at in zip(rank[first].tolist(), np.split(some, first[1:]), strict=True) if len(rank) else ():
                    if r not in waiting:
                        heappush(heap, r)
                    waiting.setdefault(r, []).append(at.copy())

        for i in range(0, n - 1, BLOCK):
            push(np.arange(i, min(i + BLOCK, n - 1), dtype=np.int32))
        merges = 0
        while heap:
            r = heappop(heap)
            at = np.unique(np.concatenate(waiting.pop(r)))
            at = at[(symbol[at] == self.left[r]) & (after[at] < n)]
            at = at[symbol[after[at]] == self.right[r]]
            if self.left[r] == self.right[r] and len(at):
                start = np.concatenate(([True], after[at[:-1]] != at[1:]))
                place = np.arange(len(at))
                at = at[(place - np.maximum.accumulate(np.where(start, place, 0))) % 2 == 0]
            if not len(at):
                continue
            merges += len(at)
            gone = after[at]
            beyond = after[gone]
            symbol[at], symbol[gone], after[at] = self.made[r], -1, beyond
            inside = beyond < n
            before[beyond[inside]] = at[inside]
            near = before[at]
            push(np.unique(np.concatenate((at[inside], near[near >= 0]))))
        return n - merges


class Counter:
    """Counts tokens as a tokenizer file of the byte-level BPE kind gives them."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split_by = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or split_by["type"] != "ByteLevel" or split_by["add_prefix_space"] or spec["normalizer"]:
            raise ValueError(f"{path}: not a plain byte-level BPE tokenizer")
        if any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"{path}: an added token takes in more than its own string")
        pairs = (tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"])
        self.ranks = {p: i for i, p in enumerate(pairs)}
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        #: The library's default takes these strings inside a text as one token each.
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.alphabet = byte_alphabet()
        self.packed = Packed(self.ranks, self.alphabet)
        self.memo = Memo(lambda tokens: [self._one(t) for t in tokens], MEMO)

    def _one(self, pretoken: str) -> int:
        table, raw = self.alphabet, pretoken.encode()
        if len(raw) >= LONG and self.packed.ordered:
            return self.packed.count(raw)
        return count_after_merges([table[b] for b in raw], self.ranks)

    def count(self, text: str) -> int:
        if self.special is None or not self.special.search(text):
            return sum(self.memo.of(split(text)))
        parts = self.special.split(text)
        return len(parts) - 1 + sum(sum(self.memo.of(split(p))) for p in parts)


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """Tokens of every whole text, as counts only: initial symbols minus merges.

    tokenizer: path of a tokenizer file, on every executor. over_limit: whether there are more than ``limit`` tokens.
    A null text counts as empty, with 0 tokens; an empty table gives an empty result. Rows are independent, so
    repeated ids and other columns don't matter. A text of any length is counted whole; the largest part that is held
    beside it is one pre-token, at under 40 bytes for each of its bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(tokenizer)
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(1)]
            n = [c.count(t) for t in texts]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "n_bytes": pa.array([len(t.encode()) for t in texts], pa.int64()), "n_tokens": pa.array(n, pa.int64()), "over_limit": pa.array([x > limit for x in n])})

    return documents(docs, id_col, text_col).mapInArrow(run, SCHEMA)
