"""Benchmark decontamination by an FM-index per training shard."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreweave.llm.anchors import word_codes, word_spans
from loreweave.llm.common import documents, materialise, row_struct, text_bytes, text_slices, with_row
from loreweave.llm.fm_index import FMIndex

#: Word characters after lower-casing: digits, a-z and all bytes of characters beyond ASCII.
_WORDY = np.zeros(256, bool)
_WORDY[48:58] = _WORDY[97:123] = _WORDY[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_AZ = {i: i + 32 for i in range(65, 91)}
SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
#: Each text place whose number is a multiple of this keeps its suffix position.
EVERY = 8


def words_of(text: str) -> list[bytes]:
    return [w.encode() for w in _WORD.findall(text.translate(_AZ))]


class Phrases:
    """The distinct windows of some benchmark items, as rows of symbols, and the items of each."""

    def __init__(self, items: list[tuple[int | None, str]], window: int) -> None:
        found: dict[tuple[bytes, ...], set[int | None]] = {}
        for item, text in items:
            words = words_of(text)
            for i in range(max(1, len(words) - window + 1) if words else 0):
                found.setdefault(tuple(words[i : i + window]), set()).add(item)
        vocabulary = sorted({w for p in found for w in p})
        self.lengths = np.array([len(p) for p in found], np.int64)
        self.items = [list(x) for x in found.values()]
        raw = np.frombuffer(b"".join(vocabulary), np.uint8)
        n = np.array([len(w) for w in vocabulary], np.int64)
        codes = word_codes(raw, np.cumsum(n) - n, n) if vocabulary else np.empty(0, np.uint64)
        order = np.argsort(codes)
        self.codes = codes[order]
        symbol = {vocabulary[j]: i + 2 for i, j in enumerate(order.tolist())}
        self.rows = np.zeros((len(found), window), np.int64)
        for i, p in enumerate(found):
            self.rows[i, window - len(p) :] = [symbol[w] for w in p]

    def symbols(self, codes: np.ndarray) -> np.ndarray:
        """1 for words that no phrase has."""
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where(self.codes[at] == codes, at + 2, 1)


def _split(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, word starts, word lengths, and the first word of each document."""
    low = _LOWER[raw]
    return low, *word_spans(_WORDY[low], offsets)


def hits(raw: np.ndarray, offsets: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[set[int | None]], np.ndarray, np.ndarray]:
    """Of a shard: words and hit words of each document, the hit words, items of each document, word starts and ends.

    Only runs of phrase words that are as long as the shortest phrase are indexed; nothing can occur elsewhere.
    """
    low, starts, lengths, bounds = _split(raw, offsets)
    n_docs = len(offsets) - 1
    items: list[set[int | None]] = [set() for _ in range(n_docs)]
    depth = np.zeros(len(starts) + 1, np.int64)
    if len(starts) and len(phrases.lengths):
        symbol = phrases.symbols(word_codes(low, starts, lengths))
        known = symbol > 1
        doc_first = np.zeros(len(starts), bool)
        doc_first[bounds[:-1][bounds[:-1] < len(starts)]] = True
        run_start = np.flatnonzero(known & (doc_first | ~np.concatenate(([False], known[:-1]))))
        run_end = np.flatnonzero(known & np.concatenate((doc_first[1:] | ~known[1:], [True]))) + 1
        long_enough = run_end - run_start >= phrases.lengths.min()
        run_start, run_len = run_start[long_enough], (run_end - run_start)[long_enough]
        if len(run_start):
            at = np.cumsum(run_len + 1) - run_len - 1
            text = np.ones(int(at[-1] + run_len[-1] + 1), np.int64)
            place = np.repeat(run_start, run_len) + np.arange(int(run_len.sum())) - np.repeat(np.cumsum(run_len) - run_len, run_len)
            spot = np.repeat(at, run_len) + np.arange(int(run_len.sum())) - np.repeat(np.cumsum(run_len) - run_len, run_len)
            text[spot] = symbol[place]
            word_at = np.zeros(len(text), np.int64)
            word_at[spot] = place
            index = FMIndex(text, phrases.rows.shape[1] + 1, EVERY)
            lo, hi = index.search(phrases.rows)
            n = hi - lo
            which = np.repeat(np.arange(len(n)), n)
            row = np.repeat(lo, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            first = word_at[index.locate(row)]
            np.add.at(depth, first, 1)
            np.add.at(depth, first + phrases.lengths[which], -1)
            doc = np.searchsorted(bounds, first, side="right") - 1
            pairs = np.unique(np.stack((doc, which), 1), axis=0) if len(doc) else np.empty((0, 2), np.int64)
            for d, p in pairs.tolist():
                items[d].update(phrases.items[p])
    hit = np.cumsum(depth[:-1]) > 0
    n_hit = np.diff(np.concatenate(([0], np.cumsum(hit)))[bounds])
    return np.diff(bounds), n_hit, hit, items, starts, starts + lengths


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int, block_words: int, without_id: bool) -> Iterator[Phrases]:
    """The benchmark in blocks of a bounded number of words; rows without text are left out, and those without id unless ``without_id``."""
    rows = documents(benchmark, id_col, text_col).filter("text is not null" if without_id else "doc_id is not null and text is not null")
    block: list[tuple[int | None, str]] = []
    held = 0
    for r in rows.toLocalIterator():
        block.append((r[0], r[1]))
        held += (len(r[1]) + 1) // 2  # words at most
        if held >= block_words:
            yield Phrases(block, window)
            block, held = [], 0
    yield Phrases(block, window)


def sha_of_items(items: set[int | None]) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items - {None}))).encode()).hexdigest()


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    shard_mb: int = 8,
    block_words: int = 2_000_000,
    items_without_id: bool = False,
    spans: bool = False,
    carry: bool = False,
) -> DataFrame:
    """Finds words of documents that lie in any window of a benchmark item.

    A-Z are lower-cased; words are runs of digits, letters a-z and characters beyond ASCII. A window is ``window``
    consecutive words of an item; an item with fewer words, but not none, is one window. Every partition of documents
    is cut to shards; each builds an FM-index over its words and searches all windows backwards at once, locates
    occurrences by sampled suffix positions and merges them to spans. Items reach executors in blocks of
    ``block_words`` words, so the size of what is shipped is bounded; with more than one block, the passes are merged.

    Null or empty documents have no words. Items without text are left out; items that share an id count once.
    Rows of documents that share an id stay apart. Empty tables give empty results, or no hits. Other columns are
    ignored.

    items_without_id: whether items without id are searched for too. Their windows hit like others; all of them together
    count as one in n_items, and items_sha256 leaves them out. Otherwise they are left out.
    spans: adds the column spans, merged [begin, end) byte ranges to remove (array of struct).
    carry: adds the column row, a struct of all input columns.
    """
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), *([row_struct(docs)] if carry else []))
    schema = SCHEMA + (", spans array<struct<begin: long, end: long>>" if spans else "")
    passes = []
    blocks = _blocks(benchmark, item_id_col, item_text_col, window, block_words, items_without_id)
    phrases, ahead = next(blocks), next(blocks, None)
    merge = ahead is not None
    raw_schema = "row_id long, doc_id long, n_words long, items array<long>, begins array<long>, ends array<long>, word_begins array<long>, word_ends array<long>"
    while phrases is not None:
        shipped = docs.sparkSession.sparkContext.broadcast(phrases)

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            for shard in (b.slice(i, j - i) for b in batches for i, j in text_slices(b.column(1), shard_mb << 20)):
                ids = shard.column(0)
                raw, offsets = text_bytes(shard.column(1))
                n_words, n_hit, hit, items, starts, ends = hits(raw, offsets, shipped.value)
                out = {"doc_id": ids, "n_words": pa.array(n_words, pa.int64()), "n_hit": pa.array(n_hit, pa.int64()), "n_items": pa.array([len(x) for x in items], pa.int64()), "items_sha256": pa.array([sha_of_items(x) for x in items], pa.string()), "contaminated": pa.array(n_hit > 0)}
                if spans or merge:
                    ranges = _spans(hit, starts, ends, n_words, offsets)
                if spans:
                    out["spans"] = pa.array([[{"begin": a, "end": b} for _, _, a, b in x] for x in ranges], pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))
                if carry:
                    out["row"] = shard.column(2)
                yield pa.RecordBatch.from_pydict(out)

        def run_part(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            for shard in (b.slice(i, j - i) for b in batches for i, j in text_slices(b.column(1), shard_mb << 20)):
                raw, offsets = text_bytes(shard.column(1))
                n_words, _, hit, items, starts, ends = hits(raw, offsets, shipped.value)
                ranges = _spans(hit, starts, ends, n_words, offsets)
                big = pa.list_(pa.int64())
                yield pa.RecordBatch.from_pydict({
                    "row_id": shard.column(2), "doc_id": shard.column(0), "n_words": pa.array(n_words, pa.int64()), "items": pa.array([list(x) for x in items], big),
                    "begins": pa.array([[r[2] for r in x] for x in ranges], big), "ends": pa.array([[r[3] for r in x] for x in ranges], big), "word_begins": pa.array([[r[0] for r in x] for x in ranges], big), "word_ends": pa.array([[r[1] for r in x] for x in ranges], big),
                })

        if not merge:
            return source.mapInArrow(run, with_row(docs, schema) if carry else schema)
        if not passes:
            source = materialise(source.withColumn("row_id", F.monotonically_increasing_id()), "decontaminate-docs")
        passes.append(materialise(source.select("doc_id", "text", "row_id").mapInArrow(run_part, raw_schema), "decontaminate-pass"))
        shipped.destroy()  # the driver holds two blocks at most
        phrases, ahead = ahead, next(blocks, None)
    every = passes[0]
    for p in passes[1:]:
        every = every.unionByName(p)

    def join(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        items = set().union(*(r["items"] for r in rows))
        merged = [_merged(sorted(p for r in rows for p in zip(r[a], r[b], strict=True))) for a, b in (("word_begins", "word_ends"), ("begins", "ends"))]
        n_hit = sum(b - a for a, b in merged[0])
        out = {"row_id": rows[0]["row_id"], "doc_id": rows[0]["doc_id"], "n_words": rows[0]["n_words"], "n_hit": n_hit, "n_items": len(items), "items_sha256": sha_of_items(items), "contaminated": n_hit > 0}
        kinds = [("row_id", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_())]
        if spans:
            out["spans"] = [{"begin": a, "end": b} for a, b in merged[1]]
            kinds.append(("spans", pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))))
        return pa.Table.from_pylist([out], pa.schema(kinds))

    merged = every.groupBy("row_id").applyInArrow(join, "row_id long, " + schema)
    return (merged.join(source.select("row_id", "row"), "row_id") if carry else merged).drop("row_id")


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in ranges:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _spans(hit: np.ndarray, starts: np.ndarray, ends: np.ndarray, n_words: np.ndarray, offsets: np.ndarray) -> list[list[tuple[int, int, int, int]]]:
    """Of each document, its runs of hit words: word range and byte range."""
    out, at = [], 0
    for d, n in enumerate(n_words.tolist()):
        h = np.concatenate(([False], hit[at : at + n], [False]))
        a, b = np.flatnonzero(h[1:] & ~h[:-1]), np.flatnonzero(h[:-1] & ~h[1:])
        out.append([(x, y, int(starts[at + x] - offsets[d]), int(ends[at + y - 1] - offsets[d])) for x, y in zip(a.tolist(), b.tolist(), strict=True)])
        at += n
    return out


