"""Removal of repeated word windows by an FM-index per shard."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loreweave.llm import repeats
from loreweave.llm.anchors import word_codes
from loreweave.llm.common import chunked, documents, ids_out, materialise, total_bytes
from loreweave.llm.fm_index import FMIndex

SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"
#: Windows that search at once.
BATCH = 1 << 18


def matching_statistics(index: FMIndex, text: np.ndarray, ends: np.ndarray, caps: np.ndarray) -> np.ndarray:
    """For each end, how many symbols before it, its cap at most, occur twice or more.

    A suffix that the index marks counts as several. Search stops where only one occurrence is left.
    """
    out = np.zeros(len(ends), np.int64)
    for i in range(0, len(ends), BATCH):
        e, cap = ends[i : i + BATCH], caps[i : i + BATCH]
        lo, hi = np.zeros(len(e), np.int64), np.full(len(e), index.n, np.int64)
        live, length, t = np.arange(len(e)), np.zeros(len(e), np.int64), 0
        while len(live):
            t += 1
            lo, hi = index.step(text[e[live] - t], lo, hi)
            more = hi - lo > 1
            one = np.flatnonzero(hi - lo == 1)
            more[one] = index.marked(lo[one])
            length[live[more]] = t
            more &= cap[live] > t
            live, lo, hi = live[more], lo[more], hi[more]
        out[i : i + BATCH] = length
    return out


def repeated_windows(index: FMIndex, text: np.ndarray, base: np.ndarray, lengths: np.ndarray, window: int) -> np.ndarray:
    """Which windows of the segments occur again, in order of segment and start.

    A search from the end of a window goes on to the left as far as two occurrences are left. Every window inside what
    it has matched is repeated; every window that has all of it and the symbol before is single. So a search mostly
    decides a whole stretch. Undecided stretches are searched from their last window, then from their first, then from
    the middle.
    """
    n = lengths - window + 1
    first = np.cumsum(n) - n
    owner = np.repeat(np.arange(len(n)), n)
    within = np.arange(len(owner)) - first[owner]
    edge = np.append(within == 0, True)
    repeated, open_ = np.zeros(len(owner), bool), np.ones(len(owner), bool)
    turn = 0
    while open_.any():
        low = np.flatnonzero(open_ & (edge[:-1] | ~np.concatenate(([False], open_[:-1]))))
        high = np.flatnonzero(open_ & (edge[1:] | ~np.concatenate((open_[1:], [False]))))
        pick = (high, low, (low + high) // 2)[min(turn, 2)]
        seg, s = owner[pick], within[pick]
        reach = matching_statistics(index, text, base[seg] + s + window, s + window)
        p = s + window - reach
        again = np.zeros(len(owner) + 1, np.int64)
        single = np.zeros(len(owner) + 1, np.int64)
        long = reach >= window
        np.add.at(again, first[seg[long]] + p[long], 1)
        np.add.at(again, pick[long] + 1, -1)
        np.add.at(single, pick[~long], 1)
        np.add.at(single, first[seg[~long]] + np.minimum(p[~long], n[seg[~long]]), -1)
        again, single = np.cumsum(again[:-1]) > 0, np.cumsum(single[:-1]) > 0
        repeated |= again
        open_ &= ~(again | single)
        turn += 1
    return repeated


def _judge(window: int, buckets: int):
    def judge(b: repeats.Bucket) -> list[dict]:
        known: dict[bytes, int] = {}
        symbols: list[int] = []
        segments = b.segments()
        lengths = np.empty(len(segments), np.int64)
        for i, s in enumerate(segments):
            words = s.split(b" ")
            lengths[i] = len(words)
            symbols += [known.setdefault(x, len(known) + 2) for x in words]
            symbols.append(1)
        text = np.array(symbols, np.int64)
        del symbols, known
        base = np.cumsum(lengths + 1) - lengths - 1
        times = np.bincount(b.seg, b.times, len(lengths)).astype(np.int64)
        index = FMIndex(text, int(lengths.max()) + 1, marks=np.repeat(times > 1, lengths + 1))
        n_windows = lengths - window + 1
        owner = np.repeat(np.arange(len(lengths)), n_windows)
        within = np.arange(int(n_windows.sum())) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
        repeated = repeated_windows(index, text, base, lengths, window)
        # every occurrence of a segment has the windows that are repeated in it
        per = np.add.reduceat(np.append(repeated, False), np.cumsum(n_windows) - n_windows)
        at = np.flatnonzero(repeated)
        first = np.cumsum(per) - per
        reps = per[b.seg]
        inner = np.arange(int(reps.sum())) - np.repeat(np.cumsum(reps) - reps, reps)
        rows = repeats.removals(np.repeat(b.chunk, reps), np.repeat(b.start, reps) + within[at[np.repeat(first[b.seg], reps) + inner]])
        # windows that may have equals beyond an end of the bucket; the repeated ones too, as there may be one more
        near = np.flatnonzero(b.like_end > 0)
        open_: list[tuple[int, int, bytes]] = []
        for g in near.tolist():
            words, end = segments[g].split(b" "), int(b.like_end[g] + b.anchors[g])
            ends = np.cumsum([len(x) + 1 for x in words])[window - 1 :] - 1
            open_ += [(g, j, b" ".join(words[j : j + window])) for j in np.flatnonzero(ends <= end).tolist()]
        if open_:
            occ = np.empty(len(lengths), np.int64)
            occ[b.seg] = np.arange(len(b.seg))
            g, j = (np.array(x, np.int64) for x in zip(*((g, j) for g, j, _ in open_), strict=True))
            again = repeated[(np.cumsum(n_windows) - n_windows)[g] + j]
            o = occ[g]
            rows += repeats.open_windows(repeats.window_hashes([x for *_, x in open_]), b.doc[o], b.chunk[o], b.start[o] + j, 1 + (again | (times[g] > 1)).astype(np.int64), buckets)
        return rows

    return judge


def _kept(text: repeats.Text, gone: np.ndarray) -> list[bytes]:
    """Kept words of each document, joined by one space."""
    lengths = text.ends - text.starts
    stay = ~gone
    keep = np.repeat(stay, lengths + 1)
    raw = text.raw[keep].tobytes()
    ends = np.concatenate(([0], np.cumsum((lengths + 1) * stay)))[text.bounds].tolist()
    return [raw[a : b - 1] if b > a else b"" for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _result(ids: pa.Array, text: repeats.Text, gone: np.ndarray) -> pa.Table:
    removed = np.diff(np.concatenate(([0], np.cumsum(gone)))[text.bounds])
    sha = [hashlib.sha256(x).hexdigest() for x in _kept(text, gone)]
    return pa.table({"doc_id": ids_out(ids), "n_words": pa.array(np.diff(text.bounds), pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(sha, pa.string())})


def _texts(ids: pa.Array, text: repeats.Text, gone: np.ndarray) -> pa.Table:
    return pa.table({"doc_id": ids_out(ids), "text": pa.array([x.decode() for x in _kept(text, gone)], pa.string())})


def substring_dedup(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 35,
    gram: int = 8,
    chunk_mb: int = 4,
    shard_mb: float = 8,
    most_shards: int = 1 << 20,
    per_shard: int = 20,
    texts: bool = False,
) -> DataFrame:
    """Removes every word in a window of ``window`` words whose sequence also starts anywhere else.

    Words lie between runs of white space. A shard holds the segments around its anchors, a range of suffixes between sampled
    splitters, once for each distinct content and weighted by how often they occur (see ``repeats``). It builds an
    FM-index over them and streams them through backward search; matching statistics of a whole window say that it
    occurs again. Windows that begin like a splitter at an end of their shard are compared across shards too.

    There is a shard for each ``shard_mb`` of input, with ``per_shard`` samples, but ``most_shards`` at most, as every task
    gets the splitters.

    All occurrences go, the first too. A null or blank text has no words. Rows that share an id count as different
    documents. A document of any length is used whole; one that is larger than a chunk is a chunk of its own. An empty
    table gives an empty result; other columns are ignored, whatever their names.

    texts: returns doc_id and the remaining words, joined by spaces, instead of counts and digests.
    """
    units = repeats.Units(True, window, gram, lambda raw, starts, ends: word_codes(raw, starts, ends - starts), 24 * window)
    chunks = chunked(documents(docs, id_col, text_col), chunk_mb << 20, "substring-chunks")
    size = total_bytes(chunks)
    shards = min(most_shards, max(8, -(-size // int(shard_mb * (1 << 20)))))
    ends = docs.sparkSession.sparkContext.broadcast(repeats.splitters(chunks, units, size, shards, per_shard))
    masks = repeats.mark_repeats(repeats.send_hashes(chunks, units, shards))
    segments = repeats.send_segments(chunks, masks, units, shards, ends)
    found = materialise(repeats.judged(segments, _judge(window, shards), units, ends), "substring-found")
    every = found.unionByName(repeats.compare_across(found, keep_first=False))
    return repeats.cut_out(chunks, every, units, _texts if texts else _result, "doc_id long, text string" if texts else SCHEMA)
