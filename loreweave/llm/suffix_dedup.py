"""Suffix-array removal of repeated byte strings."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loreweave.llm import repeats
from loreweave.llm.anchors import BYTE_CODES
from loreweave.llm.common import chunked, documents, ids_out, materialise, total_bytes
from loreweave.llm.suffix_sort import Suffixes

SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _judge(window: int, buckets: int):
    def judge(b: repeats.Bucket) -> list[dict]:
        n_windows = b.lengths - window + 1
        base = np.cumsum(b.lengths) - b.lengths
        owner = np.repeat(np.arange(len(b.lengths)), n_windows)
        within = np.arange(int(n_windows.sum())) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
        # the first place of every distinct segment, in the order of the corpus
        by = np.lexsort((b.start, b.chunk, b.doc))
        new = np.concatenate(([True], (b.doc[by][1:] != b.doc[by][:-1]) | (b.chunk[by][1:] != b.chunk[by][:-1])))
        rank = np.empty(len(by), np.int64)
        rank[by] = np.cumsum(new)
        place = (rank << 32) + b.start
        first = np.full(len(b.lengths), np.iinfo(np.int64).max)
        np.minimum.at(first, b.seg, place)
        order, same = Suffixes(b.data, window).sort(base[owner] + within, window)
        group = np.cumsum(~same) - 1
        key = (first[owner] + within)[order]
        least = np.minimum.reduceat(key, np.flatnonzero(~same))[group] if len(key) else key
        leads = np.empty(len(order), bool)
        leads[order] = key == least
        at_first = place == first[b.seg]
        # windows of first places: all that don't lead; of other places: all
        chosen = np.flatnonzero(at_first)
        lead_occ = np.empty(len(b.lengths), np.int64)
        lead_occ[b.seg[chosen]] = chosen
        gone = np.flatnonzero(~leads)
        occ = lead_occ[owner[gone]]
        chunk, start = [b.chunk[occ]], [b.start[occ] + within[gone]]
        rest = np.flatnonzero(~at_first)
        reps = n_windows[b.seg[rest]]
        chunk.append(np.repeat(b.chunk[rest], reps))
        start.append(np.repeat(b.start[rest], reps) + np.arange(int(reps.sum())) - np.repeat(np.cumsum(reps) - reps, reps))
        rows = repeats.removals(np.concatenate(chunk), np.concatenate(start))
        del order, same, group, key, least
        # a window has window - (anchor - within) bytes from the anchor on
        open_ = np.flatnonzero(leads & (within <= (b.like_end + b.anchors - window)[owner]))
        if len(open_):
            at = (base[owner] + within)[open_]
            occ = lead_occ[owner[open_]]
            rows += repeats.open_windows(repeats.window_hashes([b.data[i : i + window] for i in at.tolist()]), b.doc[occ], b.chunk[occ], b.start[occ] + within[open_], np.ones(len(open_), np.int64), buckets)
        return rows

    return judge


def _result(ids: pa.Array, text: repeats.Text, gone: np.ndarray) -> pa.Table:
    removed, spans, sha = [], [], []
    for lo, hi in zip(text.bounds[:-1].tolist(), text.bounds[1:].tolist(), strict=True):
        g = gone[lo:hi]
        n = int(g.sum())
        removed.append(n)
        spans.append(int(g[0]) + int((g[1:] & ~g[:-1]).sum()) if n else 0)
        sha.append(hashlib.sha256(text.raw[lo:hi][~g].tobytes() if n else text.raw[lo:hi].tobytes()).hexdigest())
    return pa.table({"doc_id": ids_out(ids), "n_bytes": pa.array(np.diff(text.bounds), pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(sha, pa.string())})


def _kept(ids: pa.Array, text: repeats.Text, gone: np.ndarray) -> pa.Table:
    """Remaining texts; bytes that no longer form a character become U+FFFD."""
    bounds = zip(text.bounds[:-1].tolist(), text.bounds[1:].tolist(), strict=True)
    return pa.table({"doc_id": ids_out(ids), "text": pa.array([text.raw[a:b][~gone[a:b]].tobytes().decode("utf-8", "replace") for a, b in bounds], pa.string())})


def suffix_dedup(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = 100,
    gram: int = 32,
    chunk_mb: int = 4,
    bucket_mb: float = 8,
    most_buckets: int = 1 << 20,
    per_bucket: int = 20,
    texts: bool = False,
) -> DataFrame:
    """Removes every byte of a ``length``-byte string that also starts earlier in the corpus.

    The suffixes that are sorted are those in segments around repeated anchors (see ``repeats``); a string that occurs
    once cannot be in one. Sampled splitters range-partition them by the leading bytes of the anchor's suffix; a bucket
    sorts its segments, and then the suffixes in them, by multikey quicksort; equal ones are neighbours in this order. Strings that begin like a splitter at an end of their bucket are
    compared across the boundaries afterwards.

    There is a bucket for each ``bucket_mb`` of input, with ``per_bucket`` samples, but ``most_buckets`` at most, as every
    task gets the splitters: those have ``length`` + 70 bytes at most, and mostly under ten.

    Earlier means a smaller doc_id, or an earlier start in the same document; rows that share an id count as different
    documents in any one order, and a null id is behind all others. A null text counts as empty. Matches never cross
    documents, and strings are judged on the input. A document of any length is used whole; one that is larger than a
    chunk is a chunk of its own. An empty table gives an empty result; other columns are ignored, whatever their names.

    texts: returns doc_id and the remaining text instead of counts and digests.
    """
    units = repeats.Units(False, length, gram, lambda raw, starts, ends: BYTE_CODES[raw], 2 * length)
    chunks = chunked(documents(docs, id_col, text_col), chunk_mb << 20, "suffix-chunks")
    size = total_bytes(chunks)
    buckets = min(most_buckets, max(8, -(-size // int(bucket_mb * (1 << 20)))))
    ends = docs.sparkSession.sparkContext.broadcast(repeats.splitters(chunks, units, size, buckets, per_bucket))
    masks = repeats.mark_repeats(repeats.send_hashes(chunks, units, buckets))
    segments = repeats.send_segments(chunks, masks, units, buckets, ends)
    found = materialise(repeats.judged(segments, _judge(length, buckets), units, ends), "suffix-found")
    every = found.unionByName(repeats.compare_across(found, keep_first=True))
    return repeats.cut_out(chunks, every, units, _kept if texts else _result, "doc_id long, text string" if texts else SCHEMA)
