"""Finding repeated windows over a whole corpus, in four passes over packed chunks.

1. Every chunk sends the distinct hashes of its anchors and how often it has them, as packed arrays, to owners of hash
   ranges. Owners answer with bit masks: which anchors occur again.
2. Chunks cut out the segments around repeated anchors, once for each distinct content, and send them to buckets with
   the first place in the chunk and the number of places. At the other places of the chunk, all windows go whatever a
   bucket finds. Buckets are ranges of suffixes, those that begin at anchors, between sampled splitters.
3. Buckets judge the windows of their segments (a caller's ``judge``) and answer with ranges of window starts to
   remove. Equal windows have suffixes that begin alike, so they meet in one bucket unless a splitter falls between
   them: windows that begin like a splitter at either end of their bucket go on, by window hash, to a last comparison across the
   boundaries.
4. Chunks cover the ranges and cut the text.

All four passes move packed arrays; none makes a Spark row per word, byte or window. No key is gathered whole: a hash
and a segment travel once per chunk, however often the chunk has them, and a frequent anchor gets as many splitters
between its suffixes as their number asks for.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreweave.llm.anchors import find_anchors, mix, word_spans
from loreweave.llm.common import binary, map_batches, unpack_chunk, whole_groups
from loreweave.llm.suffix_sort import equal_strings

SPACE = 32
MOST_TASKS = 100_000
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True


@dataclass(frozen=True)
class Units:
    """How a text is cut: the units of a window, the window, the anchor length, and the codes of the units; and the
    bytes that most stretches of two windows fit into.
    """

    words: bool
    window: int
    gram: int
    codes: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]
    stretch: int

    @property
    def least(self) -> int:
        """Bytes that an anchor has at least."""
        return 2 * self.gram - 1 if self.words else self.gram


@dataclass
class Text:
    """A chunk as units: unit u is raw[starts[u]:ends[u]]; bounds: the first unit of each document, and the end."""

    raw: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray


def split_words(raw: np.ndarray, offsets: np.ndarray) -> Text:
    """Words between white space; the result's raw has one space between words."""
    wordy = ~WHITE[raw]
    _, lengths, bounds = word_spans(wordy, offsets)
    out_starts = np.cumsum(lengths + 1) - lengths - 1
    joined = np.full(int(lengths.sum()) + len(lengths), SPACE, np.uint8)
    place = np.ones(len(joined), bool)
    place[out_starts + lengths] = False
    joined[place] = raw[wordy]
    return Text(joined, out_starts, out_starts + lengths, bounds)


def split_bytes(raw: np.ndarray, offsets: np.ndarray) -> Text:
    at = np.arange(len(raw) + 1)
    return Text(raw, at[:-1], at[1:], offsets)


def split(units: Units, raw: np.ndarray, offsets: np.ndarray) -> Text:
    return (split_words if units.words else split_bytes)(raw, offsets)


def cut(units: Units, ids: pa.ListScalar, sizes: pa.ListScalar, data: pa.BinaryScalar) -> tuple[np.ndarray, Text]:
    keys, raw, offsets = unpack_chunk(ids, sizes, data)
    return keys, split(units, raw, offsets)


def anchors_of(units: Units, text: Text) -> tuple[np.ndarray, ...]:
    return find_anchors(units.codes(text.raw, text.starts, text.ends), text.bounds, units.window, units.gram)


def _owner(h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    g = mix(h)
    return ((g >> np.uint64(40)) * np.uint64(n) >> np.uint64(24)).astype(np.int64), (g & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _distinct(h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the distinct hashes, in order: owner, low bits and number; and for each hash, which of them it is."""
    owner, low = _owner(h, n)
    values, of, times = np.unique(owner << 32 | low.astype(np.int64), return_inverse=True, return_counts=True)
    return values >> 32, (values & 0xFFFFFFFF).astype(np.uint32), times.astype(np.int32), of


def _runs(key: np.ndarray) -> dict[int, np.ndarray]:
    """Of each key that occurs, its places in order; costs nothing for keys that don't."""
    order = np.argsort(key, kind="stable")
    new = np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1]))) if len(key) else np.empty(0, np.int64)
    return dict(zip(key[order][new].tolist(), np.split(order, new[1:]), strict=True)) if len(key) else {}


def send_hashes(chunks: DataFrame, units: Units, owners: int) -> DataFrame:
    def one(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        rows: list[tuple] = []
        for chunk, *packed in zip(*batch.columns, strict=True):
            _, text = cut(units, *packed)
            owner, low, times, _ = _distinct(anchors_of(units, text)[3], owners)
            rows += [(o, chunk.as_py(), low[mine], times[mine]) for o, mine in _runs(owner).items()]
        if not rows:
            return None
        o, c, p, n = zip(*rows, strict=True)
        return pa.RecordBatch.from_pydict({"owner": pa.array(o, pa.int32()), "chunk_id": pa.array(c, pa.int64()), "hashes": binary(list(p)), "times": binary(list(n))})

    return map_batches(chunks, one, "owner int, chunk_id long, hashes binary, times binary")


def mark_repeats(hashes: DataFrame) -> DataFrame:
    """For each chunk and owner: the bits of its distinct anchors that occur again anywhere."""

    def one(t: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, np.uint32) for x in t["hashes"].to_pylist()]
        every = np.concatenate(parts)
        order = np.argsort(every)
        every = every[order]
        new = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
        n = np.add.reduceat(np.frombuffer(b"".join(t["times"].to_pylist()), np.int32)[order].astype(np.int64), new)
        values = every[new[n > 1]]
        again = [_among(x, values) for x in parts]
        some = np.array([x.any() for x in again])
        return pa.table({"chunk_id": t["chunk_id"].filter(pa.array(some)), "owner": t["owner"].filter(pa.array(some)), "again": pa.array([np.packbits(x).tobytes() for x, any_ in zip(again, some, strict=True) if any_], pa.binary())})

    return hashes.groupBy("owner").applyInArrow(one, "chunk_id long, owner int, again binary")


def _among(x: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(values):
        return np.zeros(len(x), bool)
    return values[np.minimum(np.searchsorted(values, x), len(values) - 1)] == x


def suffix_key(segment: bytes, anchor: int) -> bytes:
    """What ranges are made of: the suffix from the anchor on, then what is before the anchor, backwards."""
    return segment[anchor:] + segment[:anchor][::-1]


def splitters(chunks: DataFrame, units: Units, size: int, buckets: int, per_bucket: int) -> list[bytes]:
    """Ends of ranges of suffixes: about ``buckets`` quantiles of a sample of ``per_bucket`` times as many.

    The sample grows with the input: every chunk offers suffixes of anchors at random places, by its bytes. The sample is sorted in ranges by
    Spark, and each range, however few it has, gives out every so-many-th suffix from a random one on, so that the driver
    gets the splitters only. A splitter is as short as can be: it has one byte that the suffix before it in the range hasn't.
    """

    def offer(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys: list[bytes] = []
        for chunk, *packed in zip(*batch.columns, strict=True):
            _, raw, offsets = unpack_chunk(*packed)
            rng = np.random.default_rng(chunk.as_py() & 0x7FFFFFFFFFFFFFFF)
            for at in rng.integers(0, max(1, len(raw)), rng.poisson(len(raw) * per_bucket * buckets / max(1, size))).tolist():
                begin, end = offsets[np.searchsorted(offsets, at, side="right") + np.array([-1, 0])].tolist()
                at = max(begin, min(at, end - units.stretch))
                part = raw[at : min(end, at + units.stretch)]
                text = split(units, part, np.array([0, len(part)]))
                if len(text.starts) >= units.window:
                    found = anchors_of(units, text)
                    which = int(rng.integers(0, len(found[0])))
                    a, s1, s2 = (int(x[which]) for x in found[:3])
                    lo = int(text.starts[s1])
                    keys.append(suffix_key(text.raw[lo : text.ends[s2 + units.window - 1]].tobytes(), int(text.starts[a]) - lo))
        return pa.RecordBatch.from_pydict({"suffix": pa.array(keys, pa.binary())})

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i, before = -int(np.random.default_rng(TaskContext.get().partitionId()).integers(0, per_bucket)), None
        for batch in batches:
            found = []
            for x in batch.column(0).to_pylist():
                if i % per_bucket == 0 and x != before:
                    found.append(x if before is None else x[: common_prefix(before, x) + 1])
                i, before = i + 1, x
            yield pa.RecordBatch.from_pydict({"suffix": pa.array(found, pa.binary())})

    sample = map_batches(chunks, offer, "suffix binary")
    ranges = sample.repartitionByRange(max(1, per_bucket * buckets // 10_000), "suffix").sortWithinPartitions("suffix")
    return sorted({bytes(r[0]) for r in ranges.mapInArrow(pick, "suffix binary").collect()})


def common_prefix(x: bytes, y: bytes) -> int:
    n = min(len(x), len(y))
    if x[:n] == y[:n]:
        return n
    lo = 0
    while n - lo > 1:
        mid = (lo + n) // 2
        lo, n = (mid, n) if x[lo:mid] == y[lo:mid] else (lo, mid)
    return lo


SEGMENTS = "bucket int, chunk_id long, data binary, lengths binary, anchors binary, occ_seg binary, occ_doc binary, occ_start binary, occ_times binary, settled binary"
_BLOBS = ("data", "lengths", "anchors", "occ_seg", "occ_doc", "occ_start", "occ_times", "settled")


def send_segments(chunks: DataFrame, masks: DataFrame, units: Units, owners: int, ends: Broadcast) -> DataFrame:
    """ends: the splitters between buckets."""
    w = units.window

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[dict] = []
        for chunk, *packed in zip(*(left[c] for c in ("chunk_id", "doc_ids", "sizes", "data")), strict=True):
            keys, text = cut(units, *packed)
            a, s1, s2, h = anchors_of(units, text)
            owner, _, _, of = _distinct(h, owners)
            of_owner = _runs(owner)
            again = np.zeros(len(owner), bool)
            for o, m in zip(right["owner"].to_pylist(), right["again"].to_pylist(), strict=True):
                again[of_owner[o]] = np.unpackbits(np.frombuffer(m, np.uint8), count=len(of_owner[o]))
            pick = np.flatnonzero(again[of])
            if not len(pick):
                continue
            doc = keys[np.searchsorted(text.bounds, s1[pick], side="right") - 1]
            lo, n = text.starts[s1[pick]], text.ends[s2[pick] + w - 1] - text.starts[s1[pick]]
            before = text.starts[a[pick]] - lo
            data, occ, n, before = _segments(text.raw, lo, n, before)
            base = np.cumsum(n) - n
            split_at = ends.value
            to = np.fromiter((bisect_right(split_at, suffix_key(data[b : b + m], g)) for b, m, g in zip(base.tolist(), n.tolist(), before.tolist(), strict=True)), np.int64, len(n))
            rank = np.empty(len(to), np.int64)
            by = np.lexsort((s1[pick], doc, occ))
            lead = np.zeros(len(occ), bool)
            lead[by] = np.concatenate(([True], occ[by][1:] != occ[by][:-1]))
            first, times = np.flatnonzero(lead), np.bincount(occ, minlength=len(to))
            settled = _joined(s1[pick[~lead]], s2[pick[~lead]]).astype(np.int32).tobytes()
            of_bucket = _runs(to[occ[first]])
            begun = len(rows)
            for b, mine in _runs(to).items():
                rank[mine] = np.arange(len(mine))
                o = first[of_bucket[b]]
                rows.append({
                    "bucket": b, "chunk_id": chunk.as_py(), "data": b"".join(data[x : x + m] for x, m in zip(base[mine].tolist(), n[mine].tolist(), strict=True)), "lengths": n[mine].astype(np.int32).tobytes(), "anchors": before[mine].astype(np.int32).tobytes(),
                    "occ_seg": rank[occ[o]].astype(np.int32).tobytes(), "occ_doc": doc[o].astype(np.int64).tobytes(), "occ_start": s1[pick][o].astype(np.int32).tobytes(), "occ_times": times[occ[o]].astype(np.int32).tobytes(),
                })
            if settled:
                rows[begun + chunk.as_py() % (len(rows) - begun)]["settled"] = settled
        return pa.Table.from_pylist(rows, pa.schema([("bucket", pa.int32()), ("chunk_id", pa.int64()), *((c, pa.binary()) for c in _BLOBS)]))

    return chunks.groupBy("chunk_id").cogroup(masks.groupBy("chunk_id")).applyInArrow(one, SEGMENTS)


def _segments(raw: np.ndarray, lo: np.ndarray, n: np.ndarray, before: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct segments of a chunk: their bytes, which one each place has, their lengths and anchors."""
    text = raw.tobytes()
    occ, first = equal_strings(b"".join(text[x : x + m] for x, m in zip(lo.tolist(), n.tolist(), strict=True)), n)
    return b"".join(text[x : x + m] for x, m in zip(lo[first].tolist(), n[first].tolist(), strict=True)), occ, n[first], before[first]


def _joined(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Ranges in order, as rows of first number and count; adjacent ones are joined."""
    if not len(first):
        return np.empty((0, 2), np.int64)
    new = np.flatnonzero(np.concatenate(([True], first[1:] != last[:-1] + 1)))
    return np.stack((first[new], np.add.reduceat(last - first + 1, new)), 1)


@dataclass
class Bucket:
    """Distinct segments of a bucket, one behind another in data, and where they first stand in each chunk."""

    data: bytes
    lengths: np.ndarray
    anchors: np.ndarray
    #: Of each segment: how many bytes from the anchor on are like the splitter at either end of the bucket.
    like_end: np.ndarray
    #: Of each first place: its segment, document key, chunk, first window start in the chunk, and how many places the
    #: chunk has.
    seg: np.ndarray
    doc: np.ndarray
    chunk: np.ndarray
    start: np.ndarray
    times: np.ndarray

    def segments(self) -> list[bytes]:
        e = np.cumsum(self.lengths)
        return [self.data[a:b] for a, b in zip((e - self.lengths).tolist(), e.tolist(), strict=True)]


def gather(t: pa.Table, ends: list[bytes], least: int) -> Bucket:
    column = lambda c, kind: [np.frombuffer(x, kind).astype(np.int64) for x in t[c].to_pylist()]
    lengths, anchors, seg = column("lengths", np.int32), column("anchors", np.int32), column("occ_seg", np.int32)
    data, n = b"".join(t["data"].to_pylist()), np.concatenate(lengths)
    sent = np.cumsum([0, *map(len, lengths)])
    of, first = equal_strings(data, n)
    at = (np.cumsum(n) - n)[first]
    data = b"".join(data[a : a + m] for a, m in zip(at.tolist(), n[first].tolist(), strict=True))
    doc, start, times = (np.concatenate(column(c, k)) for c, k in (("occ_doc", np.int64), ("occ_start", np.int32), ("occ_times", np.int32)))
    chunk = np.repeat(t["chunk_id"].to_numpy(), list(map(len, seg)))
    b = Bucket(data, n[first], np.concatenate(anchors)[first], np.zeros(len(first), np.int64), np.concatenate([of[i + x] for i, x in zip(sent.tolist(), seg, strict=False)]), doc, chunk, start, times)
    bucket = t["bucket"][0].as_py()
    near = [x for x in ends[max(0, bucket - 1) : bucket + 1] if len(x) >= least]
    if near:
        keys = (suffix_key(s, a) for s, a in zip(b.segments(), b.anchors.tolist(), strict=True))
        b.like_end = np.array([max(common_prefix(k, x) for x in near) for k in keys], np.int64)
    return b


def ranges(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct numbers as first number and length of runs."""
    if not len(starts):
        return starts, starts
    new = np.flatnonzero(np.concatenate(([True], starts[1:] != starts[:-1] + 1)))
    return starts[new], np.diff(np.append(new, len(starts)))


FOUND = "chunk_id long, starts binary, to_bucket int, hash binary, doc binary, n binary"
_FOUND = pa.schema([("chunk_id", pa.int64()), ("starts", pa.binary()), ("to_bucket", pa.int32()), ("hash", pa.binary()), ("doc", pa.binary()), ("n", pa.binary())])


def removals(chunk: np.ndarray, start: np.ndarray) -> list[dict]:
    """Rows that tell chunks which window starts to remove; as pairs of int32, first and count."""
    if not len(chunk):
        return []
    order = np.lexsort((start, chunk))
    chunk, start = chunk[order], start[order]
    new = np.flatnonzero(np.concatenate(([True], chunk[1:] != chunk[:-1])))
    rows = []
    for i, j in zip(new.tolist(), np.append(new[1:], len(chunk)).tolist(), strict=True):
        first, n = ranges(np.unique(start[i:j]))
        rows.append({"chunk_id": int(chunk[i]), "starts": np.stack((first, n), 1).astype(np.int32).tobytes()})
    return rows


def open_windows(hashes: np.ndarray, doc: np.ndarray, chunk: np.ndarray, start: np.ndarray, n: np.ndarray, buckets: int) -> list[dict]:
    """Rows that carry windows to the comparison across buckets."""
    to = (hashes[:, 0] % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((start, chunk, to))
    change = (to[order][1:] != to[order][:-1]) | (chunk[order][1:] != chunk[order][:-1])
    new = np.flatnonzero(np.concatenate(([True], change)))
    rows = []
    for i, j in zip(new.tolist(), np.append(new[1:], len(order)).tolist(), strict=True):
        o = order[i:j]
        rows.append({"chunk_id": int(chunk[o[0]]), "starts": start[o].astype(np.int32).tobytes(), "to_bucket": int(to[o[0]]), "hash": hashes[o].tobytes(), "doc": doc[o].tobytes(), "n": n[o].astype(np.int64).tobytes()})
    return rows


def found_table(rows: list[dict]) -> pa.Table:
    return pa.Table.from_pylist(rows, _FOUND)


def window_hashes(data: list[bytes]) -> np.ndarray:
    """128 bits of each window."""
    return np.frombuffer(b"".join(xxhash.xxh3_128_digest(x) for x in data), np.uint64).reshape(-1, 2)


def compare_across(found: DataFrame, keep_first: bool) -> DataFrame:
    """The last comparison: of windows whose equals a splitter may divide.

    keep_first: all but the first in the order of the corpus go; else all that occur more than once go.
    """

    def one(t: pa.Table) -> pa.Table:
        h = np.concatenate([np.frombuffer(x, np.uint64).reshape(-1, 2) for x in t["hash"].to_pylist()])
        start = np.concatenate([np.frombuffer(x, np.int32) for x in t["starts"].to_pylist()]).astype(np.int64)
        doc = np.concatenate([np.frombuffer(x, np.int64) for x in t["doc"].to_pylist()])
        n = np.concatenate([np.frombuffer(x, np.int64) for x in t["n"].to_pylist()])
        chunk = np.repeat(np.array(t["chunk_id"].to_pylist(), np.int64), [len(x) // 4 for x in t["starts"].to_pylist()])
        order = np.lexsort((start, chunk, doc, h[:, 1], h[:, 0]))
        same = (h[order][1:] == h[order][:-1]).all(axis=1)
        gone = np.zeros(len(order), bool)
        gone[1:] |= same
        if not keep_first:
            gone[:-1] |= same
            gone |= n[order] > 1
        o = order[gone]
        return found_table(removals(chunk[o], start[o]))

    return found.filter("to_bucket is not null").groupBy("to_bucket").applyInArrow(one, FOUND)


def judged(segments: DataFrame, judge: Callable[[Bucket], list[dict]], units: Units, ends: Broadcast) -> DataFrame:
    """Tasks take neighbouring buckets, one each up to MOST_TASKS buckets, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in whole_groups(batches, 1):
            for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                own = t.slice(i, j - i)
                settled = [{"chunk_id": c, "starts": s} for c, s in zip(own["chunk_id"].to_pylist(), own["settled"].to_pylist(), strict=True) if s]
                yield from found_table(settled + judge(gather(own, ends.value, units.least))).to_batches()

    buckets = len(ends.value) + 1
    tasks = min(buckets, MOST_TASKS)
    dealt = segments.repartitionById(tasks, F.expr(f"int(bucket * {tasks}L div {buckets}L)"))
    return dealt.sortWithinPartitions("bucket", "chunk_id").mapInArrow(run, FOUND)


def cover(n_units: int, window: int, found: list[bytes]) -> np.ndarray:
    """Which units are in a removed window."""
    depth = np.zeros(n_units + 1, np.int64)
    for x in found:
        r = np.frombuffer(x, np.int32).reshape(-1, 2).astype(np.int64)
        np.add.at(depth, r[:, 0], 1)
        np.add.at(depth, r[:, 0] + r[:, 1] - 1 + window, -1)
    return np.cumsum(depth[:-1]) > 0


def cut_out(chunks: DataFrame, found: DataFrame, units: Units, result: Callable[[pa.Array, Text, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """result: a chunk's rows, from its ids, its text and the units to remove."""

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for ids, *packed in zip(left["doc_ids"], left["sizes"], left["data"], strict=True):
            _, text = cut(units, ids, *packed)
            out.append(result(ids.values, text, cover(len(text.starts), units.window, right["starts"].to_pylist())))
        return pa.concat_tables(out)

    found = found.filter("to_bucket is null").select("chunk_id", "starts")
    return chunks.groupBy("chunk_id").cogroup(found.groupBy("chunk_id")).applyInArrow(one, schema)
