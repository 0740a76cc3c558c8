"""SimHash near-deduplication by covering locality-sensitive hashing."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from loreweave.llm.common import NULL_ID, documents, materialise, text_slices, whole_groups
from loreweave.llm.near_dedup import components

_WHITE = re.compile(rb"[\x20\x09-\x0d]")
#: Bytes of texts that leave a task at once, bytes of a text that become words at once, and hashes whose bits are counted at once.
SLICE, PIECE, HASHES = 4 << 20, 1 << 20, 1 << 16
#: With so many bits fixed, a bucket has 256 fingerprints at most.
ENOUGH_BITS = 56


def shingles(text: bytes, size: int) -> Iterator[list[bytes]]:
    """Shingles of a text in order, repeats included, a piece at a time; of fewer words, the whole sequence."""
    words: list[bytes] = []
    at, whole = 0, False
    while at < len(text):
        end = min(len(text), at + PIECE)
        if end < len(text):
            end = m.start() if (m := _WHITE.search(text, end)) else len(text)
        words += text[at:end].split()
        at = end
        if len(words) >= size:
            yield [b" ".join(x) for x in zip(*(words[i:] for i in range(size)), strict=False)]
            words, whole = words[len(words) - size + 1 :], True
    if words and not whole:
        yield [b" ".join(words)]


def fingerprints(texts: list[bytes], size: int, seed: int) -> np.ndarray:
    """Of each text, 64 bits: those set in over half of its shingles' XXH64; zero without words."""
    digest = partial(xxh64_intdigest, seed=seed)
    ones, total = np.zeros((len(texts), 64), np.int64), np.zeros(len(texts), np.int64)
    owners: list[int] = []
    parts: list[np.ndarray] = []
    held = 0

    def count() -> None:
        h = np.concatenate(parts)
        first = np.cumsum([0, *map(len, parts[:-1])])
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        np.add.at(ones, owners, np.add.reduceat(bits, first, axis=0, dtype=np.int32))
        owners.clear()
        parts.clear()

    for i, text in enumerate(texts):
        for some in shingles(text.lower(), size):
            parts.append(np.fromiter(map(digest, some), np.uint64, len(some)))
            owners.append(i)
            total[i] += len(some)
            held += len(some)
            if held >= HASHES:
                count()
                held = 0
    if parts:
        count()
    return np.packbits(2 * ones > total[:, None], axis=1, bitorder="little").view(np.uint64).reshape(-1)


@lru_cache(maxsize=1 << 14)
def covering(mask: int, radius: int) -> np.ndarray:
    """Masks, of which each has all bits of ``mask`` and about half of the others, so that fingerprints that agree in
    ``mask`` and differ in ``radius`` bits at most agree in one of them.

    The open bits get the nonzero vectors v of radius + 1 bits in turn. The mask of a nonzero vector t has the bits with odd
    <v, t>. Vectors of ``radius`` bits don't span the space, so some t is orthogonal to all of them, and its mask has
    none of the bits in which two fingerprints differ.
    """
    most = (1 << radius + 1) - 1
    open_bits = [i for i in range(64) if not mask >> i & 1]
    return np.array([mask | sum(1 << i for j, i in enumerate(open_bits) if (j % most + 1 & t).bit_count() & 1) for t in range(1, most + 1)], np.uint64)


def _dealt(rows: DataFrame, radius: int) -> DataFrame:
    """Rows (mask, fp) under each mask that covers theirs: mask, key (the bits of fp in it) and fp."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old, which = np.unique(batch.column(0).to_numpy().view(np.uint64), return_inverse=True)
            if not len(old):
                continue
            masks = np.stack([covering(int(m), radius) for m in old])[which]
            fp = np.repeat(batch.column(1).to_numpy().view(np.uint64)[:, None], masks.shape[1], axis=1)
            yield pa.RecordBatch.from_pydict({"mask": pa.array(masks.view(np.int64).ravel()), "key": pa.array((fp & masks).view(np.int64).ravel()), "fp": pa.array(fp.view(np.int64).ravel())})

    return rows.select("mask", "fp").mapInArrow(run, "mask long, key long, fp long")


def close_pairs(fp: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs that differ in ``radius`` bits at most; each is compared with those that no tree
    has reached yet.
    """
    edges: list[tuple[int, int]] = []
    rest = np.arange(len(fp))
    while len(rest) > 1:
        todo, rest = [int(rest[0])], rest[1:]
        while todo and len(rest):
            x = todo.pop()
            near = np.bitwise_count(fp[rest] ^ fp[x]) <= radius
            if near.any():
                found = rest[near].tolist()
                edges += [(x, y) for y in found]
                todo += found
                rest = rest[~near]
    return edges


def _linked(buckets: DataFrame, radius: int) -> DataFrame:
    """Edges a, b within the buckets of rows (mask, key, fp)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in whole_groups(batches, 2):
            signed = t["fp"].to_numpy()
            fp, n = signed.view(np.uint64), np.diff(at)
            two = at[:-1][n == 2]
            two = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= radius]
            pairs = [np.stack((two, two + 1), 1)]
            for i, j in zip(at[:-1][n > 2].tolist(), at[1:][n > 2].tolist(), strict=True):
                if found := close_pairs(fp[i:j], radius):
                    pairs.append(np.array(found) + i)
            e = np.unique(np.sort(signed[np.concatenate(pairs)], axis=1), axis=0)
            yield pa.RecordBatch.from_pydict({"a": pa.array(e[:, 0]), "b": pa.array(e[:, 1])})

    return buckets.select("mask", "key", "fp").repartition("mask", "key").sortWithinPartitions("mask", "key", "fp").mapInArrow(run, "a long, b long")


def simhash_links(prints: DataFrame, *, radius: int = 3, block: int = 1024) -> DataFrame:
    """Edges (a, b) that connect whatever distinct fingerprints (column fp) differ in ``radius`` bits at most.

    Every fingerprint stands in a bucket of each of 2**(radius + 1) - 1 covering masks, so each such pair meets in one of
    them. A bucket of over ``block`` fingerprints isn't compared: its rows are dealt anew by masks that cover the bits
    which are still open, about half of them each time, so three rounds leave 8 open bits and 256 fingerprints at
    most. No bucket is cut and none grows with the input. Each bucket gives a spanning forest, not all its pairs.
    """
    rows, edges = prints.select(F.lit(0).cast("long").alias("mask"), "fp"), []
    while True:
        dealt = materialise(_dealt(rows, radius), "simhash-dealt")
        sizes = materialise(dealt.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "simhash-sizes")
        small = (F.col("n") <= block) | (F.bit_count("mask") >= ENOUGH_BITS)
        edges.append(materialise(_linked(dealt.join(sizes.filter(small), ["mask", "key"]), radius), "simhash-edges"))
        large = sizes.filter(~small)
        if large.isEmpty():
            break
        rows = dealt.join(large, ["mask", "key"]).select("mask", "fp")
    out = edges[0]
    for more in edges[1:]:
        out = out.unionByName(more)
    return out


def simhash_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42, radius: int = 3, block: int = 1024) -> DataFrame:
    """Components of documents whose SimHash fingerprints differ in ``radius`` bits at most.

    Words lie between white space, with A-Z lower-cased; shingles count as often as they come, and a document of fewer
    words has its whole sequence. A fingerprint's bit is set if over half of the shingles' XXH64 have it.

    Returns doc_id, fingerprint (16 hexadecimal digits) and component_id, the least doc_id that is reachable. A null
    text and one without words have the fingerprint zero and are linked like any other. Equal fingerprints are one class,
    of which one row goes on, so copies cost nothing further. A null id is behind all others: component_id is null where no
    document has an id; repeated rows are alike. A text of any length is read whole, PIECE bytes at a time. An
    empty table gives an empty result; other columns are ignored, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in text_slices(batch.column(1), SLICE):
                texts = [(t.as_py() or "").encode() for t in batch.column(1).slice(i, j - i)]
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).slice(i, j - i), "fp": pa.array(fingerprints(texts, shingle, seed).view(np.int64))})

    prints = materialise(documents(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long"), "simhash-prints")
    own = F.coalesce("doc_id", F.lit(NULL_ID))
    classes = materialise(prints.groupBy("fp").agg(F.min(own).alias("least_id")), "simhash-classes")
    linked = components(simhash_links(classes, radius=radius, block=block), "simhash").withColumnRenamed("node", "fp")
    labelled = classes.join(linked, "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))
    least = labelled.groupBy("comp").agg(F.min("least_id").alias("component"))
    out = prints.join(labelled.join(least, "comp").select("fp", "component"), "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("component") != NULL_ID, F.col("component")).alias("component_id"))
