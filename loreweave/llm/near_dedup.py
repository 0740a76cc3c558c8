"""MinHash near-deduplication by an inverted join on signature coordinates."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreweave.llm.anchors import mix, word_codes, word_spans
from loreweave.llm.common import NULL_ID, documents, materialise, text_bytes, text_slices, whole_groups
from loreweave.llm.repeats import WHITE

SCHEMA = "doc_id long, n_shingles long, component_id long, kept boolean"
_RNG = np.random.default_rng(977)
_ODD = _RNG.integers(1, 1 << 62, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of text that become sets at once.
SLICE_BYTES = 1 << 20
#: Rows of a large group, about, that are compared with all others first.
PIVOTS = 32


def match_threshold(coordinates: int, similarity: float, miss: float) -> int:
    """The highest number of matching coordinates that a pair of this similarity fails to reach with a chance of
    ``miss`` at most.
    """
    below, t = 0.0, 0
    for k in range(coordinates):
        below += math.comb(coordinates, k) * similarity**k * (1 - similarity) ** (coordinates - k)
        if below > miss:
            break
        t = k + 1
    return max(1, t)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the shingles of each text; of a shorter one, that of its whole sequence."""
    low = _LOWER[raw]
    starts, lengths, bounds = word_spans(~WHITE[low], offsets)
    codes = word_codes(low, starts, lengths)
    m = max(0, len(codes) - size + 1)
    h = np.zeros(m, np.uint64)
    for i in range(size):
        h += codes[i : i + m] * _ODD[i]
    h = mix(h)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(h[a : b - size + 1]))
        elif b > a:
            out.append(mix((codes[a:b] * _ODD[: b - a]).sum(keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """MinHash of each non-empty set: the least of each hash function, 32 bits a coordinate."""
    n = np.array([len(s) for s in sets])
    h = np.concatenate(sets)
    first = np.cumsum(n) - n
    out = np.empty((len(sets), coordinates), np.uint32)
    for j in range(coordinates):
        out[:, j] = np.minimum.reduceat((h * _ODD[j] + _ADD[j]) >> np.uint64(32), first)
    return out


def _sets(texts: pa.Array, size: int) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """Shingle sets of texts, a slice of SLICE_BYTES at a time; a longer text is a slice of its own."""
    for i, j in text_slices(texts, SLICE_BYTES):
        yield i, j, shingle_sets(*text_bytes(texts.slice(i, j - i)), size)


def _sign(rows: DataFrame, size: int, coordinates: int) -> DataFrame:
    """For each row: bytes of its text, the size of its set, a 128-bit digest of the set, and its signature (null if it is empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.uint64(0)
        for batch in batches:
            for i, j, sets in _sets(batch.column(2), size):
                full = np.array([len(s) > 0 for s in sets])
                sig = signatures([s for s in sets if len(s)], coordinates).view(np.int32) if full.any() else np.empty((0, coordinates), np.int32)
                ends = np.concatenate(([0], np.cumsum(full * coordinates))).astype(np.int32)
                texts = batch.column(2).slice(i, j - i)
                yield pa.RecordBatch.from_pydict({
                    "row_id": batch.column(0).slice(i, j - i), "doc_id": batch.column(1).slice(i, j - i), "bytes": pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64()), "n": pa.array([len(s) for s in sets], pa.int64()),
                    "d1": pa.array(np.array([mix(s).sum() if len(s) else none for s in sets], np.uint64).view(np.int64)), "d2": pa.array(np.array([mix(s ^ _ADD[7]).sum() if len(s) else none for s in sets], np.uint64).view(np.int64)),
                    "sig": pa.ListArray.from_arrays(pa.array(ends), pa.array(sig.reshape(-1)), mask=pa.array(~full)),
                })

    return rows.mapInArrow(run, "row_id long, doc_id long, bytes long, n long, d1 long, d2 long, sig array<int>")


def matching_edges(sig: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs that match in ``threshold`` coordinates.

    Members that already hang together are skipped: each is compared only with those that no tree has reached yet.
    """
    edges: list[tuple[int, int]] = []
    rest = np.arange(len(sig))
    while len(rest) > 1:
        todo, rest = [int(rest[0])], rest[1:]
        while todo and len(rest):
            x = todo.pop()
            near = (sig[rest] == sig[x]).sum(axis=1) >= threshold
            if near.any():
                found = rest[near].tolist()
                edges += [(x, y) for y in found]
                todo += found
                rest = rest[~near]
    return edges


def _pairs(row: np.ndarray, pairs: list[np.ndarray]) -> pa.RecordBatch:
    e = np.concatenate([np.empty((0, 2), np.int64), *pairs])
    e = np.unique(np.sort(row[e], axis=1), axis=0)
    return pa.RecordBatch.from_pydict({"a": pa.array(e[:, 0]), "b": pa.array(e[:, 1])})


def _merge_lists(dealt: DataFrame, coordinates: int, threshold: int) -> DataFrame:
    """Edges within the blocks of posting lists, from the members' signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in whole_groups(batches, 2):
            row, sig = t["row_id"].to_numpy(), t["sig"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, coordinates)
            n = np.diff(at)
            two = at[:-1][n == 2]
            two = two[(sig[two] == sig[two + 1]).sum(axis=1) >= threshold]
            pairs = [np.stack((two, two + 1), 1)]
            for i, j in zip(at[:-1][n > 2].tolist(), at[1:][n > 2].tolist(), strict=True):
                if found := matching_edges(sig[i:j], threshold):
                    pairs.append(np.array(found) + i)
            yield _pairs(row, pairs)

    return dealt.select("g", "block", "row_id", "sig").mapInArrow(run, "a long, b long")


def _confirm(dealt: DataFrame, size: int, percent: int) -> DataFrame:
    """Edges within the blocks of candidate components, by full sets made from the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in whole_groups(batches, 2):
            row, texts = t["row_id"].to_numpy(), t["text"].combine_chunks()
            pairs = []
            for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                if j - i > 1 and (found := linked([s for _, _, x in _sets(texts.slice(i, j - i), size) for s in x], percent)):
                    pairs.append(np.array(found) + i)
            yield _pairs(row, pairs)

    return dealt.select("g", "block", "row_id", "text").mapInArrow(run, "a long, b long")


def _by_blocks(blocks: DataFrame, payload: DataFrame) -> DataFrame:
    """Members with what their comparison needs, sorted by group and block; a block meets in one task."""
    return blocks.select("g", "block", "row_id").join(payload, "row_id").repartition("g", "block").sortWithinPartitions("g", "block", "row_id")


def connected(members: DataFrame, payload: DataFrame, edges_of: Callable[[DataFrame], DataFrame], label: str, most_rows: int, most_bytes: int) -> DataFrame:
    """Components of the rows that ``edges_of`` links within groups: node and comp.

    members: group g, row_id and bytes; payload: row_id and what edges_of compares. A block, what edges_of sees at
    once, has about ``most_rows`` rows and ``most_bytes`` bytes at most, and twice that with pivots.

    1. A group that is too large for one block is dealt to parts by row, and some PIVOTS of its rows, its pivots, go
       to every part. So the parts of a tight group, such as near copies of one text, hang together by now.
    2. Where a group is still in several trees, its parts are dealt anew by tree, trees that don't fill a part mixed, and all
       pairs of parts are compared, except those within one tree: these rows are connected already. This loses no
       link that would connect anything, and its cost is the group's rows times the parts outside its largest tree.
    """
    ceil = lambda x, by: F.ceil(F.col(x) / F.lit(by)).cast("long")
    sizes = members.groupBy("g").agg(F.count(F.lit(1)).alias("rows"), F.sum("bytes").alias("held")).filter("rows > 1")
    parts = F.greatest(F.lit(1).cast("long"), ceil("rows", most_rows), ceil("held", most_bytes))
    sizes = materialise(sizes.withColumn("parts", parts), f"{label}-sizes")
    few = members.join(sizes.filter("parts = 1"), "g").withColumn("block", F.lit(0).cast("long"))
    if sizes.filter("parts > 1").isEmpty():
        return components(edges_of(_by_blocks(few, payload)), label)
    many = materialise(members.join(sizes.filter("parts > 1"), "g").withColumn("own", F.pmod(F.xxhash64("row_id"), "parts")), f"{label}-large")
    one_in = F.greatest(ceil("rows", PIVOTS), ceil("held", most_bytes))
    pivots = many.filter(F.pmod(F.xxhash64("row_id", F.lit(1)), one_in) == 0).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).filter("block <> own")
    first = few.unionByName(many.withColumn("block", F.col("own")).drop("own")).unionByName(pivots.drop("own"))
    found = components(edges_of(_by_blocks(first, payload)), label)

    trees = many.join(found, many["row_id"] == found["node"], "left").select("g", "row_id", "bytes", F.coalesce("comp", "row_id").alias("tree"))
    trees = materialise(trees, f"{label}-trees")
    each = trees.groupBy("g", "tree").agg(F.count(F.lit(1)).alias("rows"), F.sum("bytes").alias("held"))
    split = each.groupBy("g").agg(F.count(F.lit(1)).alias("trees"), F.sum("rows").alias("all")).filter("trees > 1").select("g")
    each = materialise(each.join(split, "g").withColumn("parts", parts), f"{label}-each")
    if each.isEmpty():
        return found
    # a tree of several parts is never mixed; of the others' parts there are as many as they fill
    small = each.filter("parts = 1").groupBy("g").agg(F.greatest(F.ceil(F.sum("rows") / F.lit(most_rows)), F.ceil(F.sum("held") / F.lit(most_bytes))).cast("long").alias("mixed"))
    pure = each.filter("parts > 1").select("g", F.col("tree").alias("other_tree"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other_part"))
    others = materialise(pure.unionByName(small.select("g", F.lit(-1).cast("long").alias("other_tree"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("mixed") - 1)).alias("other_part"))), f"{label}-parts")
    rows = trees.join(each.select("g", "tree", "parts"), ["g", "tree"]).join(small, "g", "left")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("row_id", F.lit(2)), F.when(F.col("parts") > 1, F.col("parts")).otherwise(F.col("mixed"))))
    rows = rows.withColumn("tree", F.when(F.col("parts") > 1, F.col("tree")).otherwise(F.lit(-1)))
    mine, other = F.struct("tree", "part"), F.struct(F.col("other_tree").alias("tree"), F.col("other_part").alias("part"))
    pairs = rows.join(others, "g").filter((F.col("tree") == -1) | (F.col("tree") != F.col("other_tree")))
    pairs = pairs.withColumn("block", F.xxhash64(F.least(mine, other), F.greatest(mine, other)))
    more = edges_of(_by_blocks(pairs, payload)).unionByName(found.select(F.col("node").alias("a"), F.col("comp").alias("b")))
    return components(more, f"{label}-again")


def components(edges: DataFrame, label: str) -> DataFrame:
    """node and comp, the least node of its component, for all nodes of edges (a, b).

    Alternates large-star and small-star steps until nothing changes. Every step's least neighbours and every round's edges
    are written to the shared folder, so a node's rows join with one row behind an exchange of their own, which Spark
    splits where a node has very many.
    """
    edges = materialise(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{label}-edges")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), f"{label}-least")
        large = materialise(both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct(), f"{label}-large-star")
        down = materialise(large.groupBy("a").agg(F.min("b").alias("m")), f"{label}-least")
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(down.select("a", F.col("m").alias("b")))
        edges = materialise(small.filter("a <> b").distinct(), f"{label}-round")
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    leaves = edges.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    return leaves.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())


def linked(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs with 100 * intersection >= percent * union, by full sets.

    Only sets that no tree has reached yet are looked at, so near copies of one text take one turn.
    """
    n = np.array([len(s) for s in sets], np.int64)
    if len(sets) == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(0, 1)] if 100 * both >= percent * (n.sum() - both) else []
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), n)
    order = np.argsort(flat, kind="stable")
    value, owner = flat[order], owner[order]
    new = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1])))
    ends = np.append(new[1:], len(value))
    group = np.empty(len(flat), np.int64)
    group[order] = np.repeat(np.arange(len(new)), ends - new)
    at = np.cumsum(n) - n
    shared = ends - new > 1
    rest, edges = np.ones(len(sets), bool), []
    for root in range(len(sets)):
        todo = [root] if rest[root] else []
        rest[root] = False
        while todo and rest.any():
            x = todo.pop()
            mine = group[at[x] : at[x] + n[x]]
            mine = mine[shared[mine]]
            size = ends[mine] - new[mine]
            places = np.repeat(new[mine] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
            both = np.bincount(owner[places], minlength=len(sets))
            found = np.flatnonzero(rest & (both > 0) & (100 * both >= percent * (n + n[x] - both))).tolist()
            edges += [(x, y) for y in found]
            rest[found] = False
            todo += found
    return edges


def near_dedup(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    percent: int = 80,
    coordinates: int = 32,
    miss: float = 1e-6,
    block: int = 1024,
    block_mb: int = 8,
) -> DataFrame:
    """Components of documents linked by 100 * intersection >= ``percent`` * union of their shingle sets.

    1. Rows with identical sets become one class; classes go on with one row.
    2. Classes are posted under every coordinate and value of their MinHash signature. A pair at the similarity bound
       matches in T coordinates but for a chance of ``miss`` (match_threshold), so it shares one of the
       coordinates - T + 1 rarest of either: only these prefixes are joined.
    3. Each posting list counts collisions of its members' signatures, skipping those that already hang together, and
       keeps a spanning forest of the pairs above the match threshold.
    4. Candidate components confirm links on full sets made from the texts.

    Lists and components of over ``block`` rows or ``block_mb`` are compared in blocks, without losing a link that
    connects anything (see ``connected``).

    Words lie between white space, with A-Z lower-cased. A document with fewer words than a shingle has its whole
    sequence as its only one; without words or text, its set is empty and it is linked with nothing. A null id is behind
    all others: component_id is null where no document has an id. kept: whether doc_id equals component_id; rows that
    repeat an id and a text are alike in it. A text of any length is used whole; what a task holds at once is one such
    text, or a block. An empty table gives an empty result; other columns are ignored, whatever their names.
    """
    threshold = match_threshold(coordinates, percent / 100, miss)
    prefix = coordinates - threshold + 1
    rows = materialise(documents(docs, id_col, text_col).select(F.monotonically_increasing_id().alias("row_id"), "doc_id", "text"), "near-docs")
    signed = materialise(_sign(rows, shingle, coordinates), "near-signed")
    same = ["d1", "d2", "n"]
    least = F.min(F.coalesce("doc_id", F.lit(NULL_ID))).alias("least_id")
    classes = signed.filter("n > 0").groupBy(*same).agg(least, F.min(F.struct("row_id", "bytes", "sig")).alias("x")).select(*same, "least_id", "x.row_id", "x.bytes", "x.sig")
    classes = materialise(classes, "near-classes")
    # coordinate in the high half of a key, value in the low one
    posts = classes.select("row_id", F.posexplode("sig").alias("at", "value")).select("row_id", F.shiftleft(F.col("at").cast("long"), 32).bitwiseOR(F.col("value").cast("long").bitwiseAND(F.lit(0xFFFFFFFF))).alias("g"))
    frequency = posts.groupBy("g").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    listed = posts.join(frequency, "g").groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("df", "g"))).alias("k"))
    # coordinates that nobody shares are the rarest, and come first in the prefix
    listed = listed.withColumn("k", F.slice("k", 1, F.greatest(F.lit(0), F.lit(prefix - coordinates) + F.size("k")))).filter(F.size("k") > 0)
    lists = materialise(listed.select(F.explode("k.g").alias("g"), "row_id", F.lit(4 * coordinates).cast("long").alias("bytes")), "near-lists")
    candidates = connected(lists, classes.select("row_id", "sig"), lambda dealt: _merge_lists(dealt, coordinates, threshold), "near-candidates", block, block_mb << 20)
    groups = candidates.join(classes.select("row_id", "bytes"), candidates["node"] == classes["row_id"]).select(F.col("comp").alias("g"), "row_id", "bytes")
    links = connected(materialise(groups, "near-groups"), rows.select("row_id", "text"), lambda dealt: _confirm(dealt, shingle, percent), "near-links", block, block_mb << 20)
    labelled = classes.select(*same, "least_id", "row_id").join(links.withColumnRenamed("node", "row_id"), "row_id", "left").withColumn("comp", F.coalesce("comp", "row_id"))
    ids = labelled.groupBy("comp").agg(F.min("least_id").alias("component"))
    by_class = labelled.join(ids, "comp").select(*same, "component")
    own = F.coalesce("doc_id", F.lit(NULL_ID))
    out = signed.select("doc_id", *same).join(by_class, same, "left").withColumn("component", F.coalesce("component", own))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("component") != NULL_ID, F.col("component")).alias("component_id"), (own == F.col("component")).alias("kept"))
