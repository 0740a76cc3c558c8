"""Alignment of the tokens of two tokenizers, and corpus-wide counts of the pairs that end together."""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreweave.llm.common import documents, materialise, owned_path, text_slices, whole_groups
from loreweave.llm.pretokens import byte_alphabet
from loreweave.llm.warc import Opened, _create, _local

SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, keys array<long>, times array<int>"
#: A cut of a text is before a space that has a character on either side that is no white space, whatever version of
#: Unicode one goes by, nor U+2581, which B's pieces have for a space.
_SOLID = r"[^\s\x00-\x20\x7f-\xa0 ᠎ -⁯▁　﻿]"
_CUT = re.compile(rf"(?<={_SOLID})(?= {_SOLID})")
_SOLID_AT = re.compile(_SOLID)
#: Characters of texts that are aligned at once, and of parts that a library encodes at once.
SLICE, JOINED = 1 << 20, 1 << 16
#: Parts of texts that are remembered: of so many characters at most, in so many bytes about.
LONGEST, MEMO_BYTES = 64, 128 << 20
#: Links whose counts are looked up at once, and distinct pairs that a task holds before it gives their counts away.
ROWS, HELD_PAIRS = 1 << 18, 1 << 21


@dataclass
class Cut:
    """The alignment of one text or piece of it: numbers of tokens, the groups written out, and the keys of their links."""

    n_a: int
    n_b: int
    told: bytes
    keys: np.ndarray


class Aligner:
    """Encodes texts by a byte-level BPE file (A) and a sentencepiece file (B), and cuts them where tokens of both end."""

    def __init__(self, path_a: str, path_b: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path_a, encoding="utf-8") as f:
            spec = json.load(f)
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte_of = {c: b for b, c in enumerate(byte_alphabet())}
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        #: Bytes of each id; an added token, which encodes nothing here, has none.
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for t, i in vocabulary.items():
            self.bytes_a[i] = bytes(map(byte_of.__getitem__, t)) if all(c in byte_of for c in t) else b""
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.sizes_a, self.sizes_b = (np.array([len(x) for x in of], np.int64) for of in (self.bytes_a, self.bytes_b))
        split = spec["pre_tokenizer"] or {}
        plain_a = spec["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        # B puts a space before what it encodes, and changes nothing else
        plain_b = all("".join(self.b.encode(t, out_type=str)) == f"▁{t}".replace(" ", "▁") for t in ("a  b ", " a", "ﬁ Å"))
        #: Whether both encode the parts between cuts as they encode the whole: A splits there before it merges, and B
        #: has no piece with a space after something else.
        self.local = plain_a and plain_b and not any(re.search("[^▁]▁", p) for p in pieces)
        #: Packed ids of A and B for each part; None where their bytes aren't those of the part.
        self.memo: dict[str, tuple[bytes, bytes] | None] = {}
        self.memo_bytes = 0

    def _single(self, part: str) -> tuple[bytes, bytes] | None:
        a, b = self.a.encode_batch_fast([part], add_special_tokens=False)[0].ids, self.b.encode(part[1:])
        raw = part.encode()
        if not b"".join([self.bytes_a[i] for i in a]) == b"".join([self.bytes_b[i] for i in b]) == raw:
            return None
        return np.array(a, np.int32).tobytes(), np.array(b, np.int32).tobytes()

    def _many(self, parts: list[str]) -> list[tuple[bytes, bytes] | None]:
        """Parts between cuts, encoded as one text, whose ids are dealt to them by the bytes that they stand for."""
        text = "".join(parts)
        raw = text.encode()
        a, b = self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.b.encode(text[1:])
        if not b"".join([self.bytes_a[i] for i in a]) == b"".join([self.bytes_b[i] for i in b]) == raw:
            return [self._single(p) for p in parts]
        ends = np.cumsum([len(p) for p in parts] if len(raw) == len(text) else [len(p.encode()) for p in parts])
        dealt = []
        for ids, sizes in ((a, self.sizes_a), (b, self.sizes_b)):
            ids = np.array(ids, np.int32)
            packed, at = ids.tobytes(), (4 * (np.searchsorted(np.cumsum(sizes[ids]), ends) + 1)).tolist()
            dealt.append([packed[x:y] for x, y in zip([0, *at[:-1]], at, strict=True)])
        return list(zip(*dealt, strict=True))

    def learn(self, parts: set[str]) -> dict[str, tuple[bytes, bytes] | None]:
        """Ids of parts that aren't remembered. What is short is from now on; what is long is given back only."""
        if self.memo_bytes > MEMO_BYTES:
            self.memo.clear()
            self.memo_bytes = 0
        joint, once, held, size = [], {}, [], 0
        for p in parts:
            if p in self.memo:
                continue
            if self.local and len(p) <= LONGEST and len(p) > 1 and _SOLID_AT.match(p, 1) and _SOLID_AT.match(p, len(p) - 1):
                held.append(p)
                size += len(p)
                if size > JOINED:
                    joint.append(held)
                    held, size = [], 0
            else:
                once[p] = self._single(p)
        for some in [*joint, held] if held else joint:
            for p, ids in zip(some, self._many(some), strict=True):
                self.memo[p] = ids
                self.memo_bytes += 320 + len(p) + (len(ids[0]) + len(ids[1]) if ids else 0)
        for p in [p for p in once if len(p) <= LONGEST]:
            self.memo[p] = once.pop(p)
            self.memo_bytes += 500
        return once

    def pieces(self, text: str) -> Iterator[list[str]]:
        """The text behind a space, cut to parts; those of some SLICE characters together."""
        text = f" {text}"
        at = 0
        while at < len(text):
            m = _CUT.search(text, at + SLICE) if self.local and len(text) - at > SLICE else None
            end = m.start() if m else len(text)
            yield _CUT.split(text[at:end]) if self.local else [text[at:end]]
            at = end

    def align(self, pieces: list[list[str]]) -> list[Cut | None]:
        """Alignments of pieces of texts, all at once; None for a piece whose bytes the tokens don't give."""
        if self.memo_bytes > MEMO_BYTES:
            self.memo.clear()
            self.memo_bytes = 0
        ids = self.memo | once if (once := self.learn({p for parts in pieces for p in parts})) else self.memo
        found = [[ids[p] for p in parts] for parts in pieces]
        whole = [None not in x for x in found]
        packed = [(b"".join([a for a, _ in x]), b"".join([b for _, b in x])) for x, good in zip(found, whole, strict=True) if good]
        cuts = iter(self._cut([a for a, _ in packed], [b for _, b in packed]))
        return [next(cuts) if good else None for good in whole]

    def _cut(self, packed_a: list[bytes], packed_b: list[bytes]) -> list[Cut]:
        """Cuts the tokens of some pieces, which have the same bytes by A and B, where tokens of both end."""
        n_a, n_b = ([len(x) // 4 for x in packed] for packed in (packed_a, packed_b))
        a, b = (np.frombuffer(b"".join(packed), np.int32).astype(np.int64) for packed in (packed_a, packed_b))
        if not len(a):
            return [Cut(0, 0, b"", np.empty(0, np.int64)) for _ in n_a]
        ends_a, ends_b = np.cumsum(self.sizes_a[a]), np.cumsum(self.sizes_b[b])
        has = np.zeros((2, int(ends_a[-1]) + 1), bool)
        has[0, ends_a], has[1, ends_b] = True, True
        last_a, last_b = has[1, ends_a], has[0, ends_b]  # whether a token is the last of its group
        to_a, to_b = np.flatnonzero(last_a), np.flatnonzero(last_b)
        keys = b[to_b] << 32 | a[to_a]
        # a group's tokens of A, then its tokens of B
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        at_a, at_b = np.arange(len(a)) + np.concatenate(([0], to_b + 1))[group_a], np.arange(len(b)) + (to_a + 1)[group_b]
        number, mark = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
        number[at_a], number[at_b] = a, b
        mark[at_a[to_a]], mark[at_b[to_b]] = ord("|"), ord(";")
        written, ends = decimal(number, mark)
        # where pieces end among tokens, groups and bytes
        tokens = np.cumsum(n_a) + np.cumsum(n_b)
        groups = [0, *np.searchsorted(to_a, np.cumsum(n_a)).tolist()]
        bytes_to = [0, *np.concatenate(([0], ends))[tokens].tolist()]
        return [Cut(x, y, written[i : max(i, j - 1)].tobytes(), keys[g:h]) for x, y, i, j, g, h in zip(n_a, n_b, bytes_to[:-1], bytes_to[1:], groups[:-1], groups[1:], strict=True)]


def decimal(numbers: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers in decimal, each with its mark behind it, as bytes; and where each ends."""
    digits = np.ones(len(numbers), np.int64)
    most = 10
    while (longer := numbers >= most).any():
        digits += longer
        most *= 10
    ends = np.cumsum(digits + 1)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    out[ends - 1] = marks
    at, rest = ends - 2, numbers
    while len(at):
        out[at] = rest % 10 + 48
        more = rest >= 10
        at, rest = at[more] - 1, rest[more] // 10
    return out, ends


class _Told:
    """What is gathered about one text, a piece at a time."""

    def __init__(self) -> None:
        self.n_a = self.n_b = self.n_groups = 0
        self.sha, self.told = hashlib.sha256(), []
        self.keys, self.times = np.empty(0, np.int64), np.empty(0, np.int64)
        self.found = False

    def add(self, cut: Cut, keep: bool) -> None:
        self.n_a, self.n_b, self.n_groups = self.n_a + cut.n_a, self.n_b + cut.n_b, self.n_groups + len(cut.keys)
        self.sha.update(b";" + cut.told if self.found else cut.told)
        if keep:
            self.told.append(cut.told)
        keys, times = np.unique(cut.keys, return_counts=True)
        self.keys, self.times = merged([(self.keys, self.times), (keys, times)]) if self.found else (keys, times)
        self.found = True


def merged(counts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys of some counts, and their sums."""
    keys, which = np.unique(np.concatenate([k for k, _ in counts]), return_inverse=True)
    out = np.zeros(len(keys), np.int64)
    np.add.at(out, which, np.concatenate([n for _, n in counts]))
    return keys, out


@lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def align(docs: DataFrame, path_a: str, path_b: str, *, id_col: str = "doc_id", text_col: str = "text", groups: bool = False) -> DataFrame:
    """A row for each text: its numbers of tokens, groups and links, and its distinct links (b << 32 | a) and how often it has each.

    groups: adds the column groups, the alignment written out. See cross_tokenizer.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(path_a, path_b)

        def told(texts: pa.Array) -> list[_Told]:
            rows = [_Told() for _ in texts]
            held: list[tuple[int, list[str]]] = []

            def add() -> None:
                for (k, _), cut in zip(held, own.align([parts for _, parts in held]), strict=True):
                    if cut is None:
                        rows[k] = None
                    elif rows[k] is not None:
                        rows[k].add(cut, groups)
                held.clear()

            for k, text in enumerate(texts):
                for parts in own.pieces(text.as_py()) if text.as_py() else ():
                    held.append((k, parts))
                    if len(texts) == 1:  # a long text, of which a piece at a time is enough
                        add()
            add()
            return [r or _Told() for r in rows]

        for batch in batches:
            for i, j in text_slices(batch.column(1), SLICE):
                rows = told(batch.column(1).slice(i, j - i))
                ends = pa.array(np.cumsum([0, *(len(r.keys) for r in rows)]), pa.int32())
                numbers = {c: pa.array([getattr(r, f) for r in rows], pa.int64()) for c, f in (("n_a", "n_a"), ("n_b", "n_b"), ("n_groups", "n_groups"), ("n_links", "n_groups"))}
                out = {"doc_id": batch.column(0).slice(i, j - i), **numbers, "groups_sha256": pa.array([r.sha.hexdigest() if r.found else "" for r in rows], pa.string())}
                out["keys"] = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([r.keys for r in rows]), pa.int64()))
                out["times"] = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([r.times for r in rows]), pa.int32()))
                if groups:
                    out["groups"] = pa.array([b";".join(r.told).decode() for r in rows], pa.string())
                yield pa.RecordBatch.from_pydict(out)

    return documents(docs, id_col, text_col).mapInArrow(run, ALIGNED + (", groups string" if groups else ""))


@dataclass(frozen=True)
class PairCounts:
    """Counts of all pairs in sorted shards on shared files, and of each id of B its highest.

    A pair that ends together has one token's bytes at the end of the other's, so there are no more pairs than the
    bytes of both vocabularies, however large the corpus is.
    """

    shards: list[tuple[str, int, int]]  # path, first key, number of pairs; in order
    best: np.ndarray


class Lookup:
    """Counts of keys from memory-mapped shards."""

    def __init__(self, counts: PairCounts) -> None:
        self.first = [s[1] for s in counts.shards]
        self.shards = [self._open(path, n) for path, _, n in counts.shards]

    @staticmethod
    def _open(path: str, n: int) -> np.ndarray:
        """Keys in the first row, counts in the second. A file that isn't on a mounted folder is read instead."""
        if (local := _local(path)) is not None:
            return np.memmap(local, np.int64, "r", shape=(2, n))
        f = Opened(path)
        try:
            return np.frombuffer(f.read(0, 16 * n), np.int64).reshape(2, n)
        finally:
            f.close()

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The counts of sorted keys that all are there."""
        out = np.empty(len(keys), np.int64)
        at = 0
        while at < len(keys):
            k = bisect_right(self.first, int(keys[at])) - 1
            end = int(np.searchsorted(keys, self.first[k + 1])) if k + 1 < len(self.first) else len(keys)
            shard = self.shards[k]
            out[at:end] = shard[1][np.searchsorted(shard[0], keys[at:end])]
            at = end
        return out


def count_pairs(aligned: DataFrame, size_b: int) -> PairCounts:
    """Counts of the links of all rows of ``aligned`` (keys, times); size_b: how many ids B has.

    Each task merges its keys by np.unique. Their partial counts are sorted globally by ranges of key, and each range sums its runs
    and writes a shard. A key's partial counts are one for each task or a few, so no range has more rows than tasks times pairs.
    The driver gets a row for each shard, and the highest counts in it of each id of B.
    """
    spark = aligned.sparkSession

    def partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0

        def rows(keys: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"key": pa.array(keys), "n": pa.array(times)})

        for batch in batches:
            keys, times = (batch.column(i).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            if not len(keys):
                continue
            held.append(merged([(keys, times)]))
            n += len(held[-1][0])
            if n > HELD_PAIRS:
                held = [merged(held)]
                n = len(held[0][0])
                if n > HELD_PAIRS // 2:
                    yield rows(*held.pop())
                    n = 0
        if held:
            yield rows(*merged(held))

    folder = owned_path(spark, "pair-counts")

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sums = [], []
        for t, at in whole_groups(batches, 1):
            keys.append(t["key"].to_numpy()[at[:-1]])
            sums.append(np.add.reduceat(t["n"].to_numpy(), at[:-1]))
        if keys:
            key, n = np.concatenate(keys), np.concatenate(sums)
            path = f"{folder}/{uuid.uuid4().hex}"  # of a task that is tried again, only the files that its last row names count
            f = _create(path)
            f.write(np.stack((key, n)).tobytes())
            f.close()
            first = np.flatnonzero(np.concatenate(([True], key[1:] >> 32 != key[:-1] >> 32)))
            yield pa.RecordBatch.from_pydict({"path": [path], "first": pa.array(key[:1]), "n": pa.array([len(key)], pa.int64()), "b": pa.array([key[first] >> 32], pa.list_(pa.int64())), "best": pa.array([np.maximum.reduceat(n, first)], pa.list_(pa.int64()))})

    partial = materialise(aligned.select("keys", "times").mapInArrow(partial_counts, "key long, n long"), "pair-partial")
    shards = partial.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(shard, "path string, first long, n long, b array<long>, best array<long>")
    best, found = np.zeros(size_b, np.int64), []
    for r in sorted(shards.collect(), key=lambda r: r["first"]):
        found.append((r["path"], r["first"], r["n"]))
        np.maximum.at(best, np.array(r["b"], np.int64), np.array(r["best"], np.int64))
    return PairCounts(found, best)


def cross_tokenizer(docs: DataFrame, path_a: str, path_b: str, *, id_col: str = "doc_id", text_col: str = "text", groups: bool = False) -> DataFrame:
    """Aligns the tokens of two tokenizers in every whole text and tells how common its links are in all texts.

    path_a: a byte-level BPE file, path_b: a sentencepiece BPE file, both on every executor. A encodes a space and the text,
    B the text, before which it puts a space itself; strings of special tokens are plain text. Offsets at which tokens
    of both end cut the tokens into groups. A link is a token of A and a token of B that end together; as no
    token is empty, a group has one, that of its last tokens, and n_links equals n_groups. The count of a pair of ids
    is the number of links in all rows that hold it; repeated rows count each time. n_best: links whose count is the
    highest that their id of B has, ties included; count_sum: the sum of the counts of the links.

    A null or empty text, and one whose tokens' bytes aren't those of the space and the text (such as one with U+2581),
    has zeros and an empty groups_sha256. An empty table gives an empty result; other columns are ignored, whatever their
    names. A text of any length is aligned whole, in parts between which both tokenizers split; a part without
    such a place goes to the libraries as it is, which take about 100 bytes a character.

    groups: adds the column groups, the alignment written out.
    """
    aligned = materialise(align(docs, path_a, path_b, id_col=id_col, text_col=text_col, groups=groups), "aligned")
    size_b = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    shipped = docs.sparkSession.sparkContext.broadcast(count_pairs(aligned, size_b))  # a number for each id of B

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, best = Lookup(shipped.value), shipped.value.best
        for whole in batches:
            sizes = np.cumsum(whole.column("keys").value_lengths().to_numpy(zero_copy_only=False))
            lo = 0
            while lo < whole.num_rows:
                hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + ROWS, side="right")))
                batch, lo = whole.slice(lo, hi - lo), hi
                column = dict(zip(batch.schema.names, batch.columns, strict=True))
                keys, times = (column[c].flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("keys", "times"))
                distinct, which = np.unique(keys, return_inverse=True)
                n = lookup.of(distinct)
                top = n == best[distinct >> 32]
                ends = np.concatenate(([0], np.cumsum(column["keys"].value_lengths().to_numpy(zero_copy_only=False))))
                for c, v in (("n_best", times * top[which]), ("count_sum", times * n[which])):
                    sums = np.concatenate(([0], np.cumsum(v)))
                    column[c] = pa.array(sums[ends[1:]] - sums[ends[:-1]], pa.int64())
                yield pa.RecordBatch.from_pydict({c: column[c] for c in names})

    schema = SCHEMA + (", groups string" if groups else "")
    names = [f.split()[0] for f in schema.split(", ")]
    return aligned.mapInArrow(run, schema)


def pair_table(counts: PairCounts, spark) -> DataFrame:
    """The counts as rows a_id, b_id and n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                key, n = Lookup._open(path, n)
                yield pa.RecordBatch.from_pydict({"a_id": pa.array(key & 0xFFFFFFFF), "b_id": pa.array(key >> 32), "n": pa.array(np.array(n))})

    files = spark.createDataFrame([(p, n) for p, _, n in counts.shards], "path string, n long")
    return files.mapInArrow(run, "a_id long, b_id long, n long").select(F.col("a_id"), "b_id", "n")
