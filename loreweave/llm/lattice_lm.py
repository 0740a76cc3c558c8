"""Subword-lattice likelihood of texts, and word counts of the training documents."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from copy import copy
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreweave.llm.common import NULL_ID, chunked, documents, map_batches, materialise, total_bytes, unpack_chunk

SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, mixed_score double, model_score double"
#: The end token's key among words; no word has white space.
END = b"\n"
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_MARK = "▁".encode()
#: Ranks count from here in the weights of pieces.
OFFSET = 2.7
#: Bytes of a word that are summed at once without logarithms: no value gets below 1e-300 by so many single bytes.
SHORT = 32
#: The share of the given weights in learned ones, so that each piece keeps some.
GIVEN = 0.01
#: Words of more bytes are no pieces of the model, which spells them.
WHOLE = 256
#: Expected numbers of pieces are added up as whole multiples of 2^-20, so their order makes no difference.
UNIT = 1 << 20


class Lattice:
    """Log-probabilities of words as sums over all their segmentations.

    Pieces of an existing vocabulary weigh 1 / (OFFSET - score), its scores being negative ranks. Pieces that begin a
    word, others, all single bytes and the end share one distribution, so the words' probabilities sum to 1 at most.
    Pieces with capitals A-Z or with an inner word mark can't occur and have no weight.
    """

    def __init__(self, path: str) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        begin: dict[bytes, float] = {}
        inner: dict[bytes, float] = {bytes([b]): 1 / (OFFSET + n) for b in range(256)}
        for i in range(n):
            if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i):
                continue
            piece = model.id_to_piece(i).encode()
            to, body = (begin, piece[len(_MARK) :]) if piece.startswith(_MARK) else (inner, piece)
            if _MARK not in body and body == body.translate(_LOWER):
                to[body] = to.get(body, 0) + 1 / (OFFSET - min(0.0, model.get_score(i)))
        begin.setdefault(b"", 1 / (OFFSET + n))
        end = 1 / OFFSET
        total = math.log(sum(begin.values()) + sum(inner.values()) + end)
        self.begin = {k: math.log(v) - total for k, v in begin.items()}
        self.inner = {k: math.log(v) - total for k, v in inner.items()}
        self.end = math.log(end) - total
        self.longest = max(map(len, [*self.begin, *self.inner]))
        self._index()

    def _index(self) -> None:
        """Pieces by their bytes, a dictionary for each, with weight and number at None."""
        self.tries: list[dict] = []
        for pieces, first in ((self.begin, 0), (self.inner, len(self.begin))):
            root: dict = {}
            for k, (piece, log_p) in enumerate(pieces.items(), first):
                at = root
                for b in piece:
                    at = at.setdefault(b, {})
                at[None] = (math.exp(log_p), k)
            self.tries.append(root)

    def learned(self, expected: np.ndarray) -> Lattice:
        """With weights in proportion to the pieces' expected numbers, first those that begin a word, and GIVEN of its own."""
        if not (total := float(expected.sum())):
            return self
        out = copy(self)
        left = 1 - math.exp(self.end)
        weights = [(1 - GIVEN) * left * x / total for x in expected.tolist()]
        out.begin = {k: math.log(GIVEN * math.exp(v) + x) for (k, v), x in zip(self.begin.items(), weights, strict=False)}
        out.inner = {k: math.log(GIVEN * math.exp(v) + x) for (k, v), x in zip(self.inner.items(), weights[len(self.begin) :], strict=True)}
        out._index()
        return out

    def _forward(self, word: bytes, first: bool, arcs: list[tuple[int, int, float, int]] | None = None) -> list[float]:
        """Probabilities to get to each place of a word of SHORT bytes at most, or of a slice of one; arcs get all pieces."""
        n = len(word)
        begin, inner = self.tries
        f = [0.0] * (n + 1)
        if first:
            at, j = begin, 0
            while at is not None:
                if (piece := at.get(None)) is not None:
                    f[j] += piece[0]
                    if arcs is not None:
                        arcs.append((-1, j, *piece))
                if j == n:
                    break
                at, j = at.get(word[j]), j + 1
        else:
            f[0] = 1.0
        for i in range(n):
            if not (a := f[i]):
                continue
            at, j = inner, i
            while j < n:
                if (at := at.get(word[j])) is None:
                    break
                j += 1
                if (piece := at.get(None)) is not None:
                    f[j] += a * piece[0]
                    if arcs is not None:
                        arcs.append((i, j, *piece))
        return f

    def expect(self, words: Iterable[bytes]) -> np.ndarray:
        """How often each piece is expected in the segmentations of words, each counted once.

        Of words over SHORT bytes slices are taken, at whose ends pieces end.
        """
        out = [0.0] * (len(self.begin) + len(self.inner))
        for word in words:
            for start in range(0, len(word), SHORT):
                part = word[start : start + SHORT]
                arcs: list[tuple[int, int, float, int]] = []
                f = self._forward(part, start == 0, arcs)
                back = [0.0] * len(part) + [1 / f[-1]]
                for i, j, p, k in reversed(arcs):
                    x = p * back[j]
                    if i < 0:
                        out[k] += x
                    else:
                        back[i] += x
                        out[k] += f[i] * x
        return np.array(out)

    def log_probability(self, word: bytes) -> float:
        """Forward recursion over the places of a word; in log space for long ones, where a ring holds the places that a piece can reach."""
        if word == END:
            return self.end
        if len(word) <= SHORT:
            return math.log(self._forward(word, True)[-1])
        n, longest, inner = len(word), self.longest, self.inner
        size = longest + 1
        ring: list[list[float]] = [[] for _ in range(size)]
        for j in range(min(n, longest) + 1):
            if (s := self.begin.get(word[:j])) is not None:
                ring[j].append(s)
        for i in range(n):
            if not (here := ring[i % size]):
                continue
            a = here[0] if len(here) == 1 else _log_sum(here)
            ring[i % size] = []
            for j in range(i + 1, min(n, i + longest) + 1):
                if (s := inner.get(word[i:j])) is not None:
                    ring[j % size].append(a + s)
        return _log_sum(ring[n % size])


def _log_sum(x: list[float]) -> float:
    m = max(x)
    return m + math.log(sum([math.exp(v - m) for v in x]))


@lru_cache(maxsize=2)
def lattice(path: str) -> Lattice:
    return Lattice(path)


def _words(raw: np.ndarray, offsets: np.ndarray) -> list[list[bytes]]:
    data = raw.tobytes().translate(_LOWER)
    at = offsets.tolist()
    return [data[a:b].split() for a, b in zip(at[:-1], at[1:], strict=True)]


def _trains(key: int) -> bool:
    return key == NULL_ID or zlib.crc32(str(key).encode()) % 10 != 0


def _by_owner(types: Iterable[bytes], owners: int) -> dict[int, list[bytes]]:
    """Sorted words of each owner that has any, in order of owner."""
    out: dict[int, list[bytes]] = {}
    for w in types:
        out.setdefault(zlib.crc32(w) % owners, []).append(w)
    return {o: sorted(out[o]) for o in sorted(out)}


SENT = "owner int, kind int, chunk_id long, words binary, counts binary"
#: Kinds of rows that an owner gets, in this order: counts to add up, then words to answer.
COUNTS, ASKED = 0, 1
ANSWERED = "chunk_id long, owner int, counts binary, log_p binary, tokens long, kinds long, ones long, twos long"
#: Distinct words in a row at most, of those that weights are learned from.
RUN = 1 << 16


def _send(chunks: DataFrame, owners: int) -> DataFrame:
    """For each chunk and owner: the words of training documents with their counts, and all distinct words."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows: list[tuple] = []
        for chunk, *packed in zip(*batch.columns, strict=True):
            keys, raw, offsets = unpack_chunk(*packed)
            seen: Counter = Counter()
            other: set[bytes] = {END}
            for key, words in zip(keys.tolist(), _words(raw, offsets), strict=True):
                if _trains(key):
                    seen.update(words)
                    seen[END] += 1
                else:
                    other.update(words)
            for owner, words in _by_owner(other.union(seen), owners).items():
                known = [w for w in words if w in seen]
                if known:
                    rows.append((owner, COUNTS, chunk.as_py(), b" ".join(known), np.array([seen[w] for w in known], np.int32).tobytes()))
                rows.append((owner, ASKED, chunk.as_py(), b" ".join(words), None))
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["owner", "kind", "chunk_id", "words", "counts"])

    return map_batches(chunks, one, SENT)


class _Owned:
    """The words of one owner: their counts and lattice values, each computed once."""

    def __init__(self, lat: Lattice) -> None:
        self.lat = lat
        self.index: dict[bytes, int] = {}
        self.fresh: list[bytes] = []
        self.count, self.log_p = np.zeros(1024, np.int64), np.zeros(1024, np.float32)
        self.done = 0

    def places(self, words: list[bytes]) -> np.ndarray:
        index, before = self.index, len(self.index)
        at = np.array([index.setdefault(w, len(index)) for w in words], np.int64)
        if len(index) > before:
            self.fresh += [words[i] for i in np.flatnonzero(at >= before).tolist()]
            if len(index) > len(self.count):
                self.count, self.log_p = (np.concatenate((x, np.zeros(2 * len(index) - len(x), x.dtype))) for x in (self.count, self.log_p))
        return at

    def answer(self, words: list[bytes]) -> tuple[bytes, bytes]:
        at = self.places(words)
        for i, w in enumerate(self.fresh, self.done):
            self.log_p[i] = self.lat.log_probability(w)
        self.done, self.fresh = len(self.index), []
        return self.count[at].tobytes(), self.log_p[at].tobytes()


def _types(sent: DataFrame, owners: int) -> DataFrame:
    """The distinct training words of each owner but the end, in order, RUN in a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner: int | None = None
        held: set[bytes] = set()

        def given() -> Iterator[pa.RecordBatch]:
            words = sorted(held - {END})
            for i in range(0, len(words), RUN):
                yield pa.RecordBatch.from_arrays([pa.array([b" ".join(words[i : i + RUN])], pa.binary())], names=["words"])

        for batch in batches:
            for o, words in zip(*batch.columns, strict=True):
                if o.as_py() != owner:
                    yield from given()
                    owner, held = o.as_py(), set()
                held.update(words.as_py().split(b" "))
        yield from given()

    own = sent.filter(F.col("kind") == COUNTS).select("owner", "words")
    return own.repartitionById(owners, "owner").sortWithinPartitions("owner").mapInArrow(run, "words binary")


def learn(types: DataFrame, vocabulary: str, rounds: int) -> np.ndarray | None:
    """Expected numbers of pieces in distinct words after some rounds of expectation and maximisation; None without words.

    The driver gets a number for each piece of the vocabulary, so as many whatever the input.
    """
    expected: np.ndarray | None = None

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat, total = _weighed(vocabulary, expected), None
        for batch in batches:
            for words in batch.column(0):
                got = np.rint(lat.expect(words.as_py().split(b" ")) * UNIT).astype(np.int64)
                total = got if total is None else total + got
        if total is not None:
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["piece", "units"])

    for _ in range(rounds):
        rows = types.mapInArrow(count, "piece int, units long").groupBy("piece").agg(F.sum(F.col("units").cast("decimal(38)")).alias("units")).collect()  # a row for each piece
        if not rows:
            return None
        lat = lattice(vocabulary)
        expected = np.zeros(len(lat.begin) + len(lat.inner))
        for r in rows:
            expected[r["piece"]] = int(r["units"]) / UNIT
    return expected


def _weighed(vocabulary: str, expected: np.ndarray | None) -> Lattice:
    return lattice(vocabulary) if expected is None else lattice(vocabulary).learned(expected)


def _answer(sent: DataFrame, owners: int, vocabulary: str, expected: np.ndarray | None) -> DataFrame:
    """Owners add up counts, compute each distinct word's lattice once, and answer every chunk in its order.

    Each owner is a task, so tasks grow in number with the input. An owner's rows pass in order, first all counts, then what chunks ask for, so it holds its distinct words only.
    tokens and kinds, the sums over the owner's words, and how many of these occur once and twice stand in a row of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat, owner, own, summed = _weighed(vocabulary, expected), None, None, False
        rows: list[tuple] = []
        held = 0

        def given() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["chunk_id", "owner", "counts", "log_p", "tokens", "kinds", "ones", "twos"])

        for batch in batches:
            for o, kind, chunk, words, counts in zip(*batch.columns, strict=True):
                if o.as_py() != owner:
                    owner, own, summed = o.as_py(), _Owned(lat), False
                words = words.as_py().split(b" ")
                if kind.as_py() == COUNTS:
                    at = own.places(words)  # may make room in count
                    own.count[at] += np.frombuffer(counts.as_py(), np.int32)
                    continue
                if not summed:
                    rows.append((None, owner, None, None, int(own.count.sum()), int((own.count > 0).sum()), int((own.count == 1).sum()), int((own.count == 2).sum())))
                    summed = True
                rows.append((chunk.as_py(), owner, *own.answer(words), None, None, None, None))
                held += 12 * len(words)
                if held > 8 << 20:
                    yield given()
                    rows, held = [], 0
        if rows:
            yield given()

    return sent.repartitionById(owners, "owner").sortWithinPartitions("owner", "kind", "chunk_id").mapInArrow(run, ANSWERED)


def lattice_lm(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", chunk_mb: int = 8, owner_mb: int = 8, most_owners: int = 16_384, rounds: int = 0) -> DataFrame:
    """Scores every whole text: log10 of its marginal probability over all segmentations.

    Tokens are the words between white space with A-Z lower-cased, then one end. score sums the tokens' lattice
    probabilities, each a sum over all segmentations to pieces of ``vocabulary``, the path of an existing sentencepiece
    model on every executor.

    Documents whose crc32 of doc_id (as text) is not 0 modulo 10 are for training: c, N and V are their counts.
    base_score is the add-0.1 unigram score. mixed_score gives a token the probability (c + V * lattice) / (N + V).

    ``rounds``: rounds of expectation and maximisation, in which pieces learn their weights from the distinct training words,
    each counted once, as words come that are new; with 0 they keep the weights of the vocabulary. model_score is the
    model that has learned: the lattice has training words of WHOLE bytes at most as pieces too. A discount D of their counts, by the numbers of
    words that occur once and twice, goes to spelling: a token has (c - D) / N, if it is such a word, + D * V / N * lattice.

    Chunks of documents send distinct words to owners by hash and get counts and lattice values back as packed arrays
    (the latter as 32-bit floats), so frequent words travel once per chunk. There is an owner for each ``owner_mb`` of
    input, but ``most_owners`` at most, so that a chunk has many words for each; an owner holds its distinct words only.

    A null text counts as empty (one token, the end); a null id is for training. With no training documents, N is 0
    and base_score log10(1/(V+1)) a token. Rows that share an id count as different documents. Texts and words of any
    length are scored whole. An empty table gives an empty result; other columns are ignored, whatever their names.
    """
    chunks = chunked(documents(docs, id_col, text_col), chunk_mb << 20, "lm-chunks")
    owners = min(most_owners, max(8, -(-total_bytes(chunks) // (owner_mb << 20))))
    sent, expected = _send(chunks, owners), None
    if rounds:
        sent = materialise(sent, "lm-words")
        expected = learn(materialise(_types(sent, owners), "lm-types", 1), vocabulary, rounds)
    answers = materialise(_answer(sent, owners, vocabulary, expected), "lm-answers")
    tokens, kinds, ones, twos = (x or 0 for x in answers.agg(*map(F.sum, ("tokens", "kinds", "ones", "twos"))).first())
    mass = float(max(1, kinds))
    off = (ones + 0.5) / (ones + 2 * twos + 1)
    spelled = off * kinds / tokens if tokens else 1.0

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        answer = {o: (np.frombuffer(c, np.int64), np.frombuffer(p, np.float32)) for o, c, p in zip(right["owner"].to_pylist(), right["counts"].to_pylist(), right["log_p"].to_pylist(), strict=True)}
        for doc_ids, *packed in zip(left["doc_ids"], left["sizes"], left["data"], strict=True):
            keys, raw, offsets = unpack_chunk(doc_ids, *packed)
            words = _words(raw, offsets)
            every = {w for x in words for w in x} | {END}
            index: dict[bytes, int] = {}
            counts, logs, whole = [], [], []
            for owner, mine in _by_owner(every, owners).items():
                index.update(zip(mine, range(len(index), len(index) + len(mine)), strict=True))
                counts.append(answer[owner][0])
                logs.append(answer[owner][1])
                whole += [len(w) <= WHOLE for w in mine]
            c = np.concatenate(counts).astype(np.float64)
            base = np.log10((c + 0.1) / (tokens + 0.1 * (kinds + 1)))
            log_p = np.concatenate(logs).astype(np.float64)
            with np.errstate(divide="ignore"):
                mixed = (np.logaddexp(np.log(c), math.log(mass) + log_p) - math.log(tokens + mass)) / math.log(10)
                model = np.logaddexp(np.log(np.where(whole, np.maximum(c - off, 0), 0) / max(1, tokens)), math.log(spelled) + log_p) / math.log(10)
            score = log_p / math.log(10)
            at = np.fromiter((index[w] for x in words for w in (*x, END)), np.int64, sum(map(len, words)) + len(words))
            n = np.array([len(x) + 1 for x in words], np.int64)
            first = np.cumsum(n) - n
            out.append(pa.table({
                "doc_id": doc_ids.values, "held_out": pa.array([not _trains(k) for k in keys.tolist()]), "n_tokens": pa.array(n), "n_known": pa.array(np.add.reduceat((c > 0)[at].astype(np.int64), first)), "train_tokens": pa.array(np.full(len(n), tokens, np.int64)),
                "base_score": pa.array(np.add.reduceat(base[at], first)), "score": pa.array(np.add.reduceat(score[at], first)), "mixed_score": pa.array(np.add.reduceat(mixed[at], first)), "model_score": pa.array(np.add.reduceat(model[at], first)),
            }))
        return pa.concat_tables(out)

    replies = answers.filter("chunk_id is not null").select("chunk_id", "owner", "counts", "log_p")
    return chunks.groupBy("chunk_id").cogroup(replies.groupBy("chunk_id")).applyInArrow(one, SCHEMA)
