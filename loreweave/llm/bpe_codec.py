"""Byte-level BPE encoding and decoding through a sentencepiece model made from a rank file."""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from loreweave.llm.common import documents
from loreweave.llm.pretokens import Memo, byte_alphabet, split

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Bytes, about, that a worker remembers pre-tokens in.
MEMO = 100 << 20
#: Ids of about so many bytes of text leave a task at once.
FLUSH = 8 << 20


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by rank; the file has a base64 token and its rank in each line."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    ranks = {int(r): base64.b64decode(t) for t, r in pairs}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError(f"{path}: ranks must count from 0 without gaps")
    return [ranks[i] for i in range(len(ranks))]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float | str) -> bytes:
    """A field of a protocol buffer: float and integer scalars, strings and messages."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value & 0xFFFFFFFFFFFFFFFF)
    value = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def sentencepiece_model(tokens: list[bytes]) -> bytes:
    """A serialised BPE model: piece i+1 is token i with its bytes mapped to characters, scored by its negative rank.

    Piece 0 is the unknown piece that every model must have. Normalisation is the identity: no dummy prefix, no
    removed or escaped white space.
    """
    alphabet = byte_alphabet()
    pieces = [_field(1, "<unk>") + _field(2, 0.0) + _field(3, 2)]
    pieces += [_field(1, "".join(alphabet[b] for b in t)) + _field(2, float(-i)) for i, t in enumerate(tokens)]
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(35, 0) + _field(40, 0) + _field(41, -1) + _field(42, -1) + _field(43, -1)
    normaliser = _field(1, "identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normaliser)


class Codec:
    """Encodes texts to token ids (ranks) and decodes ids to bytes."""

    def __init__(self, path: str) -> None:
        tokens = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(tokens))
        self.alphabet = byte_alphabet()
        byte_of = {c: b for b, c in enumerate(self.alphabet)}
        #: Of each id, its piece with characters mapped back to bytes.
        self.pieces = [bytes(map(byte_of.__getitem__, self.model.id_to_piece(i + 1))) for i in range(len(tokens))]
        self.memo = Memo(self._packed, MEMO)

    def _packed(self, pretokens: list[str]) -> list[bytes]:
        """Ids of each pre-token as little-endian 32-bit integers."""
        table = self.alphabet
        mapped = [t if t.isascii() and t.isalnum() else "".join([table[b] for b in t.encode()]) for t in pretokens]
        return [(np.array(ids, np.uint32) - np.uint32(1)).tobytes() for ids in self.model.encode(mapped, num_threads=1)]

    def encode(self, text: str) -> bytes:
        """The ids of a text, packed."""
        return b"".join(self.memo.of(split(text)))

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(packed, "<u4").tolist()))


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def bpe_encode(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """Encodes every whole text and decodes the ids again.

    vocabulary: path of a rank file, on every executor. Each pre-token of the public pattern is encoded separately,
    without special tokens. A null text counts as empty and has no tokens; an empty table gives an empty result.
    Rows are independent, so repeated ids and other columns don't matter. A text of any length is encoded whole.

    ids: adds the column ids (array<int>).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)

        def rows(keys: list, packed: list[bytes], back: list[str]) -> pa.RecordBatch:
            n = [len(x) // 4 for x in packed]
            out = {"doc_id": pa.array(keys, pa.int64()), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in packed], pa.string()), "decoded_sha256": pa.array(back, pa.string())}
            if ids:
                flat = pa.array(np.frombuffer(b"".join(packed), np.int32))
                out["ids"] = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), flat)
            return pa.RecordBatch.from_pydict(out)

        for batch in batches:
            keys, packed, back, held = [], [], [], 0
            for key, text in zip(*batch.columns, strict=True):
                ids_of = c.encode(text.as_py() or "")
                keys.append(key.as_py())
                packed.append(ids_of)
                back.append(hashlib.sha256(c.decode(ids_of)).hexdigest())
                held += len(ids_of)
                if held > FLUSH:
                    yield rows(keys, packed, back)
                    keys, packed, back, held = [], [], [], 0
            if keys:
                yield rows(keys, packed, back)

    return documents(docs, id_col, text_col).mapInArrow(run, SCHEMA + (", ids array<int>" if ids else ""))
