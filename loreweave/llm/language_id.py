"""Language identification by string kernels: Nyström landmarks and one-versus-rest kernel ridge regression."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreweave.llm.common import crc32_id, row_struct, with_row

SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"
UNKNOWN = "und"
#: Substrings of 1 to 4 bytes; those of 3 and 4 share 2**17 slots each by hash.
_SLOT_BITS = 17
_SLOTS = 256 + 65536 + 2 * (1 << _SLOT_BITS)
_STEP = 1 << 16


def _hashed(code: np.ndarray, base: int) -> np.ndarray:
    return ((code.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(32 - _SLOT_BITS)).astype(np.int64) + base


class Spectrum:
    """Which substrings of the blended spectrum a text has; one reusable bit map."""

    def __init__(self) -> None:
        self.has = np.zeros(_SLOTS, np.uint8)

    def of(self, text: str) -> np.ndarray:
        """The bit map of the lower-cased text; valid until the next call."""
        self.has[:] = 0
        raw = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)
        for i in range(0, len(raw), _STEP):
            b = raw[i : i + _STEP + 3].astype(np.uint32)
            self.has[b] = 1
            two = b[:-1] << np.uint32(8) | b[1:]
            self.has[two + np.uint32(256)] = 1
            three = two[:-1] << np.uint32(8) | b[2:]
            self.has[_hashed(three, 256 + 65536)] = 1
            self.has[_hashed(three[:-1] << np.uint32(8) | b[3:], 256 + 65536 + (1 << _SLOT_BITS))] = 1
        return self.has


@dataclass(frozen=True)
class KernelModel:
    """Languages; the slots that landmarks have; and, for each slot and language, the weight that ridge regression in
    the Nyström space gives to a text that has it (before division by the root of the text's number of slots).
    """

    languages: list[str]
    slots: np.ndarray
    weights: np.ndarray

    def scores(self, texts: list[str], spectrum: Spectrum) -> np.ndarray:
        """One row for each text: its regression value for each language, about 1 for its own and -1 for others."""
        has = np.empty((len(texts), len(self.slots)), np.float32)
        size = np.empty(len(texts))
        for i, t in enumerate(texts):
            own = spectrum.of(t)
            has[i] = own[self.slots]
            size[i] = max(1, np.count_nonzero(own))
        return (has @ self.weights) / np.sqrt(size)[:, None]


def fit(texts: list[str], labels: list[str], landmarks: int, ridge: float) -> KernelModel:
    """K(x, y) is the number of substrings that both have over the root of the product of their numbers.

    Landmarks are spread evenly over the languages. With the landmark kernel M, a text's features are
    M**-1/2 K(landmarks, text); ridge regression on them separates each language from the rest.
    """
    languages = sorted(set(labels))
    if not languages:
        return KernelModel([], np.empty(0, np.int64), np.empty((0, 0), np.float32))
    spectrum = Spectrum()
    maps = np.stack([np.packbits(spectrum.of(t)) for t in texts])
    per = max(1, landmarks // len(languages))
    chosen = [i for lang in languages for i in [j for j, x in enumerate(labels) if x == lang][:per]]
    marks = np.unpackbits(maps[chosen], axis=1, count=_SLOTS)
    slots = np.flatnonzero(marks.any(axis=0))
    size = np.array([int(np.bitwise_count(m).sum()) for m in maps], np.float64).clip(1)
    marks = marks[:, slots].astype(np.float32) / np.sqrt(size[chosen])[:, None].astype(np.float32)
    kernel = np.empty((len(texts), len(chosen)))
    for i in range(0, len(texts), 256):
        rows = np.unpackbits(maps[i : i + 256], axis=1, count=_SLOTS)[:, slots].astype(np.float32)
        kernel[i : i + 256] = (rows @ marks.T) / np.sqrt(size[i : i + 256])[:, None]
    value, vector = np.linalg.eigh(kernel[chosen])
    root = vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-6))) @ vector.T
    x = kernel @ root
    y = np.where(np.array(labels)[:, None] == np.array(languages)[None], 1.0, -1.0)
    # each language and the rest weigh the same
    mass = np.where(y > 0, 0.5 / (y > 0).sum(axis=0), 0.5 / np.maximum(1, (y < 0).sum(axis=0)))
    w = np.stack([np.linalg.solve((x * mass[:, [j]]).T @ x + ridge * np.eye(x.shape[1]), (x * mass[:, [j]]).T @ y[:, j]) for j in range(len(languages))], axis=1)
    return KernelModel(languages, slots, (marks.T.astype(np.float64) @ (root @ w)).astype(np.float32))


def sample(labelled: DataFrame, per_language: int, most_bytes: int, most_rows: int = 2000) -> tuple[list[str], list[str]]:
    """``per_language`` rows of each language, or all if it has fewer: those with the least hashes of doc_id and text.

    Where languages are so many that this makes over ``most_rows`` rows, each has an equal part of these, one at least.

    Rows that repeat an id and a text count once, and a null id leaves the hash to the text, so neither crowds out
    others. Texts over ``most_bytes`` are not fitted on.
    """
    usable = labelled.filter((F.octet_length("text") <= most_bytes) & F.col("text").rlike(r"\p{L}"))
    hashed = usable.select("doc_id", "lang", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)).alias("hash"))
    counts = hashed.groupBy("lang").agg(F.approx_count_distinct("hash").alias("n")).collect()
    if not counts:
        return [], []
    per_language = max(1, min(per_language, most_rows // len(counts)))
    # more than per_language hashes of each language meet in one row, and far fewer than all
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, (2 * per_language + 100) / max(1, r["n"])))])
    least = F.slice(F.sort_array(F.collect_set("hash")), 1, per_language)
    bounds = hashed.filter(F.col("hash") < F.element_at(share, F.col("lang")) * (1 << 40)).groupBy("lang").agg(F.array_max(least).alias("most")).collect()
    most = F.create_map(*[F.lit(x) for r in bounds for x in (r["lang"], r["most"])])
    chosen = hashed.filter(F.col("hash") <= F.element_at(most, F.col("lang"))).select("doc_id", "lang", "text").distinct()
    rows = sorted(chosen.collect(), key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2]))
    return [r[2] for r in rows], [r[1] for r in rows]


def language_id(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    per_language: int = 500,
    most_rows: int = 2000,
    most_bytes: int = 32_768,
    landmarks: int = 256,
    ridge: float = 1e-4,
    batch: int = 128,
    carry: bool = False,
) -> DataFrame:
    """Predicts the language of every whole text.

    The classifier is fitted on the driver to a bounded sample, ``per_language`` rows of each language and ``most_rows``
    in all at most (with more languages than that, a row of each), of rows whose crc32 of doc_id (as text) modulo 4 is not 2, with a language and a text of ``most_bytes`` at most. Executors
    score batches of texts by one matrix product with the folded weights of landmarks and regression.

    held_out: whether that remainder is 2; false for a null id. lang_pred is ``und`` with score 0 if the text is null
    or has no letter, or if nothing could be learned. score is the best regression value, from -1..1 to 0..1. Equal
    values go to the language first in order. Substrings have 1 to 4 bytes; those of 3 and 4 share 2**17 slots each by
    hash. A text of any length is scored whole. Rows are independent, so repeated ids don't matter; an empty table gives
    an empty result; other columns are ignored. Without a column of languages nothing can be learned.

    carry: adds the column row, a struct of all input columns.
    """
    lang = F.col(f"`{lang_col}`").cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), lang.alias("lang"), *([row_struct(docs)] if carry else []))
    held_out = F.coalesce(F.pmod(crc32_id(), F.lit(4)) == 2, F.lit(False))
    model = fit(*sample(source.filter(~held_out & F.col("lang").isNotNull()), per_language, most_bytes, most_rows), landmarks, ridge)
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # landmarks x _SLOTS bits at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, spectrum = shipped.value, Spectrum()
        for rows in batches:
            texts = rows.column(2)
            pred, score = [], []
            for i in range(0, rows.num_rows, batch):
                part = texts.slice(i, batch).to_pylist()
                known = [j for j, t in enumerate(part) if t and model.languages and any(map(str.isalpha, t))]
                lang, value = [UNKNOWN] * len(part), [0.0] * len(part)
                if known:
                    s = model.scores([part[j] for j in known], spectrum)
                    for j, best, top in zip(known, s.argmax(axis=1).tolist(), s.max(axis=1).tolist(), strict=True):
                        lang[j], value[j] = model.languages[best], min(1.0, max(0.0, (top + 1) / 2))
                pred += lang
                score += value
            out = {"doc_id": rows.column(0), "held_out": rows.column(1), "lang_pred": pa.array(pred, pa.string()), "score": pa.array(score, pa.float64())}
            yield pa.RecordBatch.from_pydict(out | ({"row": rows.column(3)} if carry else {}))

    return source.select("doc_id", held_out.alias("held_out"), "text", *["row"] * carry).mapInArrow(run, with_row(docs, SCHEMA) if carry else SCHEMA)
