"""Text functions as column expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_CJK = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}"
#: From here on characters may be of those scripts; texts below need no closer look.
_MAYBE_CJK = r"[\x{2E80}-\x{10FFFF}]"
_BLANK = r"(?U)^\s+|\s+$"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, _BLANK, "")


def chunk_text(c: Column, size: int = 800, overlap: int = 100) -> Column:
    """Overlapping windows of ``size`` characters as an array, stripped, without blank ones.

    A text of ``size`` at most is one chunk as it is; an empty or null one has none. A window of under half the size
    is appended to the chunk before it.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than size")
    step, n = size - overlap, F.length(c)
    window = lambda s: F.substring(c, s + 1, F.lit(size))
    last = F.greatest(F.lit(0), F.floor((n - size // 2) / F.lit(float(step))).cast("int") * step)
    rest = F.when(last + step < n, F.sequence(last + step, n - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    tail = F.array_join(F.transform(rest, window), "")
    long = F.transform(F.sequence(F.lit(0), last, F.lit(step)), lambda s: F.when(s == last, F.concat(window(s), tail)).otherwise(window(s)))
    long = F.filter(F.transform(long, strip), lambda x: x != "")
    none = F.array().cast("array<string>")
    return F.when(c.isNull() | (n == 0), none).when(n <= size, F.array(c)).otherwise(long)


def chunk_by_sentence(c: Column, size: int = 800) -> Column:
    """Sentences with their ends, packed in order to chunks of ``size`` characters at most where they fit."""
    parts = F.regexp_extract_all(c, F.lit(r"(?s).*?[。！？.!?]\s*|.+$"), F.lit(0))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def add(acc: Column, s: Column) -> Column:
        over = F.length(acc["cur"]) + F.length(s) > size
        done = F.when(over & (acc["cur"] != ""), F.concat(acc["done"], F.array(strip(acc["cur"])))).otherwise(acc["done"])
        return F.struct(done.alias("done"), F.when(over, s).otherwise(F.concat(acc["cur"], s)).alias("cur"))

    packed = F.aggregate(parts, start, add, lambda a: F.when(a["cur"] != "", F.concat(a["done"], F.array(strip(a["cur"])))).otherwise(a["done"]))
    return F.when(c.isNull() | (c == ""), F.array().cast("array<string>")).when(F.length(c) <= size, F.array(c)).otherwise(packed)


def tokens(c: Column, words: Sequence[str] = ()) -> Column:
    """Lower-cased runs of letters and digits; runs of Chinese, Japanese or Korean characters as their bigrams.

    ``words``: a dictionary of terms that stay whole, the longest first: inside runs of those scripts, else as words.
    """
    low = F.lower(c)
    if own := sorted({w.lower() for w in words if w.strip()}, key=lambda w: (-len(w), w)):
        edge = rf"[\p{{L}}\p{{N}}&&[^{_CJK}]]"
        plain = [re.sub(r"([^\w\s])", r"\\\1", w) for w in own]
        term = "|".join(w if any(ord(x) >= 0x2E80 for x in w) else f"(?<!{edge}){w}(?!{edge})" for w in plain)
        parts = F.regexp_extract_all(low, F.lit(rf"(?:{term})|(?:(?!{term})[{_CJK}])+|(?:(?!{term})[\p{{L}}\p{{N}}&&[^{_CJK}]])+"), F.lit(0))
        two = lambda t: F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substring(t, i, F.lit(2)))
        return F.flatten(F.transform(parts, lambda t: F.when(t.rlike(rf"^[{_CJK}]{{2,}}$") & ~t.isin(own), two(t)).otherwise(F.array(t))))
    runs = F.regexp_extract_all(low, F.lit(rf"[{_CJK}]+|[\p{{L}}\p{{N}}&&[^{_CJK}]]+"), F.lit(0))
    pairs = lambda t: F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substring(t, i, F.lit(2)))
    mixed = F.flatten(F.transform(runs, lambda t: F.when(t.rlike(rf"^[{_CJK}]{{2,}}$"), pairs(t)).otherwise(F.array(t))))
    return F.when(c.rlike(_MAYBE_CJK), mixed).otherwise(F.regexp_extract_all(low, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))


def segment(c: Column, words: Sequence[str] = ()) -> Column:
    """Tokens joined by spaces."""
    return F.array_join(tokens(c, words), " ")


def content_hash(c: Column) -> Column:
    return F.md5(c.cast("binary"))
