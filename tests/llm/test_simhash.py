"""SimHash by covering masks against all pairs."""

import random

import numpy as np
import pytest
import xxhash
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loreweave.llm import simhash_dedup as simhash
from loreweave.llm.near_dedup import components
from tests.llm.test_operators import awkward, by_id, frame, lower


def brute_print(text, size=3):
    words = [w for w in lower(text).translate(str.maketrans("\t\n\v\f\r", "     ")).split(" ") if w]
    grams = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or [" ".join(words)] * bool(words)
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, radius=3):
    """prints: (id, fingerprint); ids may repeat or be None."""
    group = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= radius:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    out = []
    for g in group:
        ids = [p[0] for p, x in zip(prints, group, strict=True) if x == g and p[0] is not None]
        out.append(min(ids) if ids else None)
    return out


def close_prints(seed, n):
    """Fingerprints that differ from a few centres in up to eight bits."""
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(3)]
    return [rng.choice(centres) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 8))) for _ in range(n)]


@given(st.integers(0, (1 << 64) - 1), st.integers(1, 4), st.data())
def test_covering(mask, radius, data):
    """Whatever open bits two fingerprints differ in, some mask has none of them; all have what they cover."""
    open_bits = [i for i in range(64) if not mask >> i & 1]
    masks = [int(m) for m in simhash.covering(mask, radius)]
    assert all(m & mask == mask for m in masks) and len(masks) == (2 << radius) - 1
    if open_bits:
        differ = sum(1 << b for b in data.draw(st.lists(st.sampled_from(open_bits), max_size=radius, unique=True)))
        assert any(m & differ == 0 for m in masks)


def test_covering_halves_the_open_bits():
    for mask in (0, (1 << 32) - 1, (1 << 48) - 1):
        left = 64 - mask.bit_count()
        assert all(m.bit_count() - mask.bit_count() >= left // 2 for m in map(int, simhash.covering(mask, 3)))


@pytest.mark.parametrize("piece", [1 << 20, 40])
def test_fingerprints(monkeypatch, piece):
    """Also where a text becomes words in pieces, and bits are counted in short runs."""
    monkeypatch.setattr(simhash, "PIECE", piece)
    monkeypatch.setattr(simhash, "HASHES", 1 << 16 if piece > 40 else 3)
    texts = [t or "" for _, t in awkward(5)]
    assert simhash.fingerprints([t.encode() for t in texts], 3, 42).tolist() == [brute_print(t) for t in texts]


@pytest.mark.parametrize("block", [1024, 4])
def test_simhash_dedup(spark, block):
    texts = [*awkward(3), *((900 + i, t) for i, t in awkward(4)[:20]), (None, None), (None, "only here, without an id")]
    texts += [(7, texts[7][1]), (950, "a b c d e f"), (951, "A b  c d e f"), (952, None)]
    got = [r.asDict() for r in simhash.simhash_dedup(frame(spark, texts), block=block).collect()]
    prints = [(i, brute_print(t)) for i, t in texts]
    want = sorted(((i, f"{f:016x}", c) for (i, f), c in zip(prints, brute_components(prints), strict=True)), key=repr)
    assert sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got), key=repr) == want


@pytest.mark.parametrize("block", [1024, 8])
def test_links_of_close_fingerprints(spark, block):
    """Also where buckets are so full that they are dealt anew, down to 8 open bits."""
    prints = sorted(set(close_prints(1, 400)))
    df = spark.createDataFrame([(np.uint64(p).astype(np.int64).item(),) for p in prints], "fp long")
    found = {r["node"]: r["comp"] for r in components(simhash.simhash_links(df, block=block), "test").collect()}
    signed = {np.uint64(p).astype(np.int64).item(): i for i, p in enumerate(prints)}
    mine = {}
    for fp, i in signed.items():
        mine.setdefault(found.get(fp, fp), []).append(i)
    want = {}
    for i, c in enumerate(brute_components(list(enumerate(prints)))):
        want.setdefault(c, []).append(i)
    assert sorted(map(sorted, mine.values())) == sorted(want.values())


def test_full_buckets_are_dealt_anew(spark, monkeypatch):
    """A bucket's rows stay together only while they are few."""
    seen = []
    deal = simhash._dealt
    monkeypatch.setattr(simhash, "_dealt", lambda rows, radius: (seen.append(rows.select(F.bit_count("mask")).distinct().count()), deal(rows, radius))[1])
    rng = random.Random(2)
    base = rng.getrandbits(64)
    prints = {base ^ sum(1 << b for b in rng.sample(range(0, 64, 2), 3)) for _ in range(300)}
    df = spark.createDataFrame([(np.uint64(p).astype(np.int64).item(),) for p in prints], "fp long")
    simhash.simhash_links(df, block=16).collect()
    assert len(seen) > 1
