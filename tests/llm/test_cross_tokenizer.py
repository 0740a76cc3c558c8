"""Alignment of two tokenizers against the libraries on whole texts."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loreweave.llm import cross_tokenizer as cross
from loreweave.llm.pretokens import byte_alphabet
from tests.llm.test_operators import awkward, frame

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
LIB_A = Tokenizer.from_file(A)
LIB_A.encode_special_tokens = True
LIB_B = sentencepiece.SentencePieceProcessor(model_file=B)
BYTE = {c: b for b, c in enumerate(byte_alphabet())}
ODD = ["", " ", "  ", "\n", " \n x", "x ", "a▁b", "▁", "<s> <unk> </s> <|endoftext|>", "<0x41> a", "字。字 字", "é ́x", "a b 　c", "it's we'll 'tis", "\x00 a\x00", "😀 😀😀", "tab\tand  two   three", "x" * 300, "ab " * 50, "​ a ᠎ b"]


def tokens(text):
    """(id, bytes) of A and B; nothing where their bytes aren't those of the space and the text."""
    if not text:
        return [], []
    a = [(i, bytes(BYTE[c] for c in LIB_A.id_to_token(i))) for i in LIB_A.encode(f" {text}", add_special_tokens=False).ids]
    b = []
    for i in LIB_B.encode(text):
        p = LIB_B.id_to_piece(i)
        b.append((i, bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()))
    raw = f" {text}".encode()
    return (a, b) if b"".join(x for _, x in a) == raw == b"".join(x for _, x in b) else ([], [])


def brute(texts):
    """Rows by one offset at a time, and counts over all texts."""
    cut, count = [], Counter()
    for _, text in texts:
        a, b = tokens(text)
        ends = []
        for side in (a, b):
            at, of = 0, {}
            for i, raw in side:
                at += len(raw)
                of[at] = i
            ends.append(of)
        links = [(ends[0][x], ends[1][x]) for x in ends[0] if x in ends[1]]
        groups, group, x, y, i = [], ([], []), 0, 0, 0
        for one, raw in a:
            group[0].append(one)
            x += len(raw)
            while i < len(b) and y + len(b[i][1]) <= x:
                group[1].append(b[i][0])
                y += len(b[i][1])
                i += 1
            if x == y:
                groups.append(group)
                group = ([], [])
            elif i < len(b) and y < x < y + len(b[i][1]):
                continue
        cut.append((len(a), len(b), groups, links))
        count.update(links)
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for (i, _), (na, nb, groups, links) in zip(texts, cut, strict=True):
        told = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)
        out.append((i, na, nb, len(groups), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(told.encode()).hexdigest() if na else ""))
    return out


def rows(df):
    return sorted(map(tuple, df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=repr)


@pytest.mark.parametrize("small", [False, True])
def test_cross_tokenizer(spark, small):
    texts = [*awkward(8), *((500 + i, t) for i, t in enumerate(ODD)), (3, awkward(8)[3][1]), (None, "no id here")]
    got = cross.cross_tokenizer(frame(spark, texts, 5 if small else 2), A, B, groups=True)
    assert rows(got) == sorted(brute(texts), key=repr)
    assert all((hashlib.sha256(r["groups"].encode()).hexdigest() if r["n_a"] else "") == r["groups_sha256"] for r in got.collect())


@pytest.mark.parametrize("joined", [1 << 16, 1])
def test_parts_make_the_whole(monkeypatch, joined):
    """A text that is cut at each place where it may be, in pieces of a few characters, without remembering anything."""
    whole = cross.Aligner(A, B)
    whole.local = False
    texts = [x for _, t in [*awkward(9), *enumerate(ODD)] if t for x in (t, f"{t} {t}")]
    want = [told(whole, t) for t in texts]
    monkeypatch.setattr(cross, "SLICE", 30)
    monkeypatch.setattr(cross, "MEMO_BYTES", 0)
    monkeypatch.setattr(cross, "JOINED", joined)
    monkeypatch.setattr(cross, "LONGEST", 7)
    own = cross.Aligner(A, B)
    assert own.local and [told(own, t) for t in texts] == want


def told(own, text):
    out = cross._Told()
    for cut in own.align(list(own.pieces(text))):
        if cut is None:
            return None
        out.add(cut, True)
    return out.n_a, out.n_b, out.n_groups, b";".join(out.told), out.keys.tolist(), out.times.tolist()


def test_decimal():
    numbers = np.array([0, 9, 10, 99, 100, 50256, 7, 31999, 123456])
    out, ends = cross.decimal(numbers, np.frombuffer(b",|;,|;,|;", np.uint8))
    assert out.tobytes() == b"0,9|10;99,100|50256;7,31999|123456;" and ends.tolist() == [2, 4, 7, 10, 14, 20, 22, 28, 35]
    assert cross.decimal(numbers[:0], np.empty(0, np.uint8))[0].tobytes() == b""


CHARACTERS = st.one_of(st.sampled_from(" \n'a.1é字▁ 　́ ᠎ "), st.characters(exclude_categories=["Cs"]))


@settings(max_examples=300, deadline=None)
@given(st.text(CHARACTERS, min_size=1, max_size=40))
def test_parts_of_any_text(text):
    own = cross.aligner(A, B)
    a, b = tokens(text)
    out = told(own, text)
    assert (out[:2] if out else (0, 0)) == (len(a), len(b))
    if out:
        ids = [g.split(b"|") for g in out[3].split(b";")]
        assert [int(x) for g in ids for x in g[0].split(b",")] == [i for i, _ in a] and [int(x) for g in ids for x in g[1].split(b",")] == [i for i, _ in b]


def test_counts(spark, monkeypatch):
    """Sorted shards that hold the counts of all pairs, also where tasks give theirs away early."""
    monkeypatch.setattr(cross, "HELD_PAIRS", 50)
    rng = random.Random(3)
    table = [[(rng.randint(0, 40) << 32 | rng.randint(0, 40), rng.randint(1, 5)) for _ in range(rng.randint(0, 60))] for _ in range(80)]
    table = [dict(x) for x in table]
    df = spark.createDataFrame([(list(x), list(x.values())) for x in table], "keys array<long>, times array<int>").repartition(7)
    counts = cross.count_pairs(df, 41)
    want = Counter()
    for x in table:
        want.update(x)
    assert {r["b_id"] << 32 | r["a_id"]: r["n"] for r in cross.pair_table(counts, spark).collect()} == want
    assert counts.best.tolist() == [max((n for k, n in want.items() if k >> 32 == b), default=0) for b in range(41)]
    keys = np.array(sorted(want), np.int64)
    assert cross.Lookup(counts).of(keys).tolist() == [want[k] for k in keys.tolist()]
    assert counts.shards == sorted(counts.shards, key=lambda s: s[1])


def test_no_more_pairs_than_bytes(spark):
    """A pair that ends together has one token's bytes at the end of the other's."""
    own = cross.aligner(A, B)
    counts = cross.count_pairs(cross.align(frame(spark, awkward(2)), A, B), len(own.bytes_b))
    for r in cross.pair_table(counts, spark).collect():
        a, b = own.bytes_a[r["a_id"]], own.bytes_b[r["b_id"]]
        assert a.endswith(b) or b.endswith(a)
