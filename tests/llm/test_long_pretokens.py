"""Long pre-tokens: merges in arrays against those one at a time, memory, and what workers remember."""

import random
import subprocess
import sys

import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loreweave.llm import token_counts as counts
from loreweave.llm.pretokens import LONGEST, Memo

PATH = P.path("byte_bpe_50k.json")


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("aabtheing é中"), min_size=1, max_size=300))
def test_packed_merges(text):
    c = counts.counter(PATH)
    symbols = [c.alphabet[b] for b in text.encode()]
    assert c.packed.ordered and c.packed.count(text.encode()) == counts.count_after_merges(symbols, c.ranks)


@pytest.mark.parametrize("letter", ["a", "ab", "abc", " ", "="])
def test_packed_runs(letter):
    """Runs of one symbol merge every other place; also in blocks that end within one."""
    c = counts.counter(PATH)
    for n in range(1, 40):
        text = letter * n
        assert c.packed.count(text.encode()) == counts.count_after_merges([c.alphabet[b] for b in text.encode()], c.ranks)


def test_packed_in_blocks(monkeypatch):
    monkeypatch.setattr(counts, "BLOCK", 7)
    c = counts.counter(PATH)
    text = "".join(random.Random(1).choices("theing", k=900))
    assert c.packed.count(text.encode()) == counts.count_after_merges([c.alphabet[b] for b in text.encode()], c.ranks)


def test_unordered_files_merge_one_at_a_time():
    """A rank below that of the symbol it takes can't wait for its turn."""
    ranks = {("ab", "c"): 0, ("a", "b"): 1}
    assert not counts.Packed(ranks, ["a", "b", "c"]).ordered
    assert counts.Packed({("a", "b"): 0, ("ab", "c"): 1}, ["a", "b", "c"]).ordered


def test_twenty_megabytes_in_one_pretoken():
    """In a process of its own, under 1,000 MB in all."""
    code = f"""
import random, resource
from loreweave.llm.token_counts import counter
text = "".join(random.Random(1).choices("abcdefgh", k=1 << 20)) * 20
n = counter({PATH!r}).count(text)
print(n, len(text), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, timeout=600).stdout.split()
    n, size, mb = map(int, out[-3:])
    assert size == 20 << 20 and size / 4 < n < size and mb < 1000


def test_memo_is_bounded_by_bytes():
    asked = []
    memo = Memo(lambda tokens: (asked.extend(tokens), [len(t) for t in tokens])[1], 40_000)
    long = "x" * (LONGEST + 1)
    for _ in range(3):
        assert memo.of(["a", long, "b", "a"]) == [1, LONGEST + 1, 1, 1]
    assert asked.count(long) == 3 and asked.count("a") == 1 and long not in memo
    for i in range(1000):
        assert memo.of([f"w{i}", "a"]) == [len(f"w{i}"), 1]
        assert memo.held <= 40_000 + 2 * (Memo.ENTRY + 20) and len(memo) <= 200
