"""The corpus operators against brute force on small, awkward tables."""

import base64
import hashlib
import math
import random
import re
import zlib
from bisect import bisect_right
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loreweave.llm import repeats
from loreweave.llm.bpe_codec import bpe_encode
from loreweave.llm.decontaminate import decontaminate
from loreweave.llm.exact_dedup import Directory, exact_dedup, lookup
from loreweave.llm.fm_index import FMIndex
from loreweave.llm.language_id import Spectrum, fit, language_id, sample
from loreweave.llm.lattice_lm import Lattice, lattice_lm
from loreweave.llm.near_dedup import components, match_threshold, near_dedup, shingle_sets
from loreweave.llm.queries import ORACLE_SQL, QUERIES
from loreweave.llm.substring_dedup import substring_dedup
from loreweave.llm.suffix_dedup import suffix_dedup
from loreweave.llm.suffix_sort import Suffixes, equal_strings
from loreweave.llm.token_counts import token_counts
from loreweave.llm.warc import read_warc, records_in, write_warc

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, row_id long, count long, text_sha256 string, sig string"
WHITE = r"[\x20\x09-\x0D]+"


def frame(spark, texts, parts=3):
    """texts with ids, in a table with other columns whose names operators use inside."""
    rows = [(i, t, ["en", "fr", None][(i or 0) % 3], 1, 2, "x", "y") for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def awkward(seed=0, n=60):
    """Nulls, empty, blank, long, repeated and nearly repeated texts, shared passages, runs of one letter."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    some = lambda k: " ".join(rng.choice(words) for _ in range(k))
    passage, line = some(60), some(9)
    out = [None, "", "   ", "\n\t ", "a", "x" * 400, "x" * 400, "ab" * 300, some(3000), "\x1c\x85  odd spaces", "<|endoftext|> a <|endoftext|>", "1 2 3 4 5"]
    for _ in range(n):
        t = some(rng.randint(1, 120))
        out.append(t)
        kind = rng.randint(0, 6)
        if kind == 0:
            out.append(t)
        elif kind == 1:
            out.append(t.replace(" ", "  \n", 3))
        elif kind == 2:
            w = t.split()
            w[rng.randrange(len(w))] = "changed"
            out.append(" ".join(w))
        elif kind == 3:
            out.append(f"{some(5)} {passage} {some(rng.randint(0, 9))}")
        elif kind == 4:
            out.append(f"{some(12)}\n{line}\n{some(14)}")
        elif kind == 5:
            out.append(f"{t} {t}")
    rng.shuffle(out)
    return list(enumerate(out))


def by_id(df, key="doc_id"):
    return {r[key]: r.asDict() for r in df.collect()}


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def brute_suffix(texts, length):
    seen, out = set(), {}
    for i, t in sorted(texts):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w in seen:
                gone[s : s + length] = True
            seen.add(w)
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out[i] = (len(b), int(gone.sum()), spans, sha(np.frombuffer(b, np.uint8)[~gone].tobytes()))
    return out


@pytest.mark.parametrize(("bucket_mb", "seed"), [(8, 0), (1e-4, 1), (3e-4, 2)])
def test_suffix_dedup(spark, bucket_mb, seed):
    """Also with buckets of a few strings, whose splitters divide equal ones."""
    texts = awkward(seed)
    got = by_id(suffix_dedup(frame(spark, texts), bucket_mb=bucket_mb))
    assert {k: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for k, r in got.items()} == brute_suffix(texts, 100)


def test_suffix_texts(spark):
    """The second and later starts of 100 a's go in every document, and a null id is last."""
    got = by_id(suffix_dedup(frame(spark, [(1, "a" * 100 + "c"), (2, "b" + "a" * 150), (None, "a" * 150 + "d")]), texts=True))
    assert {k: r["text"] for k, r in got.items()} == {1: "a" * 100 + "c", 2: "b", None: "d"}


def test_multikey_quicksort():
    rng = random.Random(1)
    data = bytes(rng.choice(b"ab\x00") for _ in range(6000)) * 2
    at = np.array(rng.sample(range(len(data) - 20), 9000))
    for depth in (20, 16, 1):
        order, same = Suffixes(data, 20).sort(at, depth)
        strings = [data[p : p + depth] for p in at[order].tolist()]
        assert strings == sorted(strings) and same.tolist() == [False] + [a == b for a, b in zip(strings, strings[1:])]


def test_equal_strings():
    rng = random.Random(2)
    strings = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 9))).encode() for _ in range(3000)]
    which, first = equal_strings(b"".join(strings), np.array([len(x) for x in strings]))
    seen = list(dict.fromkeys(strings))
    assert [seen.index(x) for x in strings] == which.tolist() and [strings.index(x) for x in seen] == first.tolist()
    assert [len(x) for x in equal_strings(b"", np.empty(0, np.int64))] == [0, 0]


@pytest.mark.parametrize("words", [False, True])
def test_splitters(spark, monkeypatch, words):
    """The sample grows with the number of buckets, splitters are even over the places, and where they cut through the
    suffixes of a frequent line, its windows are compared across the boundaries.
    """
    rng = random.Random(12)
    line = " ".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(45))
    texts = [(i, f"{rng.random()} {line} {rng.random()} " + " ".join(str(rng.random()) for _ in range(20))) for i in range(300)]
    found = []
    real = repeats.splitters
    monkeypatch.setattr(repeats, "splitters", lambda *a: found.append(real(*a)) or found[-1])
    crossed = []
    across = repeats.compare_across
    monkeypatch.setattr(repeats, "compare_across", lambda df, **o: crossed.append(df.filter("to_bucket is not null").count()) or across(df, **o))
    if words:
        got = by_id(substring_dedup(frame(spark, texts), shard_mb=2e-4))
        assert {k: (r["n_words"], r["n_removed"], r["kept_sha256"]) for k, r in got.items()} == brute_substring(texts, 35)
    else:
        got = by_id(suffix_dedup(frame(spark, texts), bucket_mb=2e-4))
        assert {k: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for k, r in got.items()} == brute_suffix(texts, 100)
    size = sum(len(t) for _, t in texts)
    # the texts have some 700 anchors of words, of which many begin the same suffix
    assert (0.04 if words else 0.4) * size / (2e-4 * 2**20) < len(found[0]) < 1.2 * size / (2e-4 * 2**20) and crossed[0] > 0
    held = Counter(bisect_right(found[0], t[p : p + 60].encode()) for _, t in texts for p in range(0, len(t) - 60, 7))
    assert max(held.values()) < 20 * sum(held.values()) / len(held)


def brute_substring(texts, n):
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in texts}
    count = Counter(tuple(w[s : s + n]) for w in words.values() for s in range(len(w) - n + 1))
    out = {}
    for i, w in words.items():
        gone = set()
        for s in range(len(w) - n + 1):
            if count[tuple(w[s : s + n])] > 1:
                gone.update(range(s, s + n))
        out[i] = (len(w), len(gone), sha(" ".join(x for p, x in enumerate(w) if p not in gone)))
    return out


@pytest.mark.parametrize(("shard_mb", "seed"), [(16, 0), (1e-4, 1), (3e-4, 2)])
def test_substring_dedup(spark, shard_mb, seed):
    texts = awkward(seed)
    got = by_id(substring_dedup(frame(spark, texts), shard_mb=shard_mb))
    assert {k: (r["n_words"], r["n_removed"], r["kept_sha256"]) for k, r in got.items()} == brute_substring(texts, 35)


@pytest.mark.parametrize("mb", [8, 1e-4])
@pytest.mark.parametrize("parts", [1, 4])
def test_many_copies(spark, mb, parts):
    """Chunks that have a segment many times, in documents whose order is not that of the chunk, and one that has it once."""
    base = [t for _, t in awkward(6, 12) if t]
    texts = [(1000 - i, t) for i, t in enumerate([*base * 5, "new " * 3 + base[-1], *base[-2:] * 20, " ".join(f"w{i}" for i in range(90))])]
    got = by_id(suffix_dedup(frame(spark, texts, parts), bucket_mb=mb))
    assert {k: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for k, r in got.items()} == brute_suffix(texts, 100)
    got = by_id(substring_dedup(frame(spark, texts, parts), shard_mb=mb))
    assert {k: (r["n_words"], r["n_removed"], r["kept_sha256"]) for k, r in got.items()} == brute_substring(texts, 35)


def test_fm_index():
    rng = np.random.default_rng(2)
    text = rng.integers(1, 6, 3000)
    index = FMIndex(text, 4, every=8)
    patterns = np.concatenate((rng.integers(1, 7, (200, 4)), np.pad(rng.integers(1, 7, (50, 2)), ((0, 0), (2, 0)))))
    lo, hi = index.search(patterns)
    for p, a, b in zip(patterns, lo, hi):
        p = p[p > 0].tolist()
        places = [i for i in range(len(text)) if text[i : i + len(p)].tolist() == p]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == places


def brute_hits(texts, items, n):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = {}
    for i, t in items:
        w = words(t)
        for s in range(max(1, len(w) - n + 1) if w else 0):
            windows.setdefault(tuple(w[s : s + n]), set()).add(i)
    out = {}
    for i, t in texts:
        w, hit, found = words(t), set(), set()
        for size in {len(x) for x in windows}:
            for s in range(len(w) - size + 1):
                if (own := windows.get(tuple(w[s : s + size]))) is not None:
                    hit.update(range(s, s + size))
                    found |= own
        out[i] = (len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit))
    return out


@pytest.mark.parametrize("block_words", [2_000_000, 15])
def test_decontaminate(spark, block_words):
    texts = awkward(3)
    rng = random.Random(4)
    items = [(100 + i, t) for i, t in texts if t and rng.random() < 0.3] + [(7, "Changed"), (8, ""), (9, "!!"), (10, "A, B!")]
    bench = spark.createDataFrame([*items, (None, "a"), (11, None)], "item_id long, text string")
    got = by_id(decontaminate(frame(spark, texts), bench, block_words=block_words))
    assert {k: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for k, r in got.items()} == brute_hits(texts, items, 10)
    assert decontaminate(frame(spark, texts), bench.limit(0)).filter("contaminated").isEmpty()


@pytest.mark.parametrize("block_words", [2_000_000, 15])
def test_decontaminate_items_without_id(spark, block_words):
    texts, items = awkward(3), [(100, awkward(3)[20][1]), (None, "a"), (None, "1 2 3 4 5"), (12, "a"), (13, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = by_id(decontaminate(frame(spark, texts), bench, block_words=block_words, items_without_id=True))
    want = brute_hits(texts, [(-1 if i is None else i, t) for i, t in items if t], 10)
    assert {k: (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) for k, r in got.items()} == {k: (*w[:3], w[4]) for k, w in want.items()}
    with_id = brute_hits(texts, [(i, t) for i, t in items if i is not None and t], 10)
    assert {k: r["items_sha256"] for k, r in got.items()} == {k: w[3] for k, w in with_id.items()} and any(w[2] > with_id[k][2] for k, w in want.items())


def test_decontaminate_query_without_item_ids(spark, tmp_path):
    """The query and its SQL agree, and the pipeline's stage drops what the query calls contaminated."""
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        df = spark.read.parquet(f"{SF}/{t}.parquet")
        (df.withColumn("item_id", F.when(F.col("item_id") % 2 == 0, F.col("item_id"))) if t == "benchmark" else df).coalesce(1).write.parquet(f"file://{tmp_path}/{t}.parquet")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    want = con.sql(ORACLE_SQL["op6_decontaminate"])
    got = QUERIES["op6_decontaminate"](spark, f"file://{tmp_path}").select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())
    docs = spark.read.parquet(f"file://{tmp_path}/documents.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.drop_contaminated(spark, docs, f"file://{tmp_path}").collect()}
    assert kept == {r["doc_id"] for r in got if not r["contaminated"]}


def test_decontaminate_spans(spark):
    bench = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    row = decontaminate(frame(spark, [(1, "é One, TWO. three")]), bench, spans=True, carry=True).first()
    assert [(s["begin"], s["end"]) for s in row["spans"]] == [(3, 11)] and row["row"]["lang"] == "fr"


def test_exact_dedup(spark):
    texts = awkward(5)
    norm = {i: re.sub(WHITE, " ", t or "") for i, t in texts}
    groups = {}
    for i, t in norm.items():
        groups.setdefault(t, []).append(i)
    got = by_id(exact_dedup(frame(spark, texts)))
    assert {k: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for k, r in got.items()} == {i: (min(groups[t]), len(groups[t]), i == min(groups[t]), sha(t)) for i, t in norm.items()}
    rows = exact_dedup(frame(spark, [(None, "a"), (None, "b"), (2, "b"), (2, "b")])).collect()
    assert sorted((r["doc_id"] or 0, r["keep_id"] or 0, r["group_size"], r["kept"]) for r in rows) == [(0, 0, 1, True), (0, 2, 3, False), (2, 2, 3, True), (2, 2, 3, True)]


def test_exact_index_on_shared_files(spark, tmp_path):
    """Buckets are split by doubling the directory, each has its own files, and other texts can be looked up there."""
    texts = [(i, f"text {i % 90} " * 4000) for i in range(200)]
    path = f"file://{tmp_path}/index"
    assert exact_dedup(frame(spark, texts), bucket_mb=1, index_path=path).filter("kept").count() == 90
    slots = spark.read.parquet(f"{path}/directory").collect()
    assert sorted(r["slot"] for r in slots) == list(range(1 << slots[0]["depth"])) and len({r["bucket"] for r in slots}) > 4
    held = spark.read.parquet(f"{path}/buckets")
    assert {r["bucket"] for r in held.collect()} <= {r["bucket"] for r in slots} and held.select("sha").distinct().count() == 90
    new = frame(spark, [(1000, texts[7][1].replace(" ", "\n")), (1001, "another"), (1002, None)])
    assert {k: (r["keep_id"], r["group_size"]) for k, r in by_id(lookup(new, path)).items()} == {1000: (7, 3), 1001: (None, None), 1002: (None, None)}


def test_directory():
    d = Directory({i: 10 for i in range(64)} | {5: 5000}, 6, 100)
    b = d.buckets()
    assert b[0][0] == 0 and sum(n for _, n in b) == 1 << d.depth and d.depth == 6 and len(b) > 8
    assert Directory({}, 6, 100).buckets() == [(0, 1)]


def links(texts, size, percent):
    sets = {}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets[i] = {tuple(w[j : j + size]) for j in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: (len(s), root(i), root(i) == i) for i, s in sets.items()}


@pytest.mark.parametrize(("size", "percent", "block"), [(3, 85, 2048), (5, 80, 2048), (3, 85, 4)])
def test_near_dedup(spark, size, percent, block):
    """Also with lists and groups over four members dealt to pairs of blocks."""
    rng = random.Random(6)
    texts = awkward(6)
    base = " ".join(str(rng.random()) for _ in range(100)).split()
    for _ in range(40):
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(100)] = str(rng.random())
        texts.append((len(texts), " ".join(w)))
    got = by_id(near_dedup(frame(spark, texts), shingle=size, percent=percent, block=block))
    assert {k: (r["n_shingles"], r["component_id"], r["kept"]) for k, r in got.items()} == links(texts, size, percent)


@pytest.mark.parametrize("words", [0, 1, 2, 3, 4, 5, 6])
def test_near_dedup_few_words(spark, words):
    """Also where all texts of a slice have fewer words than a shingle."""
    texts = [(1, " ".join("abcdef"[:words])), (2, None), (3, " ")]
    sets = shingle_sets(np.frombuffer(texts[0][1].encode(), np.uint8), np.array([0, len(texts[0][1])]), 5)
    assert [len(s) for s in sets] == [links(texts, 5, 80)[1][0]]
    if words == 3:
        got = by_id(near_dedup(frame(spark, texts, 1)))
        assert {k: (r["n_shingles"], r["component_id"], r["kept"]) for k, r in got.items()} == links(texts, 5, 80)


def test_components(spark):
    rng = random.Random(8)
    pairs = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 470)]
    up = {x: x for p in pairs for x in p}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    got = {r["node"]: r["comp"] for r in components(spark.createDataFrame(pairs, "a long, b long"), "t").collect()}
    assert got == {x: root(x) for x in up if any(x in p and p[0] != p[1] for p in pairs)}


def test_components_end_when_nothing_changes(spark, monkeypatch):
    """However many rounds that takes: a count of rounds, here cut to one, must not end them."""
    monkeypatch.setattr("loreweave.llm.near_dedup.range", lambda n: range(min(n, 1)), raising=False)
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert {r["node"]: r["comp"] for r in components(edges, "t").collect()} == dict.fromkeys(range(41), 0)


def test_match_threshold():
    miss = lambda n, t, s: sum(math.comb(n, k) * s**k * (1 - s) ** (n - k) for k in range(t))
    for s in (0.8, 0.85):
        t = match_threshold(32, s, 1e-6)
        assert miss(32, t, s) <= 1e-6 < miss(32, t + 1, s)


def test_bpe_codec(spark):
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = awkward(9) + [(500 + i, "".join(random.Random(i).choice("ab T'sll\n\t\x1c\x85 éßñ中🙂०12!?_- ") for _ in range(50))) for i in range(200)]
    got = by_id(bpe_encode(frame(spark, texts), path, ids=True))
    for i, t in texts:
        ids = library.encode_ordinary(t or "")
        assert got[i]["ids"] == ids and got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == sha(np.array(ids, "<u4").tobytes()) and got[i]["decoded_sha256"] == sha(t or "")


def test_token_counts(spark):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = awkward(10)
    got = by_id(token_counts(frame(spark, texts), path))
    for i, t in texts:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len((t or "").encode()), n, n > 512)


def test_language_id(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_id(docs).join(docs, "doc_id").collect()
    assert {r["held_out"] for r in rows} == {True, False} and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.98 * len(held) and all(0 <= r["score"] <= 1 for r in rows)
    odd = by_id(language_id(frame(spark, [(0, None), (1, ""), (2, "123 !?"), (3, "word " * 20), (4, "mot " * 20), (None, "mot " * 9), (6, "É")])))
    assert all(odd[i]["lang_pred"] == "und" and odd[i]["score"] == 0 for i in (0, 1, 2)) and odd[None]["held_out"] is False
    assert language_id(docs.drop("lang").limit(3)).filter("lang_pred <> 'und'").isEmpty()


def test_language_scores_by_brute_force():
    """The folded weights score as the kernel matrix, the Nyström features and the ridge solution do."""
    rng = random.Random(13)
    words = {x: ["".join(rng.choice(c) for _ in range(rng.randint(2, 6))) for _ in range(40)] for x, c in (("aa", "abcdeé"), ("bb", "cdefgñ"), ("cc", "efghij"))}
    draw = lambda x: " ".join(rng.choice(words[x]) for _ in range(rng.randint(1, 30))).capitalize()
    labels = [rng.choice(list(words)) for _ in range(40)]
    texts = [draw(x) for x in labels]
    landmarks, ridge = 9, 1e-3
    model = fit(texts, labels, landmarks, ridge)

    def slots(text):
        raw, out = text.lower().encode(), set()
        for n in (1, 2, 3, 4):
            for i in range(len(raw) - n + 1):
                code = int.from_bytes(raw[i : i + n], "big")
                hashed = (code * 2654435761 % 2**32) >> 15
                out.add((n, code if n < 3 else hashed))
        return out

    sets = [slots(t) for t in texts]
    kernel = lambda x, y: len(x & y) / math.sqrt(len(x) * len(y))
    chosen = [i for x in sorted(words) for i in [j for j, y in enumerate(labels) if y == x][: landmarks // 3]]
    m = np.array([[kernel(sets[i], sets[j]) for j in chosen] for i in chosen])
    value, vector = np.linalg.eigh(m)
    root = vector @ np.diag(value**-0.5) @ vector.T
    features = lambda s: np.array([kernel(s, sets[j]) for j in chosen]) @ root
    x = np.array([features(s) for s in sets])
    others = [draw(y) for y in words for _ in range(4)] + ["zzz", "A"]
    want = np.empty((len(others), 3))
    for k, lang in enumerate(sorted(words)):
        y = np.array([1.0 if z == lang else -1.0 for z in labels])
        weight = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y < 0).sum())
        # the least of the weighted squares plus the ridge, by the normal equations
        w = np.linalg.solve((x.T * weight) @ x + ridge * np.eye(landmarks), (x.T * weight) @ y)
        want[:, k] = [features(slots(t)) @ w for t in others]
    got = model.scores(others, Spectrum())
    assert model.languages == sorted(words) and np.allclose(got, want, atol=2e-4)


def test_language_sample_has_a_total_bound(spark):
    rows = [(i, f"words {i}", f"l{i % 30}") for i in range(900)]
    _, labels = sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 20, 1 << 15, 100)
    assert Counter(labels) == {f"l{i}": 3 for i in range(30)}


def test_language_sample_is_bounded(spark):
    """Also where all rows share an id, so that a hash of it picks all or none."""
    rows = spark.createDataFrame([(i % 2, f"some words {i}", "en") for i in range(400)], "doc_id long, text string, lang string")
    for per in (5, 1000):
        texts, labels = sample(rows, per, 1 << 15)
        assert len(texts) == len(labels) <= min(400, 2 * per)
    assert len(texts) == 400


def test_language_sample_of_each_language(spark):
    """Rows without id, and copies of one row, leave the other languages their part and get their own."""
    rows = [(None, f"worte {i}", "de") for i in range(3000)] + [(i, f"mots {i}", "fr") for i in range(300)] + [(7, "words", "en")] * 3000 + [(i % 2, f"parole {i}", "it") for i in range(3000)]
    _, labels = sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 5, 1 << 15)
    assert Counter(labels) == {"de": 5, "fr": 5, "en": 1, "it": 5}


def test_lattice_sums_over_all_segmentations():
    lat = Lattice(P.path("piece_bpe_32k.model"))

    def total(word):
        def rest(w):
            return 1.0 if not w else sum(math.exp(lat.inner[w[:j]]) * rest(w[j:]) for j in range(1, len(w) + 1) if w[:j] in lat.inner)

        return sum(math.exp(lat.begin[word[:j]]) * rest(word[j:]) for j in range(len(word) + 1) if word[:j] in lat.begin)

    for w in (b"the", b"water", "né".encode(), b"zqx", b"a"):
        assert math.isclose(math.exp(lat.log_probability(w)), total(w), rel_tol=1e-9)
    every = sum(map(math.exp, [*lat.begin.values(), *lat.inner.values(), lat.end]))
    assert math.isclose(every, 1, rel_tol=1e-9)


def test_lattice_lm(spark):
    path = P.path("piece_bpe_32k.model")
    texts, lat = awkward(11), Lattice(path)
    tokens = {i: [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", lower(t))] + [b"\n"] for i, t in texts}
    out = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in texts}
    c = Counter(w for i, ws in tokens.items() if not out[i] for w in ws)
    n, v = sum(c.values()), len(c)
    got = by_id(lattice_lm(frame(spark, texts), path))
    assert len(got) == len(texts) and any(out.values())
    for i, ws in tokens.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out[i], len(ws), sum(c[w] > 0 for w in ws), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), rel_tol=1e-9)
        assert math.isclose(r["score"], sum(lat.log_probability(w) for w in ws) / math.log(10), rel_tol=1e-6)
        assert math.isclose(r["mixed_score"], sum((np.logaddexp(math.log(c[w]) if c[w] else -np.inf, math.log(v) + lat.log_probability(w)) - math.log(n + v)) / math.log(10) for w in ws), rel_tol=1e-6)


def test_lattice_learns_by_expectation():
    """Expected numbers against all segmentations, of which slices of long words have their own."""
    lat = Lattice(P.path("piece_bpe_32k.model"))
    names = [*lat.begin, *lat.inner]

    def ways(w, first):
        if first:
            for j in range(len(w) + 1):
                if w[:j] in lat.begin:
                    yield from (((names.index(w[:j]), *ks), math.exp(lat.begin[w[:j]]) * p) for ks, p in ways(w[j:], False))
        elif not w:
            yield (), 1.0
        else:
            for j in range(1, len(w) + 1):
                if w[:j] in lat.inner:
                    k = len(lat.begin) + list(lat.inner).index(w[:j])
                    yield from (((k, *ks), math.exp(lat.inner[w[:j]]) * p) for ks, p in ways(w[j:], False))

    words = [b"the", "né".encode(), b"zqx", b"other"]
    want = np.zeros(len(names))
    for w in words:
        every = list(ways(w, True))
        for ks, p in every:
            for k in ks:
                want[k] += p / sum(q for _, q in every)
    assert np.allclose(lat.expect(words), want, rtol=1e-9, atol=1e-12)
    long = lat.expect([b"ab" * 50])
    lengths = np.array([len(x) for x in names])
    assert math.isclose(long @ lengths, 100, rel_tol=1e-9)
    new = lat.learned(want)
    assert math.isclose(sum(map(math.exp, [*new.begin.values(), *new.inner.values(), new.end])), 1, rel_tol=1e-9)
    assert sum(map(new.log_probability, words)) > sum(map(lat.log_probability, words))
    for w in (b"ab" * 16, b"ab" * 16 + b"c"):  # either side of the length from which on logarithms are summed
        f = new._forward(w, True)[-1]
        assert math.isclose(new.log_probability(w), math.log(f), rel_tol=1e-9)


def test_lattice_lm_learns(spark, tmp_path):
    """Held-out texts score about as the base does, and all scores are finite; words that are new are spelled."""
    rng = random.Random(5)
    parts = "the of and ing tion er ist sch ver eau".split()
    vocabulary = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    some = lambda: " ".join("".join(rng.choice(parts) for _ in range(4)) if rng.random() < 0.05 else vocabulary[min(int(rng.expovariate(0.02)), 399)] for _ in range(150))
    texts = [(i, None if i == 3 else "" if i == 4 else some()) for i in range(300)]
    frame(spark, texts).write.parquet(f"file://{tmp_path}/documents.parquet")
    got = by_id(QUERIES["op9_lattice_lm"](spark, f"file://{tmp_path}"))
    assert len(got) == 300 and all(math.isfinite(r[c]) for r in got.values() for c in ("score", "base_score", "lattice_score"))
    out = [r for r in got.values() if r["held_out"]]
    base = sum(r["base_score"] for r in out)
    assert out and sum(r["score"] for r in out) > 1.1 * base and sum(r["lattice_score"] for r in out) < 1.2 * base
    again = by_id(QUERIES["op9_lattice_lm"](spark, f"file://{tmp_path}"))
    assert again == got


def test_lattice_lm_learns_nothing(spark):
    """Without training documents, words are spelled by the given weights."""
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:3]
    got = by_id(lattice_lm(frame(spark, [(i, "some new words") for i in held]), P.path("piece_bpe_32k.model"), rounds=2))
    assert len(got) == 3 and all(math.isclose(r["model_score"], r["score"], rel_tol=1e-9) for r in got.values())


def test_lattice_lm_many_words(spark):
    """Owners make room as distinct words come, of training documents and of others."""
    path = P.path("piece_bpe_32k.model")
    texts = [(i, " ".join(f"w{i}x{j} all" for j in range(900))) for i in range(40)]
    c = Counter(w for i, t in texts if zlib.crc32(str(i).encode()) % 10 for w in t.split())
    got = by_id(lattice_lm(frame(spark, texts), path, chunk_mb=1))
    for i, t in texts:
        assert got[i]["n_known"] == sum(c[w] > 0 for w in t.split()) + 1
        n = sum(c.values()) + sum(zlib.crc32(str(k).encode()) % 10 > 0 for k, _ in texts)
        ends = n - sum(c.values())
        assert got[i]["train_tokens"] == n and math.isclose(got[i]["base_score"], sum(math.log10((x + 0.1) / (n + 0.1 * (len(c) + 2))) for x in [*(c[w] for w in t.split()), ends]), rel_tol=1e-9)


def test_warc(spark, tmp_path):
    pages = [(3, "http://a/ b", "same"), (1, "u", "same"), (2, None, "x" * 300_000), (5, "v", None), (4, "w", ""), (None, "n", "same"), (6, "z", "\x1f\x8b\x08 é"), (1, "u", "same")]
    pages += [(100 + i, "u", f"page {i} " * random.Random(i).randint(1, 400)) for i in range(200)]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, digest string").repartition(2)
    files = write_warc(df, f"file://{tmp_path}/warc", file_mb=1)
    for split in (1, 32):
        rows = read_warc(files, split_mb=split, payloads=True).collect()
        first = {}
        for i, _, h in pages:
            if i is not None:
                first[h or ""] = min(i, first.get(h or "", i))
        want = []
        for i, _, h in pages:
            b = (h or "").encode()
            f = first.get(h or "")
            again = f is not None and i != f
            want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", f if again else None, None if again else b))
        assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, want))
    assert read_warc(files.limit(0)).count() == 0


def test_warc_byte_ranges(spark, tmp_path):
    """Any cut of a file into ranges gives each record once."""
    df = spark.createDataFrame([(i, "u", f"text {i} " * i) for i in range(40)], "page_id long, url string, html string").coalesce(1)
    path, size, n = write_warc(df, f"file://{tmp_path}/w").first()
    for step in (97, 1000, size):
        got = [r["page_id"] for a in range(0, size, step) for r in records_in(path, a, min(size, a + step))]
        assert sorted(got) == list(range(40)) and n == 40


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, oracle, name):
    oracle(QUERIES[name](spark, SF), ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, tmp_path, name):
    for t in ("documents", "pages", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"file://{tmp_path}/{t}.parquet")
    assert QUERIES[name](spark, f"file://{tmp_path}").count() == 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_null_rows(spark, tmp_path, name):
    for t in ("documents", "pages", "benchmark"):
        df = spark.read.parquet(f"{SF}/{t}.parquet")
        df.limit(5).unionByName(df.limit(1).selectExpr(*[f"CAST(NULL AS {d}) AS {c}" for c, d in df.dtypes])).write.parquet(f"file://{tmp_path}/{t}.parquet")
    assert QUERIES[name](spark, f"file://{tmp_path}").count() == 6


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_very_long(spark, tmp_path, name):
    """One long text and one long word beside short texts; all of each counts."""
    rng = random.Random(4)
    long = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(100_000))
    word = "".join(rng.choice("abcdefgh") for _ in range(400_000))
    texts = [long, word, "a few words", long + " and an end", None]
    spark.createDataFrame([(i, t, "en", "src1", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, "u", t) for i, t in enumerate(texts)], "page_id long, url string, html string").write.parquet(f"file://{tmp_path}/pages.parquet")
    spark.createDataFrame([(1, " ".join(long.split()[-30:])), (2, word)], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    got = by_id(QUERIES[name](spark, f"file://{tmp_path}"), "page_id" if name == "op4_warc" else "doc_id")
    assert set(got) == set(range(5))
    size, words = [len(t or "") for t in texts], [len((t or "").split()) for t in texts]
    if name == "op1_suffix_dedup":
        assert [got[i]["n_bytes"] for i in range(5)] == size and [got[i]["n_removed"] for i in range(5)] == [0, 0, 0, size[0], 0]
    if name == "op8_substring_dedup":
        assert [got[i]["n_words"] for i in range(5)] == words and [got[i]["n_removed"] for i in range(5)] == [words[0], 0, 0, words[0], 0]
    if name == "op6_decontaminate":
        assert [got[i]["n_hit"] for i in range(5)] == [30, 1, 0, 30, 0]
    if name == "op10_near_dedup":
        assert [got[i]["component_id"] for i in range(5)] == [0, 1, 2, 0, 4]
    if name == "op9_lattice_lm":
        assert [got[i]["n_tokens"] for i in range(5)] == [n + 1 for n in words] and got[1]["score"] < -100_000
    if name == "op4_warc":
        assert [got[i]["payload_bytes"] for i in range(5)] == size


def test_warc_revisits_refer_to_records(spark, tmp_path):
    """By the standard heads: a revisit names the record, address and date of the response that it repeats."""
    import zlib

    df = spark.createDataFrame([(2, "http://b/", "same"), (1, "http://a/ x", "same"), (3, "http://c/", "other")], "page_id long, url string, html string").coalesce(1)
    heads = []
    for f in write_warc(df, f"file://{tmp_path}/w").collect():
        rest = open(f["path"].removeprefix("file://"), "rb").read()
        while rest:
            member = zlib.decompressobj(31)
            head = member.decompress(rest).partition(b"\r\n\r\n")[0].decode()
            heads.append(dict(x.split(": ", 1) for x in head.split("\r\n")[1:]))
            rest = member.unused_data
    by = {h["X-Page-ID"]: h for h in heads}
    assert by["2"]["WARC-Refers-To"] == by["1"]["WARC-Record-ID"] and by["2"]["WARC-Refers-To-Target-URI"] == "http://a/%20x" == by["1"]["WARC-Target-URI"]
    assert by["2"]["WARC-Refers-To-Date"] == by["1"]["WARC-Date"] and not any("Refers" in k for i in "13" for k in by[i])
    assert len({h["WARC-Record-ID"] for h in heads}) == 3
