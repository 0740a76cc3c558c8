"""Tables that are changed in part: what is written, what readers see, and what is left behind."""

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from loreweave.model import Config
from loreweave.plans.engine import Engine
from loreweave.shared import cut, shared_folder, temporary_tables
from loreweave.sources.store import Snapshots, folders
from tests.harbour import ITEMS, KB

SCHEMA = "k long, v string, n long"


def size_of(path):
    return sum(f.stat().st_size for f in Path(path).rglob("*") if f.is_file())


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_changes_against_a_dictionary(spark, tmp_path):
    """Rows replaced, added and taken away over many versions, with and without rewrites, read as one table."""
    import random

    rng = random.Random(1)
    for most in (0, 2):
        s = Snapshots(f"file://{tmp_path}/{most}", spark, delta_from=0, most_deltas=most, most_share=1e9)
        want = {i: (i, f"a{i}", 0) for i in range(40)}
        s.publish({"t": spark.createDataFrame(list(want.values()), SCHEMA)})
        schema = s.read(spark, "t", spark.createDataFrame([], SCHEMA).schema).schema
        for step in range(1, 6):
            put = {k: (k, f"b{step}", step) for k in rng.sample(range(60), 5)}
            gone = rng.sample(range(60), 4)
            with s.version() as v:
                told = v.change("t", spark.createDataFrame([r for k, r in put.items() if k not in gone], SCHEMA), "k", spark.createDataFrame([(k,) for k in gone], "k long"))
                want = {k: r for k, r in (want | put).items() if k not in gone}
                assert rows(v.read(spark, "t", schema)) == sorted(want.values()) and told.count() == len(set(put) - set(gone))
            assert rows(s.read(spark, "t", schema)) == sorted(want.values())
            assert len(folders(s.manifest()["t"])) <= most + 1
        assert s.read(spark, "t", schema).filter("v = 'b5'").count() == sum(r[1] == "b5" for r in want.values())


def test_added_rows(spark, tmp_path):
    """Without a key nothing is replaced; a layout holds for what is written anew."""
    s = Snapshots(f"file://{tmp_path}", spark, delta_from=0, most_deltas=2, most_share=1e9)
    add = lambda n: spark.createDataFrame([(1, n)], "k long, n long")
    total = lambda df: df.groupBy("k").agg(F.sum("n").alias("n"))
    for n in range(1, 8):
        with s.version() as v:
            v.change("t", add(n), layout=total)
        held = s.read(spark, "t", add(0).schema)
        assert rows(total(held)) == [(1, n * (n + 1) // 2)] and held.count() <= 3


def test_a_small_change_of_a_large_table_writes_little(spark, tmp_path):
    """Ten rows of a million: under a hundredth of the table's bytes, and no scan is shuffled to read them."""
    s = Snapshots(f"file://{tmp_path}", spark)
    s.publish({"t": spark.range(1_000_000).select(F.col("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v"), F.lit(0).cast("long").alias("n"))})
    base = size_of(tmp_path)
    schema = s.read(spark, "t", spark.createDataFrame([], SCHEMA).schema).schema
    with s.version() as v:
        v.change("t", spark.createDataFrame([(i, "new", 1) for i in range(10)], SCHEMA), "k", spark.createDataFrame([(999_999,)], "k long"))
    assert size_of(tmp_path) - base < base / 100
    now = s.read(spark, "t", schema)
    assert now.count() == 999_999 and now.filter("n = 1").count() == 10 and now.filter("k = 999999").isEmpty()
    plan = now._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_rewrites_by_share(spark, tmp_path):
    s = Snapshots(f"file://{tmp_path}", spark, delta_from=0, most_deltas=50, most_share=0.5)
    many = lambda a, b: spark.range(a, b).select(F.col("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v"), F.lit(0).cast("long").alias("n"))
    s.publish({"t": many(0, 20_000)})
    with s.version() as v:
        v.change("t", many(20_000, 22_000), "k", many(0, 1).select("k"))
    assert len(folders(s.manifest()["t"])) == 2
    with s.version() as v:
        v.change("t", many(30_000, 50_000), "k", many(0, 1).select("k"))
    assert len(folders(s.manifest()["t"])) == 1 and s.read(spark, "t", many(0, 1).schema).count() == 41_999


def vessel(hull, **more):
    return {"type": "Vessel", "hull": hull, **more}


@pytest.fixture
def kb(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/kb", Config.parse(KB), retention=0.0)
    e.snapshots.delta_from, e.snapshots.most_share, e.snapshots.most_deltas = 0, 1e9, 3
    e.import_items(ITEMS)
    return e


def state(e):
    """All that readers can see, but ids of index entries and times."""
    links = e.links()
    return [
        rows(e.nodes("Vessel").select("__id", "hull", "tons", "log")), rows(e.edges("tows").select("__from_id", "__to_id", "rope")), rows(links.by_source.select("edge_type", "from_id", "to_id")), rows(links.by_target.select("edge_type", "from_id", "to_id")),
        rows(e.index().select("source_table", "source_id", "source_field", "content", F.size("vector"))), rows(e.postings().join(e.index().select("id", "source_id"), "id").select("source_id", "term", "tf", "dl")),
        rows(e.index_stats().groupBy("source_table").agg(*[F.sum(c) for c in ("documents", "chunks", "tokens")])), e.cache().count(),
    ]


CHANGES = [
    [vessel("Ibis", log="Ibis sails"), vessel("Lark", log="Lark dives"), {"type": "tows", "source": {"hull": "Lark"}, "target": {"hull": "Heron"}}],
    [vessel("Jay", action="delete"), vessel("Kite", tons=9)],
    [{"type": "tows", "source": {"hull": "Lark"}, "target": {"hull": "Heron"}, "rope": "wire"}, vessel("Ibis", action="delete"), vessel("Mew", log="Mew calls")],
    [{"type": "tows", "source": {"hull": "Lark"}, "target": {"hull": "Heron"}, "action": "delete"}, vessel("Mew"), vessel("Mew", action="delete")],
]


def test_changes_of_a_knowledge_base(spark, tmp_path, kb):
    """Changes that are merged on read leave what whole rewrites leave, and searches see them."""
    whole = Engine(spark, f"file://{tmp_path}/whole", Config.parse(KB))
    whole.import_items(ITEMS)
    for i, items in enumerate(CHANGES):
        assert kb.import_items(items)["nodes"] == whole.import_items(items)["nodes"]
        if i in (0, len(CHANGES) - 1):
            assert state(kb) == state(whole)
        if i == 0:
            assert all(len(folders(kb.snapshots.manifest()[t])) > 1 for t in ("vessels", "edge_tows", "_sys_search_index.vessels", "_sys_search_postings.vessels"))
            assert kb.fts_search("green") == [] and kb.fts_search("sails")[0]["content"] == "Ibis sails" and kb.vector_search("Lark dives")[0]["content"] == "Lark dives"
            assert [n["node"]["hull"] for n in kb.get_neighbors("Vessel", "Lark")["neighbors"]] == ["Heron"]
    for t in ("vessels", "_sys_search_index.vessels"):
        assert isinstance(whole.snapshots.manifest()[t], str)


def test_ids_are_given_out_once(kb):
    """A node that goes takes its id with it, and an index entry too; also if it had the highest."""
    ids = {r["hull"]: r["__id"] for r in kb.nodes("Vessel").collect()}
    last = max(ids, key=ids.get)
    entries = {r["id"] for r in kb.index().collect()}
    kb.import_items([vessel(last, action="delete")])
    kb.import_items([vessel("Lark")])
    assert kb.nodes("Vessel").filter("hull = 'Lark'").first()["__id"] > max(ids.values())
    fresh = {r["id"] for r in kb.index().collect()} - entries
    assert min(fresh) > max(entries)
    kb.import_items([vessel("Lark", action="delete"), vessel("Mew"), vessel("Mew", action="delete")])
    kb.import_items([vessel("Owl")])
    assert kb.nodes("Vessel").filter("hull = 'Owl'").first()["__id"] > max(ids.values()) + 2
    assert Engine(kb.spark, kb.path, kb.config).snapshots.latest()[2]["vessels"] == kb.nodes("Vessel").agg(F.max("__id")).first()[0]


def test_nothing_is_left_behind(spark, kb):
    """Imports, searches and paths remove the tables that they cut lineage with, and versions that nobody reads go."""
    shared = Path(shared_folder(spark).removeprefix("file://"))
    root = Path(kb.snapshots.root.removeprefix("file://"))
    before = {p for p in os.listdir(shared) if p.startswith("kb-")}
    seen = []
    for i in range(6):
        kb.import_items([vessel("Ibis", log=f"Ibis number {i}")])
        if i % 3 == 0:
            kb.traverse("Vessel", "Heron", return_paths=False)
            kb.find_paths("Vessel", "Heron", "Vessel", "Jay")
        seen.append(sum(1 for _ in root.glob("v-*/*")))
    assert {p for p in os.listdir(shared) if p.startswith("kb-")} == before
    assert seen[-1] <= max(seen[:4]) + 12 and len([p for p in os.listdir(root) if p.startswith("CURRENT")]) == 2


def test_temporary_tables(spark):
    shared = Path(shared_folder(spark).removeprefix("file://"))
    count = lambda: sum(p.startswith("kb-") for p in os.listdir(shared))
    n = count()
    with temporary_tables(spark):
        with temporary_tables(spark):
            df = cut(spark.range(3))
        assert df.count() == 3 and count() == n + 1
    assert count() == n
    cut(spark.range(3))
    assert count() == n + 1
