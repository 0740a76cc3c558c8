"""The jobs: growing input, replaced documents, batches that run again, and what SQL says of the whole tables."""

import logging
import re
import shutil
from collections import Counter
from pathlib import Path

import pytest
import yaml

from jobs import build_graph, common, index_documents
from jobs.index_documents import Index, Settings
from jobs.queries import ORACLE_SQL, QUERIES
from loreweave.errors import ConfigurationError

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, oracle, name):
    kept = dict(spark.conf.getAll)
    oracle(QUERIES[name](spark, SF), ORACLE_SQL[name])
    assert dict(spark.conf.getAll) == kept


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_entry_has_the_jobs(name):
    import __spark_entry__ as entry

    assert name in entry.queries() and name in entry.oracle_sql()


class Growing:
    """A folder of document files that grows, and the index of it."""

    def __init__(self, spark, folder):
        self.spark, self.source, self.folder, self.n = spark, f"{folder}/docs", folder, 0

    def add(self, docs):
        df = self.spark.createDataFrame([(i, t, "en" if t else None, 5) for i, t in docs], "doc_id long, text string, lang string, batch_size long")
        df.coalesce(1).write.mode("append").parquet(self.source)

    def run(self, **more):
        return rows(index_documents.index_documents(self.spark, f"file://{self.source}", f"file://{self.folder}/index", f"file://{self.folder}/checkpoint", Settings(chunk_size=100, chunk_overlap=20, **more)))

    def afresh(self, docs):
        """What an index made at once of the given documents has."""
        self.n += 1
        other = Growing(self.spark, f"{self.folder}/afresh{self.n}")
        other.add(docs)
        return other.run()

    def batches(self):
        return sorted(p.name for p in Path(self.folder, "index/documents").iterdir() if p.name.startswith("batch="))


LONG = " ".join(f"Word{i % 17} and {i} more;" for i in range(60))


def test_growing_input(spark, tmp_path, caplog):
    g = Growing(spark, tmp_path)
    g.add([(1, "A cat, a dog."), (2, LONG), (3, ""), (4, None), (None, "without id"), (5, "same"), (5, "same"), (6, "older"), (6, "the greater text")])
    with caplog.at_level(logging.INFO, "loreweave.jobs"):
        first = g.run()
    assert first == g.afresh([(1, "A cat, a dog."), (2, LONG), (3, ""), (4, None), (5, "same"), (6, "the greater text")])
    assert "batch 0: 9 rows read, 6 documents" in caplog.text and "1 batches" in caplog.text
    caplog.clear()
    with caplog.at_level(logging.INFO, "loreweave.jobs"):
        assert g.run() == first and g.batches() == ["batch=0"]
    assert "0 batches" in caplog.text
    # new documents, one that changes, one that loses its text, one that gets one, one that comes again as it was
    g.add([(7, "A new dog"), (2, "short now"), (1, None), (3, "no longer empty"), (5, "same")])
    second = g.run()
    assert g.batches() == ["batch=0", "batch=1"]
    assert second == g.afresh([(1, None), (2, "short now"), (3, "no longer empty"), (4, None), (5, "same"), (6, "the greater text"), (7, "A new dog")])
    g.add([(2, LONG), (1, "A cat, a dog.")])
    third = g.run()
    assert third == g.afresh([(1, "A cat, a dog."), (2, LONG), (3, "no longer empty"), (4, None), (5, "same"), (6, "the greater text"), (7, "A new dog")])
    words = [re.findall(r"[a-z0-9]+", r.lower()) for r in ("A cat, a dog.", "no longer empty", "same", "the greater text", "A new dog")]
    term = {r[1]: (r[4], r[5]) for r in third if r[0] == "term" and not r[1].startswith("word") and not r[1].isdigit() and r[1] not in ("and", "more")}
    df, tf = Counter(t for w in words for t in set(w)), Counter(t for w in words for t in w)
    assert {t: v for t, v in term.items() if t in df} == {t: (df[t], tf[t]) for t in df}


def test_batch_that_runs_again(spark, tmp_path):
    """After the loss of the driver, the last batch runs anew over what it has written, in whole or in part."""
    g = Growing(spark, tmp_path)
    g.add([(1, "one two"), (2, "two three")])
    g.run()
    g.add([(2, "three four"), (3, LONG)])
    want = g.run()
    for lost in ((), ("terms",), ("documents", "terms")):
        for name in ("1", ".1.crc"):
            Path(tmp_path, "checkpoint/commits", name).unlink(missing_ok=True)
        for table in lost:
            shutil.rmtree(tmp_path / f"index/{table}/batch=1")
        assert g.run() == want and g.batches() == ["batch=0", "batch=1"]


def test_files_per_batch(spark, tmp_path):
    g = Growing(spark, tmp_path)
    for i in range(3):
        g.add([(i, f"text {i}"), (9, f"last {i}")])
    out = g.run(files_per_batch=1)
    assert len(g.batches()) == 3 and sum(r[0] == "chunk" for r in out) == 4
    assert {r[1]: r[4] for r in out if r[0] == "term"}["text"] == 3


def test_no_documents(spark, tmp_path):
    g = Growing(spark, tmp_path)
    g.add([])
    assert g.run() == []
    index = Index(spark, f"file://{tmp_path}/none", [])
    assert index.terms().count() == 0 and index.current("chunks").count() == 0


def test_graph_of_small_tables(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (1, "A"), (2, None), (None, "z")], "k int, n string").write.parquet(f"{tmp_path}/t/person.parquet")
    spark.createDataFrame([(1, 2), (1, 2), (2, 1), (2, 9), (None, 1)], "a long, b long").write.parquet(f"{tmp_path}/t/knows.parquet")
    config = tmp_path / "c.yaml"
    config.write_text(yaml.safe_dump({"nodes": {"Person": {"table": "person", "id": "k", "name": "n"}}, "edges": {"knows": {"table": "knows", "from": ["Person", "a"], "to": ["Person", "b"]}}}))
    for _ in range(2):
        got = rows(build_graph.build_graph(spark, f"file://{tmp_path}/t", f"file://{tmp_path}/out", build_graph.read_settings(config)))
        assert got == sorted([("valid", "knows", 1, 2, None, 2, None), ("valid", "knows", 2, 1, None, 1, None), ("dangling", "knows", 2, 9, None, 1, None), ("dangling", "knows", None, 1, None, 1, None), ("node", "Person", 1, None, "A", 1, 1), ("node", "Person", 2, None, None, 1, 1)], key=repr)
    assert (tmp_path / "out/edges/status=valid/edge_type=knows").is_dir() and (tmp_path / "out/nodes/node_type=Person").is_dir()


def test_graph_replaces_what_was_there(spark, tmp_path):
    for name in ("customer", "orders", "lineitem", "part", "supplier", "nation", "region"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{tmp_path}/t/{name}.parquet")
    before = rows(build_graph.build_graph(spark, f"file://{tmp_path}/t", f"file://{tmp_path}/out"))
    spark.read.parquet(f"{SF}/nation.parquet").filter("n_nationkey < 5").write.mode("overwrite").parquet(f"{tmp_path}/t/nation.parquet")
    after = build_graph.build_graph(spark, f"file://{tmp_path}/t", f"file://{tmp_path}/out")
    assert {r["id"] for r in after.filter("kind = 'Nation'").collect()} == set(range(5)) and after.filter("part = 'dangling' AND kind = 'located_in' AND other_id >= 5").count() > 0
    spark.read.parquet(f"{SF}/nation.parquet").write.mode("overwrite").parquet(f"{tmp_path}/t/nation.parquet")
    assert rows(build_graph.build_graph(spark, f"file://{tmp_path}/t", f"file://{tmp_path}/out")) == before


def test_graph_is_written_where_its_joins_left_it(spark, tmp_path, monkeypatch):
    """No exchange by ranges, which makes the last joins twice, and no sort by names of types; files are in order of ids still."""
    import pyarrow.parquet as pq
    from pyspark.sql import DataFrameWriter

    plans, write = [], DataFrameWriter.parquet

    def parquet(self, path, *args, **more):
        plans.append(self._df._jdf.queryExecution().executedPlan().toString())
        return write(self, path, *args, **more)

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    key = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key, None)
    build_graph.build_graph(spark, SF, f"file://{tmp_path}/out")
    assert len(plans) == 2 and not any("rangepartitioning" in p for p in plans) and spark.conf.get(key, None) == before
    assert not any(re.search(r"Sort \[(status|edge_type|node_type)", p) for p in plans)
    for part, first, kinds in (("edges", "from_id", {"dangling/placed", "valid/placed"}), ("nodes", "id", {"Customer", "Order"})):
        files = list((tmp_path / "out" / part).rglob("*.parquet"))
        assert kinds <= {"/".join(x.split("=")[1] for x in f.relative_to(tmp_path / "out" / part).parts[:-1]) for f in files}
        for f in files:
            ids = pq.ParquetFile(f).read([first])[first].to_pylist()
            assert ids == sorted(ids)


def test_settings(tmp_path):
    assert Settings.read(index_documents.CONFIG) == Settings() and set(build_graph.read_settings(build_graph.CONFIG)["nodes"]) >= {"Customer", "Order"}
    bad = tmp_path / "bad.yaml"
    for text in ("- 1", "nodes: {}\nother: 1", "nodes: {}\nedges: {e: {table: t, from: [A, x], to: [B, y]}}"):
        bad.write_text(text)
        with pytest.raises(ConfigurationError):
            build_graph.read_settings(bad)


def test_command_line(spark, tmp_path, monkeypatch):
    """The command line hands its paths to the job and stops its session; here it is the tests' own, which stays."""
    monkeypatch.setattr(type(spark), "stop", lambda self: None)
    g = Growing(spark, tmp_path)
    g.add([(1, "one two")])
    config = tmp_path / "c.yaml"
    config.write_text("chunk_size: 200\ncarry: []\n")
    assert index_documents.main(["--source", g.source, "--output", f"{tmp_path}/index", "--checkpoint", f"{tmp_path}/checkpoint", "--config", str(config)]) == 0
    assert Index(spark, f"{tmp_path}/index", []).current("chunks").first()["content"] == "one two"
    assert build_graph.main(["--source", SF, "--output", f"{tmp_path}/graph"]) == 0 and (tmp_path / "graph/nodes").is_dir()
    with pytest.raises(SystemExit):
        common.command("x", build_graph.build_graph, build_graph.read_settings, ("source",), build_graph.CONFIG, [])


def test_chunks_carry_columns_without_a_join(spark):
    """Chunks get a document's columns, and terms their counts, where the rows are: no exchange has texts or a row for each word."""
    from pyspark.sql import functions as F

    from loreweave.operators.index import entries, word_counts

    docs = spark.createDataFrame([(1, "b a b", "en"), (2, None, "fr"), (3, "c", None)], "doc_id long, text string, lang string")
    chunks = entries(docs, "d", ["text"], id_col="doc_id", carry=["lang"])
    assert rows(chunks.select("source_id", "content", "lang")) == [(1, "b a b", "en"), (3, "c", None)]
    counts = word_counts(chunks.withColumn("fts_content", F.col("content")))
    assert rows(counts.select("term", "tf")) == [("a", 1), ("b", 2), ("c", 1)]
    assert "Exchange" not in counts._jdf.queryExecution().executedPlan().toString()
