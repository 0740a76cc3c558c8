"""A small knowledge base end to end."""

import io
import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
import yaml
from pyspark.sql import functions as F

from loreweave import cli
from loreweave.errors import ConflictError, InvalidTableNameError, KnowledgeBaseError, NodeNotFoundError, ValidationError
from loreweave.model import INDEX_SCHEMA, Config
from loreweave.operators import graph, merge, search
from loreweave.plans import mcp
from loreweave.plans.engine import Engine
from loreweave.plans.service import tools
from loreweave.sources.embedder import HttpEmbedder
from loreweave.sources.store import read_jsonl
from tests.harbour import ITEMS, KB, NORTH


def vessel(hull, **more):
    return {"type": "Vessel", "hull": hull, **more}


def name(node):
    return node.get("hull") or node["quay"]


@pytest.fixture(scope="module")
def kb(spark, tmp_path_factory):
    e = Engine(spark, tmp_path_factory.mktemp("kb"), Config.parse(KB))
    result = e.import_items(ITEMS)
    assert result["status"] == "success" and result["nodes"]["upserted"] == {"Vessel": 4, "Berth": 1} and result["edges"]["upserted"] == {"tows": 2, "moors": 1}
    assert result["indexed"] == 6 + 3 and result["vectors"]["failed"] == 0 and result["version"] == e.snapshots.current
    return e


def test_records(kb):
    row = kb.nodes("Vessel").filter("hull = 'Heron'").first()
    assert (row["tons"], row["draught"], row["afloat"], row["flags"], row["launched"].year) == (300, 2.5, True, '["red", 7]', 1990)
    assert kb.get_source_record("vessels", row["__id"])["hull"] == "Heron" and kb.get_source_record("vessels", 999) is None
    with pytest.raises(InvalidTableNameError):
        kb.get_source_record("a b", 1)
    with pytest.raises(ValueError, match="Unknown table"):
        kb.get_source_record("rafts", 1)
    assert kb.resolve("Vessel", "Heron") == row["__id"] == kb.resolve("Vessel", row["__id"]) and kb.resolve("Vessel", "Zed") is None


def test_search(kb):
    assert kb.search("") == [] and kb.search(" \n") == [] and kb.search("salt", limit=0) == [] and kb.fts_search("?!") == []
    with pytest.raises(ValueError):
        kb.search("", limit=-1)
    with pytest.raises(ValueError, match="Unknown node type"):
        kb.fts_search("salt", node_type="Raft")
    hits = kb.fts_search("salt")
    assert {h["source_table"] for h in hits} == {"vessels", "berths"} and [h["score"] for h in hits] == sorted((h["score"] for h in hits), reverse=True)
    assert {h["source_table"] for h in kb.fts_search("salt", node_type="Berth")} == {"berths"}
    assert [h["content"] for h in kb.fts_search("GREEN", limit=3)] == ["Ibis was painted green in spring"]
    assert kb.vector_search("Ibis was painted green in spring")[0]["content"] == "Ibis was painted green in spring"
    both = kb.search("salt", node_type="Vessel", limit=5)
    assert both[0]["content"].startswith("Heron carries") and both[0]["_meta"] == {"rank": 1, "rrf_k": 10, "auto_k": True, "strategy": "document_count"} and both[0]["score"] <= 1
    seed = kb.graph_search("salt", node_type="Vessel", search_limit=1)[0]
    assert {c["node_type"] for c in seed["context"]} == {"Vessel", "Berth"}


def test_scores_of_scan_and_postings(kb):
    for terms in (["salt", "barley"], ["green", "none"], []):
        scan = {r["id"]: r["score"] for r in search.bm25_scores(kb.index(), terms, "content").collect()}
        assert {r["id"]: r["score"] for r in kb._text_scores(" ".join(terms), None).collect()} == pytest.approx(scan)
    some = search.bm25_scores(kb.index(), ["salt"], "content", F.col("source_table") == "berths")
    assert {r["score"] for r in some.collect()} < {r["score"] for r in search.bm25_scores(kb.index(), ["salt"], "content").collect()}


def test_sql(kb):
    assert kb.query_raw_sql("SELECT hull FROM vessels WHERE tons > 350 ORDER BY hull;") == [{"hull": "Ibis"}, {"hull": "Jay"}]
    assert kb.query_raw_sql("WITH x AS (SELECT 1 AS a) SELECT a FROM x -- end") == [{"a": 1}]
    assert kb.query_raw_sql("SELECT 'delete' AS w, (SELECT max(tons) FROM vessels) AS t") == [{"w": "delete", "t": 500}]
    rich = "SELECT v.hull, count(*) OVER () AS n FROM vessels v LEFT ANTI JOIN edge_tows e ON e.__from_id = v.__id WHERE EXISTS (SELECT 1 FROM berths) GROUP BY v.hull HAVING count(*) > 0 ORDER BY 1"
    assert [r["hull"] for r in kb.query_raw_sql(rich)] == ["Jay", "Kite"]
    assert len(kb.query_raw_sql("SELECT x FROM vessels LATERAL VIEW explode(sequence(1, 3)) t AS x")) == 12
    assert kb.query_raw_sql("WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 4) SELECT sum(n) AS s FROM r") == [{"s": 10}]
    with pytest.raises(ValueError, match="as JSON"):
        kb.query_raw_sql("SELECT repeat('x', 4000) AS a FROM range(1000)")


@pytest.mark.parametrize("bad", [
    "DROP TABLE x", "CREATE TABLE t AS SELECT 1", "INSERT INTO vessels SELECT 1", "SHOW TABLES", "SET a = 1", "SET spark.sql.ansi.enabled", "SELECT 1; SELECT 2", "EXPLAIN SELECT 1", "DESCRIBE vessels", "CACHE TABLE vessels", "ADD JAR '/x'",
    "SELECT * FROM parquet.`/root/testdata/sf0.001/nation.parquet`", "SELECT * FROM json.`/etc/passwd`", "INSERT OVERWRITE DIRECTORY '/tmp/none' USING parquet SELECT 1",
    "SELECT TRANSFORM(hull) USING 'echo hi' AS (x STRING) FROM vessels", "SELECT * FROM (SELECT TRANSFORM(hull) USING 'cat' AS (x STRING) FROM vessels)",
    "SELECT reflect('java.lang.System', 'getProperty', 'java.home')", "SELECT 1 WHERE java_method('java.lang.System', 'nanoTime') > 0", "SELECT (SELECT try_reflect('java.lang.System', 'nanoTime'))", "WITH a AS (SELECT REFLECT('java.lang.System', 'nanoTime') AS x) SELECT * FROM a",
    "SELECT * FROM VALUES (reflect('java.lang.System', 'nanoTime')) AS t(a)", "SELECT IDENTIFIER('reflect')('java.lang.System', 'nanoTime')", "SELECT input_file_name() FROM vessels", "SELECT * FROM vessels WHERE Input_File_Block_Start() >= 0", "SELECT _metadata.file_path FROM vessels", "SELECT * FROM foreign_view", "SELECT * FROM default.vessels", "SELECT * FROM global_temp.seen", "SELECT own_function(1)", "",
])
def test_sql_refuses(kb, spark, bad):
    spark.range(3).createOrReplaceTempView("foreign_view")
    spark.range(3).createOrReplaceGlobalTempView("seen")
    spark.udf.register("own_function", lambda x: x)
    with pytest.raises(Exception):  # noqa: B017  what Spark itself refuses is its own error
        kb.query_raw_sql(bad)


def test_sql_caps_rows(kb, spark):
    """Only a LIMIT of the query itself lifts the cap."""
    for text in ("SELECT id FROM range(3000) -- LIMIT 9000", "SELECT id FROM range(3000) WHERE id < (SELECT 5000 LIMIT 1)", "SELECT id, 'LIMIT 5000' AS t FROM range(3000)", "WITH x AS (SELECT id FROM range(3000) LIMIT 2500) SELECT * FROM x"):
        assert len(kb.query_raw_sql(text)) == 1000
    assert len(kb.query_raw_sql("SELECT id FROM range(3000) ORDER BY id LIMIT 1500 OFFSET 100")) == 1500 and len(kb.query_raw_sql("WITH x AS (SELECT 1) SELECT id FROM range(3000) LIMIT 2000")) == 2000
    assert spark.conf.get("spark.sql.runSQLOnFiles", "true") == "true" and "vessels" not in [t.name for t in spark.catalog.listTables()]


def test_graph(kb):
    near = kb.get_neighbors("Vessel", "Heron")
    assert near["stats"] == {"total_count": 2, "by_edge_type": {"tows": 1, "moors": 1}} and near["node"]["hull"] == "Heron"
    assert [n["node"]["hull"] for n in kb.get_neighbors("Vessel", "Ibis", direction="in")["neighbors"]] == ["Heron"]
    assert kb.get_neighbors("Vessel", "Kite")["neighbors"] == [] and kb.get_neighbors("Vessel", "Ibis", edge_types=["moors"])["neighbors"] == [] and kb.get_neighbors("Vessel", "Heron", limit=0)["neighbors"] == []
    with pytest.raises(NodeNotFoundError):
        kb.get_neighbors("Vessel", "Zed")
    for bad in ({"direction": "up"}, {"limit": -1}):
        with pytest.raises(ValueError):
            kb.get_neighbors("Vessel", "Heron", **bad)
    with pytest.raises(ValueError):
        kb.traverse("Vessel", "Heron", max_depth=0)
    assert [(name(x["node"]), x["min_depth"], x["paths_count"]) for x in kb.traverse("Vessel", "Heron", return_paths=False)] == [("north", 1, 1), ("Ibis", 1, 1), ("Jay", 2, 1)]
    assert [x["depth"] for x in kb.traverse("Vessel", "Heron", max_depth=2)] == [1, 1, 2] and len(kb.traverse("Vessel", "Heron", limit=1)) == 1
    path = kb.find_paths("Vessel", "Jay", "Berth", "north")[0]
    assert path["length"] == 3 and path["node_types"] == ["Vessel"] * 3 + ["Berth"] and [x.get("edge_type") for x in path["path"]] == [None, "tows", None, "tows", None, "moors", None]
    assert kb.find_paths("Vessel", "Heron", "Vessel", "Heron")[0]["length"] == 0 and kb.find_paths("Vessel", "Heron", "Vessel", "Kite") == [] and kb.find_paths("Vessel", "Jay", "Berth", "north", max_depth=2) == []
    sub = kb.extract_subgraph("Vessel", "Heron", max_depth=1)
    assert sub["stats"] == {"node_count": 3, "edge_count": 2, "depth_reached": 1, "truncated": False} and sub["center_node"]["hull"] == "Heron"
    assert kb.extract_subgraph("Vessel", "Heron", node_limit=2)["stats"]["truncated"]


def test_graph_search_hops(kb):
    """Contexts of two hops, by one step at a time."""
    far = kb.graph_search("green", node_type="Vessel", search_limit=2, traverse_depth=2)
    ibis = next(x for x in far if x["seed"]["node"]["hull"] == "Ibis")
    assert {name(c["node"]) for c in ibis["context"]} == {"Heron", "Jay", "north"}
    near = kb.graph_search("green", node_type="Vessel", search_limit=2, traverse_depth=0)
    assert all(x["context"] == [] for x in near)


def test_service_and_cli(kb, capsys):
    t = tools(kb)
    assert len(t) == 12 and "mermaid" in t["info"]() and json.loads(t["get_neighbors"]("Vessel", "Heron", edge_types="tows, "))["stats"]["total_count"] == 1
    assert json.loads(t["get_source_record"]("vessels", 1))["__id"] == 1 == json.loads(t["get_neighbors"](node_type="Vessel", node_id="1"))["node"]["__id"]
    assert cli.main(["version"]) == 0 and capsys.readouterr().out.strip() == cli.VERSION
    assert cli.parser().parse_args(["traverse", "A", "1", "--no-paths"]).return_paths is False


def test_protocol(kb):
    """Messages of one session: answers in order, errors with codes, none to notifications; failures don't end it."""
    ask = lambda i, method, **params: {"jsonrpc": "2.0", "id": i, "method": method, "params": params}
    sent = [
        ask(1, "initialize", protocolVersion="2024-11-05"), {"jsonrpc": "2.0", "method": "notifications/initialized"}, ask(2, "tools/list"), ask(3, "tools/call", name="fts_search", arguments={"query": "salt", "limit": 2}), ask("a", "tools/call", name="get_neighbors", arguments={"node_type": "Vessel", "node_id": "Zed"}),
        ask(5, "tools/call", name="sink"), ask(6, "tools/call", name="search", arguments={"question": "x"}), ask(7, "resources/list"), {"id": 8}, ask(9, "ping"),
    ]
    out = io.StringIO()
    mcp.serve(kb, [*map(json.dumps, sent), "{", "", "[]"], out, "1")
    got = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [g["id"] for g in got] == [1, 2, 3, "a", 5, 6, 7, None, 9, None, None]
    assert all(len(t["description"]) > 30 for t in got[1]["result"]["tools"])
    assert got[0]["result"]["protocolVersion"] == "2024-11-05" and got[0]["result"]["serverInfo"] == {"name": "loreweave", "version": "1"}
    listed = {x["name"]: x["inputSchema"] for x in got[1]["result"]["tools"]}
    assert len(listed) == 12 and listed["search"]["required"] == ["query"] and listed["search"]["properties"]["alpha"] == {"type": "number", "default": 0.5} and listed["get_neighbors"]["properties"]["node_id"]["type"] == ["integer", "string"]
    assert got[2]["result"]["isError"] is False and len(json.loads(got[2]["result"]["content"][0]["text"])) == 2
    assert got[3]["result"]["isError"] is True and "Zed" in got[3]["result"]["content"][0]["text"]
    assert [g["error"]["code"] for g in got if "error" in g] == [mcp.BAD_PARAMS, mcp.BAD_PARAMS, mcp.NO_METHOD, mcp.NO_REQUEST, mcp.UNREADABLE, mcp.NO_REQUEST]


def test_changes(spark, tmp_path):
    e = Engine(spark, tmp_path / "kb", Config.parse(KB))
    e.import_items(ITEMS)
    heron = e.nodes("Vessel").filter("hull = 'Heron'").first()
    e.import_items([vessel("Heron", tons=310), vessel("Heron", log="new"), vessel("Lark")])
    now = e.nodes("Vessel").filter("hull = 'Heron'").first()
    assert (now["__id"], now["__created_at"], now["log"], now["flags"]) == (heron["__id"], heron["__created_at"], "new", '["red", 7]') and now["__updated_at"] > heron["__updated_at"]
    before = e.snapshots.current
    with pytest.raises(ValidationError, match="tows"):
        e.import_items([vessel("Mew"), {"type": "tows", "source": {"hull": "Mew"}, "target": {"hull": "Nobody"}}])
    assert e.snapshots.current == before and e.nodes("Vessel").filter("hull = 'Mew'").isEmpty()
    e.import_items([vessel("Ibis", action="delete"), {"type": "moors", "source": {"hull": "Heron"}, "target": NORTH, "action": "delete"}])
    assert e.edges("tows").count() == 0 and e.edges("moors").count() == 0 and e.fts_search("green") == [] and e.get_neighbors("Vessel", "Heron")["neighbors"] == []
    assert e.dump_node("Vessel", str(tmp_path / "out")) == 4 and e.dump_edge("tows", str(tmp_path / "out")) == 0
    other = Engine(spark, f"file://{tmp_path}/other", Config.parse(KB))
    assert other.load_node("Vessel", f"file://{tmp_path}/out") == 4 and other.load_node("Berth", str(tmp_path / "out")) == 0
    assert {(r["hull"], r["__id"]) for r in other.nodes("Vessel").collect()} == {(r["hull"], r["__id"]) for r in e.nodes("Vessel").collect()}
    assert other.rebuild_index() > 0 and other.save_cache(f"file://{tmp_path}/cache") == e.load_cache(f"file://{tmp_path}/cache") - (e.cache().count() - other.cache().count())
    assert other.clean_cache(30) == 0 and other.load_cache(str(tmp_path / "nothing")) == 0
    e.snapshots.prune(least_age=0.0)
    assert e.nodes("Vessel").count() == 4 and len(e.snapshots._pointers()) == 2


def test_incremental_index(spark, tmp_path):
    """A change indexes and embeds its own nodes only; other entries and tables stay where they are."""
    log = tmp_path / "embedded"

    def embed(texts):
        with log.open("a") as f:
            f.writelines(f"{t[:20]}\n" for t in texts)
        return [[float(len(t)), 1.0] + [0.0] * 14 for t in texts]

    with Engine(spark, tmp_path / "kb", Config.parse(KB), embed) as e:
        e.import_items(ITEMS)
        assert len(log.read_text().splitlines()) == e.index().select("content_hash").distinct().count()
        log.write_text("")
        before, at = {r["id"]: r["content"] for r in e.index().collect()}, e.snapshots.manifest()
        result = e.import_items([vessel("Ibis", log="Ibis sails")])
        assert result["indexed"] == 2 and result["vectors"] == {"success": 1, "failed": 0} and log.read_text().splitlines() == ["Ibis sails"]
        after = {r["id"]: r["content"] for r in e.index().collect()}
        assert set(before) - set(after) == {i for i, c in before.items() if c in ("Ibis", "Ibis was painted green in spring")}
        assert all(before[i] == after[i] for i in set(before) & set(after)) and len(after) == len(before)
        now = e.snapshots.manifest()
        assert {k for k in now if now[k] != at[k]} == {"vessels", "_sys_search_index.vessels", "_sys_search_postings.vessels", "_sys_search_stats.vessels", "_sys_search_cache"}
        assert e.fts_search("green") == [] and e.fts_search("sails")[0]["content"] == "Ibis sails"
        assert e.rrf_k() == e.refresh_k() == 10
        log.write_text("")
        assert e.embed(["Ibis sails", "other", "Ibis sails"]) == [[10.0, 1.0] + [0.0] * 14, [5.0, 1.0] + [0.0] * 14, [10.0, 1.0] + [0.0] * 14] and log.read_text().splitlines() == ["other"]
        assert e.embed([]) == [] and e.embed_single("other")[0] == 5.0
        assert e.build_index("Berth") == 3 and e.rebuild_index() == len(after)
        assert e.rebuild_index_from_cache("Vessel") == 6 and e.index().filter("vector is null or fts_content is null").isEmpty()
        e.spark.createDataFrame([], e.cache().schema).write.parquet(str(tmp_path / "none"))
        e.snapshots.publish({"_sys_search_cache": spark.read.parquet(str(tmp_path / "none"))})
        e.rebuild_index_from_cache("Vessel")
        assert e.index("Vessel").filter("vector is not null or fts_content is not null").isEmpty() and e.fts_search("sails") == []
        with pytest.raises(ValueError):
            e.build_index("Raft")


def test_vectors_after_the_commit(spark, tmp_path):
    """While the provider fails, records and full-text search are there; vectors come with a later import."""
    broken = tmp_path / "broken"
    broken.touch()

    def embed(texts):
        if broken.exists():
            raise OSError("away")
        return [[1.0] * 16 for _ in texts]

    e = Engine(spark, tmp_path / "kb", Config.parse(KB), embed)
    result = e.import_items([vessel("Heron", log="salt")])
    assert result["indexed"] == 2 and result["vectors"] == {"success": 0, "failed": 2} and e.fts_search("salt")[0]["content"] == "salt" and e.index().filter("vector is not null").isEmpty()
    with pytest.raises(KnowledgeBaseError, match="away"):
        e.embed(["salt"])
    broken.unlink()
    assert e.import_items([vessel("Ibis")])["vectors"] == {"success": 3, "failed": 0} and e.index().filter("vector is null").isEmpty()


def test_files_and_catalog(spark, tmp_path):
    with Engine(spark, tmp_path / "kb", Config.parse(KB)) as e:
        e.import_items(ITEMS)
        assert e.table_exists("vessels") and not e.table_exists("nothing") and e.table_count("edge_tows") == 2
        assert e.table_columns("edge_tows")[:1] == ["__id"] and "own_berths" in e.register_views("own_") and spark.table("own_berths").count() == 1
        with pytest.raises(ValueError):
            e.table_count("nothing")
        out = str(tmp_path / "out")
        assert e.dump_node("Vessel", out, by_date=False) == 4 and not any((tmp_path / "out/nodes/vessels").glob("dt=*"))
        (tmp_path / "out/nodes/vessels/more.json").write_text('{"hull": "Lark", "log": "Lark dives"}\n{"hull": "Kite", "tons": 7, "__updated_at": "2999-01-01T00:00:00"}\n{"hull": "Heron", "tons": 7}\n')
        assert e.sync_node("Vessel", out) == {"loaded": 7, "indexed": 5 + 3, "dumped": 5}
        assert e.nodes("Vessel").filter("hull = 'Kite' and tons = 7").count() == 1 and e.nodes("Vessel").filter("hull = 'Heron' and tons = 300").count() == 1 and e.nodes("Vessel").select("__id").distinct().count() == 5
        assert e.fts_search("dives")[0]["content"] == "Lark dives"
        assert e.dump_edge("tows", out) == 2 and e.sync_edge("tows", out) == {"loaded": 2, "dumped": 2} and e.edges("tows").count() == 2 and len(e.get_neighbors("Vessel", "Ibis")["neighbors"]) == 2
        assert read_jsonl(spark, f"file://{out}/nodes/vessels", e.nodes("Vessel").schema).count() == 5 and read_jsonl(spark, f"file://{out}/nodes/rafts", e.nodes("Vessel").schema).count() == 0
    assert "own_berths" not in [t.name for t in spark.catalog.listTables()]


def test_configuration_file(spark, tmp_path):
    (tmp_path / "config.yaml").write_text(yaml.safe_dump(KB, sort_keys=False))
    (tmp_path / "user_dict.txt").write_text("salt box\n")
    e = Engine(spark, f"file://{tmp_path}")
    assert list(e.ontology.nodes) == ["Vessel", "Berth"] and e.words == ["salt"] and Engine(spark, tmp_path / "none").ontology.nodes == {}


def test_bundle_files(spark, tmp_path):
    e = Engine(spark, tmp_path / "kb", Config.parse(KB))
    (tmp_path / "a.yaml").write_text(yaml.safe_dump([{"type": "Berth", "quay": "🙂", "slot": "1", "rules": "日本語 " * 1000}, {"type": "Berth", "quay": "e", "slot": "1", "rules": ""}]))
    assert e.import_bundle(tmp_path / "a.yaml", delete=True)["status"] == "success" and not (tmp_path / "a.yaml").exists()
    assert e.index().select("source_id").distinct().count() == 1
    for file, text in (("b", "a: ["), ("c", "a: 1"), ("d", "")):
        (tmp_path / file).write_text(text)
        with pytest.raises(Exception):  # noqa: B017
            e.import_bundle(f"file://{tmp_path}/{file}")
    with pytest.raises(FileNotFoundError):
        e.import_bundle(tmp_path / "none")
    assert e.import_items([])["status"] == "success"


def test_two_engines_on_one_folder(spark, tmp_path):
    """Imports through engines that know nothing of each other are all there, and none writes over another's."""
    engines, failed = [Engine(spark, tmp_path / "kb", Config.parse(KB)) for _ in range(2)], []

    def go(i):
        try:
            engines[i % 2].import_items([{"type": "Berth", "quay": f"q{i}", "slot": "1", "rules": f"rule {i}"}])
        except Exception as x:  # noqa: BLE001
            failed.append(x)

    threads = [threading.Thread(target=go, args=(i,)) for i in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not failed and engines[0].nodes("Berth").select("__id").distinct().count() == 4 and len(engines[1].fts_search("rule")) == 4


def test_a_version_that_came_too_late(spark, tmp_path):
    e = Engine(spark, tmp_path / "kb", Config.parse(KB))
    e.import_items(ITEMS)
    with pytest.raises(ConflictError), e.snapshots.version() as late:
        late.write("berths", e.nodes("Berth").limit(0))
        e.import_items([vessel("Lark")])
    assert e.nodes("Berth").count() == 1 and not e.files.exists(late.path)


def test_readers_see_one_version(spark, tmp_path):
    e = Engine(spark, tmp_path / "kb", Config.parse(KB))
    e.import_items(ITEMS)
    with e.snapshots.pinned():
        held = e.nodes("Vessel")
        other = threading.Thread(target=lambda: e.import_items([vessel("Ibis", action="delete")]))
        other.start()
        other.join()
        assert held.count() == 4 == e.nodes("Vessel").count() and e.index("Vessel").count() == 6 and e.edges("tows").count() == 2
    assert e.nodes("Vessel").count() == 3 and e.index("Vessel").count() == 4


def test_http_embedder(spark, tmp_path, monkeypatch):
    seen = []

    class Answer(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.path, self.headers.get("Authorization"), body["model"]))
            n = len(body["input"]) - ("short" in body["input"])
            data = [{"index": i, "embedding": [len(body["input"][i]), 1]} for i in reversed(range(n))]
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps({"data": data}).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    monkeypatch.setenv("KEY_OF_TEST", "k")
    embed = HttpEmbedder(f"http://127.0.0.1:{server.server_port}/v1/", "m", "KEY_OF_TEST")
    assert embed(["a", "bcd"]) == [[1.0, 1.0], [3.0, 1.0]] and seen == [("/v1/embeddings", "Bearer k", "m")]
    with pytest.raises(ValueError):
        embed(["short"])
    server.shutdown()
    with_url = Config.parse(KB | {"embedding": {"dim": 16, "model": "m", "url": "http://127.0.0.1:1"}})
    assert Engine(spark, tmp_path, with_url).embedder == HttpEmbedder("http://127.0.0.1:1", "m")


def test_graph_against_plain_search(spark):
    """Depths, numbers of shortest paths and simple paths on a random graph with ids that types share."""
    import random

    rng = random.Random(3)
    rows = [("e", i, rng.choice("AB"), rng.randint(0, 4), rng.choice("AB"), rng.randint(0, 4)) for i in range(18)]
    edges = spark.createDataFrame(rows, "edge_type string, edge_id long, from_type string, from_id long, to_type string, to_id long")
    start = spark.createDataFrame([("A", 1)], "type string, id long")
    out, both = {}, {}
    for _, _, a, x, b, y in rows:
        out.setdefault((a, x), []).append((b, y))
        both.setdefault((a, x), []).append((b, y))
        both.setdefault((b, y), []).append((a, x))
    depth, ways, level = {("A", 1): 0}, {("A", 1): 1}, [("A", 1)]
    for d in range(1, 4):
        nxt = {}
        for n in level:
            for m in out.get(n, []):
                if m not in depth:
                    nxt[m] = nxt.get(m, 0) + ways[n]
        depth |= dict.fromkeys(nxt, d)
        ways |= nxt
        level = list(nxt)
    got = graph.traverse_nodes(edges, start, max_depth=3).collect()
    assert {(r["type"], r["id"]): (r["min_depth"], r["paths_count"]) for r in got} == {k: (depth[k], ways[k]) for k in depth if depth[k]}
    joined = []
    real, graph.FEW = graph.FEW, 0  # the same by joins
    try:
        joined = graph.traverse_nodes(edges, start, max_depth=3).collect()
    finally:
        graph.FEW = real
    assert set(joined) == set(got)

    def walks(steps, most, goal=None):
        found = set()

        def walk(p):
            if goal is None or p[-1] == goal:
                found.add(p)
            if p[-1] != goal:
                for m in steps.get(p[-1], []):
                    if m not in p and len(p) <= most:
                        walk((*p, m))

        walk((("A", 1),))
        return {tuple(f"{t}:{i}" for t, i in p) for p in found if goal is not None or len(p) > 1}

    assert {tuple(r["nodes"]) for r in graph.paths(edges, start, max_depth=3).collect()} == walks(out, 3)
    for goal in (("B", 2), ("A", 1), ("A", 4), ("B", 9)):
        to = spark.createDataFrame([goal], "type string, id long")
        for way, steps in (("out", out), ("both", both)):
            for most in (1, 4):
                want = walks(steps, most, goal)
                found = graph.paths(edges, start, direction=way, max_depth=most, to=to).collect()
                assert sorted(tuple(r["nodes"]) for r in found) == sorted(want) and all(r["depth"] == len(r["nodes"]) - 1 == len(r["edges"]) for r in found)
        first = graph.paths(edges, start, direction="both", max_depth=4, to=to, limit=3).collect()
        assert [tuple(r["nodes"]) for r in first] == sorted(walks(both, 4, goal), key=lambda p: (len(p), p))[:3]


def test_one_seed_reads_its_own_row_groups(kb):
    """The seed's id goes into the scans of the sorted ends; types without such edges aren't read."""
    start = kb._start("Berth", "north")
    steps = graph.neighbors(kb.links(), start, direction="in")
    assert steps.count() == 1 and steps.inputFiles() and all("_sys_links_to.edge_moors" in f for f in steps.inputFiles())
    assert f"EqualTo(to_id,{start.first()['id']})" in steps._jdf.queryExecution().executedPlan().toString()


def test_stream_upserts(spark, tmp_path):
    from loreweave.streaming.bundles import upsert_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"k": 1, "v": "a", "at": 1}\n{"k": 1, "v": "b", "at": 2}\n{"k": 2, "v": "c", "at": 1}\n')
    schema = "__id long, __created_at timestamp_ntz, __updated_at timestamp_ntz, k long, v string"
    state = {"df": spark.createDataFrame([], schema)}
    q = upsert_stream(spark.readStream.schema("k long, v string, at long").json(str(tmp_path / "in")), lambda: state["df"], lambda df: state.update(df=spark.createDataFrame(df.collect(), schema)), ["k"], order="at", checkpoint=str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert {(r["k"], r["v"]) for r in state["df"].collect()} == {(1, "b"), (2, "c")}
    assert merge.last_wins(state["df"], ["v"], [F.col("k")]).count() == 2
    assert INDEX_SCHEMA.names[0] == "id"
