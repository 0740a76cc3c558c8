"""Ontologies, configuration, bundle schemas and validation."""

import copy

import pytest

from loreweave.errors import InvalidTableNameError, ValidationError
from loreweave.model import RRF, Config, Ontology, table_name
from loreweave.plans.service import edge_types, node_id
from loreweave.validate import bundle_schema, check_schema, validate_bundle, validate_json_by_schema
from tests.harbour import ITEMS, KB


def changed(*path, to):
    """The ontology of the tests with one value replaced."""
    o = copy.deepcopy(KB["ontology"])
    at = o
    for k in path[:-1]:
        at = at.setdefault(k, {})
    at[path[-1]] = to
    return o


def test_columns_follow_types_and_formats():
    c = Config.parse(KB)
    vessel = {f.name: f.dataType.simpleString() for f in c.ontology.nodes["Vessel"].struct}
    assert vessel == {"__id": "bigint", "__created_at": "timestamp_ntz", "__updated_at": "timestamp_ntz", "hull": "string", "tons": "bigint", "draught": "double", "afloat": "boolean", "log": "string", "flags": "string", "launched": "timestamp_ntz"}
    assert [f.name for f in c.ontology.edges["tows"].struct] == ["__id", "__from_id", "__to_id", "__created_at", "__updated_at", "rope"]
    assert c.ontology.edges["moors"].table == "edge_moors" and c.ontology.by_table("berths") == "Berth" and c.ontology.by_table("none") is None
    assert (c.chunk_size, c.chunk_overlap, c.embedding_dim, c.embedding_url) == (800, 100, 16, None)
    day = Ontology.parse(changed("nodes", "Vessel", "schema", "properties", "launched", to={"type": "string", "format": "date"}))
    assert day.nodes["Vessel"].columns["launched"].simpleString() == "date"


@pytest.mark.parametrize(("path", "to"), [
    (("nodes", "Vessel", "identity"), []), (("nodes", "Vessel", "table"), "7seas"), (("nodes", "Vessel", "table"), ""), (("nodes", "Vessel", "colour"), "red"), (("nodes", "Vessel", "search"), {"fuzzy": ["log"]}),
    (("nodes", "Vessel", "vectors"), {"log": {"dim": 0, "model": "m"}}), (("nodes", "Vessel", "vectors"), {"log": {"dim": 4, "model": "m", "metric": "taxicab"}}),
    (("edges", "moors", "to"), "Cloud"), (("edges", "moors", "cardinality"), "2:2"), (("edges", "moors", "weight"), 1), (("rivers",), {}),
])
def test_bad_ontologies(path, to):
    with pytest.raises(ValueError):
        Ontology.parse(changed(*path, to=to))


@pytest.mark.parametrize("bad", [{"chunk_size": 50}, {"chunk_size": 9000}, {"chunk_overlap": 800}, {"embedding": {"dim": 5000}}, {"embedding": {"dim": 0}}, {"storage": {"max_rows_per_file": 5}}, {"log_level": "LOUD"}, {"tokenizer": "spoons"}])
def test_bad_configurations(bad):
    with pytest.raises(ValueError):
        Config.parse(bad)


def test_names_and_parameters():
    assert [table_name(x) for x in ("a", "_a", "A_1", "x" * 64)] == ["a", "_a", "A_1", "x" * 64]
    for bad in ("", "1a", "a-b", "a b", "a;drop", "é", "x" * 65, "a\n"):
        with pytest.raises(InvalidTableNameError):
            table_name(bad)
    assert [edge_types(x) for x in (None, "", " , ", "tows", "tows, moors ,", ",")] == [None, None, None, ["tows"], ["tows", "moors"], None]
    assert [node_id(x) for x in ("7", "-7", 7, "Kite", "7a")] == [7, -7, 7, "Kite", "7a"]


def test_fusion_constant():
    assert [RRF().of(n) for n in (0, 10_000, 10_001, 10**5, 10**5 + 1, 10**6, 10**6 + 1, 10**9)] == [10, 10, 20, 20, 40, 40, 60, 60]
    assert RRF(auto_k=False, k=33).of(5) == 33 and Config.parse({"search": {"rrf": {"max_k": 8}}}).rrf.of(1) == 8 and Config.parse({"search": {"rrf": {"min_k": 15}}}).rrf.of(1) == 15
    assert Config.parse({"search": {"rrf": {"thresholds": [{"max_docs": 3, "k": 7}]}}}).rrf.of(3) == 7


def test_bundle_schema():
    o = Ontology.parse(KB["ontology"])
    schema = bundle_schema(o)
    kinds = {s["properties"]["type"]["const"]: s for s in schema["full_bundle_schema"]["items"]["oneOf"]}
    assert list(kinds) == ["Vessel", "Berth", "tows", "moors"] and kinds["Berth"]["required"] == ["type", "quay", "slot"] and kinds["Vessel"]["additionalProperties"] is False
    assert kinds["moors"]["properties"]["target"]["required"] == ["quay", "slot"] and kinds["tows"]["properties"]["rope"] == {"type": "string"}
    assert "- type: moors" in schema["example_yaml"]
    check_schema(schema["full_bundle_schema"])


@pytest.mark.parametrize("bad", [
    {}, None, [7], [None], [{"type": "Raft", "hull": "A"}], [{"hull": "A"}], [{"type": "Vessel"}], [{"type": "Vessel", "hull": 7}], [{"type": "Vessel", "hull": "A", "tons": "x"}], [{"type": "Vessel", "hull": "A", "tons": True}], [{"type": "Vessel", "hull": "A", "tons": 1.5}],
    [{"type": "Vessel", "hull": "A", "sails": 3}], [{"type": "Vessel", "hull": "A", "action": "sink"}], [{"type": "Berth", "quay": "north"}], [{"type": "tows", "source": {"hull": "A"}}], [{"type": "moors", "source": {"hull": "A"}, "target": {"quay": "north"}}], [*ITEMS, {"type": "Vessel"}],
])
def test_bad_bundles(bad):
    with pytest.raises(ValidationError):
        validate_bundle(Ontology.parse(KB["ontology"]), bad)


def test_good_bundles():
    assert validate_bundle(Ontology.parse(KB["ontology"]), ITEMS) is ITEMS


def test_data_by_schema():
    schema = {"type": "object", "required": ["times"], "properties": {"times": {"type": "array", "items": {"type": "string", "format": "date-time"}}, "n": {"type": "number", "minimum": 0}, "kind": {"enum": ["a", "b"]}, "never": False}, "additionalProperties": {"type": "string", "maxLength": 3}}
    assert validate_json_by_schema(schema, {"times": ["2024-01-02T03:04:05Z"], "n": 1, "kind": "b", "more": "abc"})["times"][0].hour == 3
    for bad in ({}, {"times": ["x"]}, {"times": [], "n": "1"}, {"times": [], "n": True}, {"times": [], "n": -1}, {"times": [], "kind": "c"}, {"times": [], "more": "abcd"}, {"times": [], "never": 1}, []):
        with pytest.raises(ValidationError):
            validate_json_by_schema(schema, bad)


@pytest.mark.parametrize(("schema", "at"), [({"type": "thing"}, "#/type"), ({"properties": {"a": {"items": {"type": "knot"}}}}, "#/properties/a/items/type"), ({"required": "a"}, "#/required"), ({"properties": []}, "#/properties"), ({"oneOf": [True, 7]}, "#/oneOf/1"), (7, "#"), ({"pattern": 3}, "#/pattern")])
def test_bad_schemas(schema, at):
    with pytest.raises(ValidationError, match=f"^{at}:"):
        check_schema(schema)
