"""A knowledge base of vessels and berths for the tests."""

KB = {
    "embedding": {"dim": 16},
    "ontology": {
        "nodes": {
            "Vessel": {
                "table": "vessels",
                "identity": ["hull"],
                "schema": {"type": "object", "properties": {"hull": {"type": "string"}, "tons": {"type": "integer"}, "draught": {"type": "number"}, "afloat": {"type": "boolean"}, "log": {"type": "string"}, "flags": {"type": "array"}, "launched": {"type": "string", "format": "date-time"}}},
                "search": {"full_text": ["hull", "log"], "vectors": ["log"]},
            },
            "Berth": {
                "table": "berths",
                "identity": ["quay", "slot"],
                "schema": {"type": "object", "properties": {"quay": {"type": "string"}, "slot": {"type": "string"}, "rules": {"type": "string"}}},
                "search": {"full_text": ["rules"]},
            },
        },
        "edges": {"tows": {"from": "Vessel", "to": "Vessel", "schema": {"properties": {"rope": {"type": "string"}}}}, "moors": {"from": "Vessel", "to": "Berth", "cardinality": "N:1"}},
    },
}

NORTH = {"quay": "north", "slot": "1"}
ITEMS = [
    {"type": "Vessel", "hull": "Heron", "tons": 300, "draught": 2.5, "afloat": True, "log": "Heron carries salt and barley", "flags": ["red", 7], "launched": "1990-01-01T00:00:00Z"},
    {"type": "Vessel", "hull": "Ibis", "tons": 400, "log": "Ibis was painted green in spring"},
    {"type": "Vessel", "hull": "Jay", "tons": 500},
    {"type": "Vessel", "hull": "Kite"},
    {"type": "Berth", **NORTH, "rules": "Salt and barley are unloaded here. " * 60},
    {"type": "tows", "source": {"hull": "Heron"}, "target": {"hull": "Ibis"}, "rope": "hemp"},
    {"type": "tows", "source": {"hull": "Ibis"}, "target": {"hull": "Jay"}},
    {"type": "moors", "source": {"hull": "Heron"}, "target": NORTH},
]
