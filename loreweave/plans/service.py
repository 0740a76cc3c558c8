"""The twelve tools of the service as functions from plain arguments to JSON text."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import wraps
from typing import Any

from loreweave.plans.engine import Engine


def edge_types(text: str | None) -> list[str] | None:
    """Comma-separated names; None if there are none."""
    return [x for x in (p.strip() for p in (text or "").split(",")) if x] or None


def node_id(text: str | int) -> int | str:
    """A number if it can be read as one, else an identity."""
    try:
        return int(text)
    except ValueError:
        return text


def to_json(value: Any) -> str:
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, default=str)


def tools(engine: Engine) -> dict[str, Callable[..., str]]:
    def told(f: Callable[..., Any]) -> Callable[..., str]:
        @wraps(f)
        def call(*args: Any, **kw: Any) -> str:
            if isinstance(kw.get("edge_types"), str):
                kw["edge_types"] = edge_types(kw["edge_types"])
            kw |= {k: node_id(kw[k]) for k in ("node_id", "from_id", "to_id") if isinstance(kw.get(k), str)}
            return to_json(f(*args, **kw))

        return call

    return {
        "info": told(engine.get_info), "import": told(engine.import_bundle), "search": told(engine.search), "vector_search": told(engine.vector_search), "fts_search": told(engine.fts_search), "get_source_record": told(engine.get_source_record),
        "query_raw_sql": told(engine.query_raw_sql), "get_neighbors": told(engine.get_neighbors), "graph_search": told(engine.graph_search), "traverse": told(engine.traverse), "extract_subgraph": told(engine.extract_subgraph), "find_paths": told(engine.find_paths),
    }
