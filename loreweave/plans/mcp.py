"""The service's tools over the Model Context Protocol: JSON-RPC 2.0, one message a line, on standard streams."""

from __future__ import annotations

import inspect
import json
from collections.abc import Callable, Iterable
from typing import Any, TextIO

from loreweave.plans.engine import Engine
from loreweave.plans.service import tools

#: Protocol versions, newest first, JSON types by annotation, and error codes of JSON-RPC.
VERSIONS = ("2025-06-18", "2025-03-26", "2024-11-05")
_JSON = {"int": "integer", "float": "number", "bool": "boolean"}
UNREADABLE, NO_REQUEST, NO_METHOD, BAD_PARAMS = -32700, -32600, -32601, -32602


class _Refused(Exception):
    """A request that isn't carried out: an error code and why."""

    def __init__(self, code: int, why: str) -> None:
        super().__init__(why)
        self.code = code


def described(name: str, call: Callable[..., str]) -> dict[str, Any]:
    """A tool as the protocol lists it; lists of names are given as text with commas."""
    properties, required = {}, []
    for p in inspect.signature(call).parameters.values():
        kinds = sorted({_JSON.get(k.strip(), "string") for k in str(p.annotation).split("|") if k.strip() != "None"})
        properties[p.name] = {"type": kinds[0] if len(kinds) == 1 else kinds}
        if p.default is p.empty:
            required.append(p.name)
        elif p.default is not None:
            properties[p.name]["default"] = p.default
    return {"name": name, "description": inspect.getdoc(call) or name.replace("_", " "), "inputSchema": {"type": "object", "properties": properties, "required": required, "additionalProperties": False}}


def _result(calls: dict[str, Callable[..., str]], method: str, params: dict[str, Any], version: str) -> dict[str, Any]:
    if method == "initialize":
        asked = params.get("protocolVersion")
        return {"protocolVersion": asked if asked in VERSIONS else VERSIONS[0], "capabilities": {"tools": {}}, "serverInfo": {"name": "loreweave", "version": version}}
    if method == "ping":
        return {}
    if method == "tools/list":
        return {"tools": [described(k, f) for k, f in calls.items()]}
    if method != "tools/call":
        raise _Refused(NO_METHOD, f"Unknown method {method!r}")
    if (call := calls.get(params.get("name", ""))) is None:
        raise _Refused(BAD_PARAMS, f"Unknown tool {params.get('name')!r}")
    given = params.get("arguments") or {}
    try:
        inspect.signature(call).bind(**given)
    except TypeError as e:
        raise _Refused(BAD_PARAMS, str(e)) from e
    try:
        text, failed = call(**given), False
    except Exception as e:  # noqa: BLE001  whatever a tool raises is its answer
        text, failed = f"{type(e).__name__}: {e}", True
    return {"content": [{"type": "text", "text": text}], "isError": failed}


def reply(calls: dict[str, Callable[..., str]], line: str, version: str = "0") -> dict[str, Any] | None:
    """The answer to one message; None to a notification."""
    ident = None
    try:
        try:
            message = json.loads(line)
        except ValueError as e:
            raise _Refused(UNREADABLE, str(e)) from e
        if not isinstance(message, dict) or message.get("jsonrpc") != "2.0" or not isinstance(message.get("method"), str):
            raise _Refused(NO_REQUEST, "Not a request of JSON-RPC 2.0")
        if "id" not in message:
            return None
        ident = message["id"]
        params = message.get("params") or {}
        if not isinstance(params, dict):
            raise _Refused(BAD_PARAMS, "params must be an object")
        return {"jsonrpc": "2.0", "id": ident, "result": _result(calls, message["method"], params, version)}
    except _Refused as e:
        return {"jsonrpc": "2.0", "id": ident, "error": {"code": e.code, "message": str(e)}}


def serve(engine: Engine, source: Iterable[str], sink: TextIO, version: str = "0") -> None:
    """Answers message by message until the source ends; one that fails doesn't end it."""
    calls = tools(engine)
    for line in source:
        if line.strip() and (answer := reply(calls, line, version)) is not None:
            sink.write(json.dumps(answer, ensure_ascii=False) + "\n")
            sink.flush()
