"""JSON-RPC 2.0 over lines: initialize, tools/list, tools/call."""

from __future__ import annotations

import json
import sys
from typing import Any, TextIO

from ..service import TOOLS, Service, hint, schemas

#: Codes of JSON-RPC, and the protocol's version.
PARSE_ERROR, BAD_REQUEST, NO_METHOD, BAD_PARAMETERS = -32700, -32600, -32601, -32602
PROTOCOL = "2024-11-05"
#: Letters of a text that an answer shows.
SHOWN = 500


def _shown(value: Any) -> Any:
    if isinstance(value, str):
        return value if len(value) <= SHOWN else value[:SHOWN] + "..."
    if isinstance(value, list):
        return [_shown(v) for v in value]
    return {k: _shown(v) for k, v in value.items()} if isinstance(value, dict) else value


def handle(service: Service, request: Any) -> dict | None:
    """The answer to a request; None to a notification."""
    if not isinstance(request, dict):
        return {"jsonrpc": "2.0", "id": None, "error": {"code": BAD_REQUEST, "message": "a request is an object"}}
    answer = lambda **x: {"jsonrpc": "2.0", "id": request.get("id"), **x}
    method, params = request.get("method", ""), request.get("params") or {}
    if method.startswith("notifications/"):
        return None
    if method == "initialize":
        return answer(result={"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "brooklet", "version": "0.2.0"}})
    if method == "tools/list":
        return answer(result={"tools": schemas()})
    if method != "tools/call":
        return answer(error={"code": NO_METHOD, "message": f"unknown method: {method}"})
    tool = params.get("name", "")
    if tool not in TOOLS:
        return answer(error={"code": BAD_PARAMETERS, "message": f"unknown tool: {tool}"})
    said = lambda text, **x: answer(result={"content": [{"type": "text", "text": text}], **x})
    try:
        result = service.call(tool, params.get("arguments") or {})
    except Exception as e:  # the caller is told of any failure
        more = hint(e)
        return said(f"Error: {e}" + (f"\nHint: {more}" if more else ""), isError=True)
    return said(result if isinstance(result, str) else json.dumps(_shown(result), ensure_ascii=False, indent=2, default=str))


def serve(service: Service, source: TextIO = sys.stdin, sink: TextIO = sys.stdout) -> None:
    """Answers each line until the end of the source."""
    for line in source:
        if not line.strip():
            continue
        try:
            out = handle(service, json.loads(line))
        except json.JSONDecodeError as e:
            out = {"jsonrpc": "2.0", "id": None, "error": {"code": PARSE_ERROR, "message": str(e)}}
        if out is not None:
            sink.write(json.dumps(out, ensure_ascii=False, default=str) + "\n")
            sink.flush()
