"""The tools over HTTP: reads by GET, changes by POST with a JSON body."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any
from urllib.parse import parse_qsl, urlsplit

from ..schema import NotFoundError, StoreError
from ..service import Service, hint

#: Addresses are names of tools.
READS = ("recall", "today", "stats", "related", "entities", "history")
CHANGES = ("remember", "save_state", "forget", "compact", "consolidate", "update_memory", "unarchive")
MOST_BODY_BYTES = 10 << 20


class Handler(BaseHTTPRequestHandler):
    """Each server has a class of its own with its service; requests run in threads, Spark's sessions are safe for that."""

    service: Service
    origin = "*"

    def log_message(self, *_) -> None:
        """Quiet."""

    def _answer(self, value: Any, status: int = 200) -> None:
        body = b"" if value is None else json.dumps(value, ensure_ascii=False, default=str).encode()
        self.send_response(status)
        for name, text in (("Access-Control-Allow-Origin", self.origin), ("Access-Control-Allow-Methods", "GET, POST, OPTIONS"), ("Access-Control-Allow-Headers", "Content-Type, Authorization")):
            self.send_header(name, text)
        if value is not None:
            self.send_header("Content-Type", "application/json; charset=utf-8")
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def _call(self, tools: tuple[str, ...], given: dict) -> None:
        tool = urlsplit(self.path).path.strip("/")
        try:
            if tool == "health" and tools is READS:
                stats = self.service.call("stats", {})
                self._answer({"status": "ok", "memories": stats["total"], "stored": stats["stored_size"]})
            elif tool in tools:
                self._answer(self.service.call(tool, given), 201 if tool == "remember" else 200)
            else:
                self._answer({"error": f"not found: /{tool}", "hint": "/" + ", /".join(("health", *tools) if tools is READS else tools)}, 404)
        except NotFoundError as e:
            self._answer({"error": str(e), "hint": hint(e)}, 404)
        except (ValueError, StoreError) as e:
            self._answer({"error": str(e)} | ({"hint": more} if (more := hint(e)) else {}), 400)
        except Exception as e:  # the client is told what failed, not how
            self._answer({"error": f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"}, 500)

    def do_OPTIONS(self) -> None:
        self._answer(None, 204)

    def do_GET(self) -> None:
        self._call(READS, dict(parse_qsl(urlsplit(self.path).query)))

    def do_POST(self) -> None:
        try:
            size = int(self.headers.get("Content-Length") or 0)
            if size > MOST_BODY_BYTES:
                self.close_connection = True
                self._answer({"error": f"a body has {MOST_BODY_BYTES} bytes at most"}, 400)
                return
            given = json.loads(self.rfile.read(size) or b"{}")
            if not isinstance(given, dict):
                raise ValueError("a body is an object")
        except ValueError as e:
            self._answer({"error": f"invalid JSON body: {e}"}, 400)
            return
        self._call(CHANGES, given)


def server(service: Service, port: int = 0, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """A server that serve_forever() starts; port 0: any that is free."""
    return ThreadingHTTPServer((host, port), type("Handler", (Handler,), {"service": service}))
