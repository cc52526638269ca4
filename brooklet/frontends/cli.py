"""The tools on the command line: python -m brooklet.frontends.cli --store PATH COMMAND ..."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path
from typing import Any

from ..plans.store import Store
from ..schema import StoreError
from ..service import REQUIRED, TOOLS, Service, plain
from ..sources import files
from . import http, rpc

#: Command -> tool, where they differ.
COMMANDS = {"search": "recall", "procedures": "get_procedures", "add-procedure": "add_procedure"}
OWN = {"init": "makes an empty store", "import": "imports a markdown file", "import-dir": "imports every markdown file below a folder", "export": "writes the store as markdown", "process": "stores what a JSON file of a conversation says", "checkpoint": "rewrites the log as one base", "serve": "JSON-RPC over lines", "serve-http": "HTTP"}
_KINDS = {"integer": int, "number": float}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="brooklet", description="A store of texts.")
    top.add_argument("--store", default="memory.log", help="folder of the store")
    top.add_argument("--backend", default="hash", choices=["auto", "hash", "static", "null"])
    top.add_argument("--model", help="folder of a static model")
    commands = top.add_subparsers(dest="command", required=True)
    for tool, (text, arguments, _) in TOOLS.items():
        if tool == "process_conversation":
            continue
        command = next((c for c, t in COMMANDS.items() if t == tool), tool)
        own = commands.add_parser(command, help=text)
        for a in arguments:
            if a.default is REQUIRED:
                own.add_argument(a.name, type=_KINDS.get(a.kind, str), help=a.text)
            elif a.kind == "boolean":
                own.add_argument(f"--{a.name.replace('_', '-')}", action=argparse.BooleanOptionalAction, default=a.default, help=a.text)
            else:
                own.add_argument(f"--{a.name.replace('_', '-')}", type=_KINDS.get(a.kind, str), nargs="*" if a.kind == "array" else None, default=a.default, help=a.text)
    for command, text in OWN.items():
        own = commands.add_parser(command, help=text)
        if command in ("import", "import-dir", "process"):
            own.add_argument("path")
            own.add_argument("-n", "--namespace", default="")
        if command in ("import", "import-dir"):
            own.add_argument("--tier", default="learned")
        if command == "process":
            own.add_argument("--source", default="conversation")
        if command == "export":
            own.add_argument("--tier")
            own.add_argument("--to", help="folder to write to; else the text is printed")
        if command == "serve-http":
            own.add_argument("--port", type=int, default=8422)
    return top


def run(store: Store, service: Service, given: argparse.Namespace) -> Any:
    command, tool = given.command, COMMANDS.get(given.command, given.command)
    if tool in TOOLS:
        return service.call(tool, {a.name: v for a in TOOLS[tool][1] if (v := getattr(given, a.name)) is not None})
    if command == "init":
        return service.call("stats", {})
    if command in ("import", "import-dir"):
        return plain(store.import_markdown(given.path, service.now(), given.tier, given.namespace))
    if command == "process":
        data = json.loads(Path(given.path).read_text())
        return service.call("process_conversation", {"messages": data if isinstance(data, list) else data.get("messages", []), "namespace": given.namespace, "source": given.source})
    if command == "export":
        blocks = store.export_markdown(given.tier)
        if given.to:
            files.write_markdown(blocks, given.to)
            return {"written": given.to}
        return "\n".join(r.text for r in blocks.select("text").toLocalIterator())
    if command == "checkpoint":
        return store.compacted() or {"checkpoint": True}
    if command == "serve":
        return rpc.serve(service)
    serving = http.server(service, given.port)
    print(f"listening on port {serving.server_port}", file=sys.stderr)
    return serving.serve_forever()


def main(arguments: list[str] | None = None, spark=None) -> int:
    from ..functions.embedders import embedder

    given = parser().parse_args(arguments)
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("brooklet").getOrCreate()
    try:
        store = Store(spark, given.store, embed=embedder(given.backend, folder=given.model))
        out = run(store, Service(store), given)
    except (StoreError, ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    if out is not None:
        print(out if isinstance(out, str) else json.dumps(out, ensure_ascii=False, indent=2, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
