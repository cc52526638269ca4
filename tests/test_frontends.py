"""JSON lines, HTTP and the command line over one store."""

import io
import json
import threading
import urllib.error
import urllib.request

import pytest

from brooklet.frontends import cli, http, rpc
from brooklet.plans.store import Store
from brooklet.service import Service, schemas


@pytest.fixture
def service(spark, tmp_path):
    return Service(Store(spark, str(tmp_path / "log")), now=lambda: 1000.0)


def called(service, tool, **arguments):
    answer = rpc.handle(service, {"id": 7, "method": "tools/call", "params": {"name": tool, "arguments": arguments}})
    assert answer["id"] == 7 and answer["jsonrpc"] == "2.0"
    return answer["result"]["content"][0]["text"], answer["result"].get("isError", False)


def test_json_lines(service):
    assert rpc.handle(service, {"id": 1, "method": "initialize"})["result"]["capabilities"] == {"tools": {}}
    assert rpc.handle(service, {"method": "notifications/initialized"}) is None
    tools = rpc.handle(service, {"id": 2, "method": "tools/list"})["result"]["tools"]
    assert len(tools) == 16 and all(set(t["inputSchema"]["required"]) <= set(t["inputSchema"]["properties"]) for t in tools) and tools == schemas()
    assert rpc.handle(service, {"id": 3, "method": "nope"})["error"]["code"] == -32601 and rpc.handle(service, {"id": 4, "method": "tools/call", "params": {"name": "nope"}})["error"]["code"] == -32602
    first = json.loads(called(service, "remember", content="Ask @ops about port 8080", tier="core")[0])
    assert first["id"] == 1 and json.loads(called(service, "remember", content="Ask @ops about port 8080")[0])["deduplicated"]
    found, failed = called(service, "recall", query="ops port")
    assert not failed and json.loads(found)[0]["id"] == 1 and service.store.memories().first()["access_count"] == 1
    assert json.loads(called(service, "related", entity="@OPS")[0])[0]["entity_name"] == "@ops"
    assert json.loads(called(service, "entities", entity_type="mention")[0])[0]["memory_count"] == 1
    text, failed = called(service, "forget", memory_id=99)
    assert failed and "Hint" in text
    assert called(service, "remember", content="x", tier="nope")[1] and called(service, "recall")[1] and called(service, "recall", query="x", nope=1)[1] and called(service, "forget", memory_id="one")[1]
    said = json.loads(called(service, "process_conversation", messages=[{"role": "user", "content": "We decided to use Postgres now."}, {"role": "user"}, "odd"])[0])
    assert said["extracted"] == 1 and said["memories"] == [2]
    assert json.loads(called(service, "update_memory", old_id=1, new_content="Ask @ops about port 9090")[0]) == {"id": 3, "supersedes": 1}
    assert [r["id"] for r in json.loads(called(service, "history", memory_id=1)[0])] == [3, 1]
    assert called(service, "add_procedure", rule="Always test")[1] is False and called(service, "get_procedures")[0].endswith("- Always test")
    assert json.loads(called(service, "stats")[0])["total"] == 3 and json.loads(called(service, "compact", dry_run=True)[0])["dry_run"]
    assert json.loads(called(service, "save_state", state="at work")[0])["saved"] and len(json.loads(called(service, "today")[0])) == 4
    assert json.loads(called(service, "unarchive", memory_id=1)[0])["unarchived"] and "details" in json.loads(called(service, "consolidate", dry_run=True)[0])


def test_lines(service):
    sink = io.StringIO()
    rpc.serve(service, io.StringIO('{"id": 1, "method": "initialize"}\n\nnot json\n[]\n{"method": "notifications/x"}\n'), sink)
    answers = [json.loads(x) for x in sink.getvalue().splitlines()]
    assert [a.get("error", {}).get("code") for a in answers] == [None, -32700, -32600]


def test_http(service):
    server = http.server(service)
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def ask(path, body=None, method=None):
        data = None if body is None else body if isinstance(body, bytes) else json.dumps(body).encode()
        request = urllib.request.Request(f"http://127.0.0.1:{server.server_port}{path}", data=data, method=method)
        try:
            with urllib.request.urlopen(request) as answer:
                return answer.status, json.loads(answer.read() or b"null"), answer.headers
        except urllib.error.HTTPError as e:
            return e.code, json.loads(e.read()), e.headers

    try:
        assert ask("/remember", {"content": "A zebra lives here"})[:2] == (201, {"id": 1, "tier": "learned", "embedded": True, "deduplicated": False})
        status, found, headers = ask("/recall?query=zebra&limit=1&current_only=false")
        assert status == 200 and found[0]["id"] == 1 and headers["Access-Control-Allow-Origin"] == "*"
        assert ask("/health")[1]["memories"] == 1 and ask("/stats")[1]["total"] == 1 and len(ask("/today")[1]) == 1 and ask("/history?memory_id=1")[1][0]["id"] == 1
        assert ask("/recall")[0] == 400 and ask("/recall?query=x&limit=no")[0] == 400 and ask("/nope")[0] == 404 and ask("/nope", {})[0] == 404 and ask("/remember")[0] == 404
        assert ask("/remember", b"{no")[0] == 400 and ask("/remember", [1])[0] == 400 and ask("/remember", {})[0] == 400 and ask("/remember", {"content": "x", "tier": "nope"})[0] == 400
        assert ask("/forget", {"memory_id": 9})[0] == 404 and ask("/forget", {"memory_id": 1})[1]["forgotten"] and ask("/unarchive", {"memory_id": 1})[1]["unarchived"]
        assert ask("/recall", method="OPTIONS")[0] == 204 and ask("/entities")[1] == [] and ask("/related?entity=x")[1] == []
    finally:
        server.shutdown()
        server.server_close()


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "a.md").write_text("## One\n\nA paragraph that is long enough to stay.")
    (tmp_path / "c.json").write_text('{"messages": [{"role": "user", "content": "TODO: buy a new ladder"}]}')

    def run(*arguments):
        code = cli.main(["--store", str(tmp_path / "log"), *map(str, arguments)], spark)
        return code, capsys.readouterr().out

    assert json.loads(run("init")[1])["total"] == 0 and json.loads(run("import", tmp_path / "a.md")[1])["imported"] == 1 and json.loads(run("import-dir", tmp_path)[1])["deduplicated"] == 1
    assert json.loads(run("search", "paragraph", "--limit", 2)[1])[0]["source"] == "a.md" and json.loads(run("process", tmp_path / "c.json")[1])["by_type"] == {"todos": 1}
    assert run("add-procedure", "Always test")[0] == 0 and "- Always test" in run("procedures")[1] and "## Learned" in run("export")[1] and json.loads(run("stats")[1])["total"] == 3
    assert run("export", "--to", tmp_path / "out")[0] == 0 and run("checkpoint")[0] == 0 and len(json.loads(run("history", 1)[1])) == 1 and json.loads(run("consolidate", "--dry-run")[1])["dry_run"]
    assert run("forget", 77)[0] == 1 and "error" in json.loads(run("import", tmp_path / "none.md")[1])
    with pytest.raises(SystemExit):
        run("nope")
