"""Tool server: JSON-RPC 2.0 over a byte stream, a message a line or behind a Content-Length header."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import BinaryIO

from quillspark.engine import Engine

MOST_REQUEST, MOST_ANSWER, MOST_RESOURCE, BUDGET = 8 << 20, 3800, 65_536, 900
_NAME = ["note", "target", "path"]
#: Per tool: arguments as name -> (other names, type, default), a default of ... for required ones.
TOOLS: dict[str, dict[str, tuple]] = {
    "search": {"query": ([], str, ...), "domain": ([], str, None), "limit": ([], int, 5), "with_graph": ([], bool, False), "mode": ([], str, "hybrid")},
    "read": {"note": (["path", "target"], str, ...), "section": ([], str, None), "toc": ([], bool, False), "budget": ([], int, BUDGET)},
    "contract": {"note": (["target", "path"], str, ...)},
    "blast": {"target": (["note", "path"], str, ...)},
    "map": {"target": (["note", "path"], str, ...), "depth": ([], int, 2), "direction": ([], str, "both")},
    "services": {},
    "projects": {},
    "record_log": {"summary": ([], str, ...), "project": ([], str, ""), "device": ([], str, None)},
    "write_note": {"path": ([], str, ...), "content": ([], str, ...), "overwrite": ([], bool, False), "raw": ([], bool, False)},
    "verify": {},
    "lint": {},
    "test": {"note": (["target"], str, None), "dry_run": ([], bool, False)},
    "get": {"key": (["keypath"], str, ...)},
    "query": {"sql": ([], str, ...)},
    "set": {"note": ([], str, ...), "key": ([], str, ...), "value": ([], object, ...)},
    "replace_section": {"note": ([], str, ...), "heading": ([], str, ...), "content": ([], str, ...)},
    "append_section": {"note": ([], str, ...), "heading": ([], str, ...), "content": ([], str, ...)},
    "daily": {"date": ([], str, None)},
    "reconcile": {"dry_run": ([], bool, False)},
    "list_notes": {"domain": ([], str, None), "limit": ([], int, None)},
}
RESOURCES = ["services", "projects", "notes", "lint", "verify", "daily"]
_MAY_BE_BLANK = {"content", "value"}


class RpcError(Exception):
    def __init__(self, code: int, message: str):
        super().__init__(message)
        self.code = code


def messages(stream: BinaryIO) -> Iterator[bytes | RpcError]:
    while line := stream.readline(MOST_REQUEST + 1):
        if line.lower().startswith(b"content-length:"):
            try:
                n = int(line.split(b":", 1)[1])
            except ValueError:
                yield RpcError(-32700, "Content-Length is no number")
                continue
            while (head := stream.readline(MOST_REQUEST)).strip():
                pass
            if not 0 <= n <= MOST_REQUEST:
                for _ in range(max(0, n) // MOST_REQUEST + 1):
                    stream.read(min(MOST_REQUEST, max(0, n)))
                yield RpcError(-32600, "request too large")
                continue
            yield stream.read(n)
        elif len(line) > MOST_REQUEST:
            while line and not line.endswith(b"\n"):
                line = stream.readline(MOST_REQUEST)
            yield RpcError(-32600, "request too large")
        elif line.strip():
            yield line


def typed(value, kind: type, name: str):
    """Booleans and numbers also as their text."""
    if kind is object or value is None or type(value) is kind:
        return value
    if kind is bool and str(value).lower() in ("true", "1", "false", "0"):
        return str(value).lower() in ("true", "1")
    if kind is int and not isinstance(value, bool):
        try:
            return int(value)
        except (TypeError, ValueError):
            pass
    raise RpcError(-32602, f"argument '{name}' must be {kind.__name__}")


def arguments(tool: str, given: dict) -> dict:
    out = {}
    for name, (others, kind, default) in TOOLS[tool].items():
        found = next((given[n] for n in (name, *others) if n in given and (name in _MAY_BE_BLANK or given[n] is not None and str(given[n]).strip())), ...)
        if found is ... and default is ...:
            raise RpcError(-32602, f"argument '{name}' is required")
        out[name] = typed(default if found is ... else found, kind, name)
    return out


def cut(text: str, most: int) -> str:
    """At most so many bytes of UTF-8; a cut is announced."""
    raw = text.encode()
    return text if len(raw) <= most else raw[: most - 40].decode("utf-8", "ignore") + "\n[cut to the response limit]"


def call(e: Engine, tool: str, given: dict) -> tuple[str, bool]:
    """(text, failed)"""
    a = arguments(tool, given)
    as_json = lambda x: json.dumps(x, ensure_ascii=False, default=str)
    match tool:
        case "search":
            hits, notice = e.search(**a)
            return e.compact(hits) + (f"\n\n{notice}" if notice else ""), False
        case "read":
            return e.read(a["note"], a["section"], a["toc"], a["budget"]), False
        case "daily":
            return e.daily(a["date"])[0], False
        case "record_log":
            return e.log(a["project"], a["summary"], a["device"]), False
        case "write_note":
            return f"wrote {e.write(**a)}", False
        case "set":
            e.set(**a)
            return f"set {a['key']} in {a['note']}", False
        case "replace_section" | "append_section":
            getattr(e, tool.split("_")[0])(**a)
            return f"{tool.split('_')[0]} {a['note']} #{a['heading']}", False
        case "verify" | "lint":
            found = getattr(e, tool)()
            return as_json(found), not found["passed"]
        case "test":
            found = e.test(**a)
            return cut(as_json(found), MOST_ANSWER), found["failed"] > 0
        case "get":
            return as_json({"keypath": a["key"], "value": e.get(a["key"])}), False
        case "query":
            got = e.query_result(a["sql"])
            said = f"only the first {len(got['rows'])} rows\n" if got["truncated"] else ""
            return cut(said + as_json(got["rows"]), MOST_ANSWER), False
        case "list_notes":
            return cut(as_json(e.notes(**a)), MOST_ANSWER), False
    return as_json(getattr(e, tool)(**a)), False


def resource(e: Engine, uri: str) -> str:
    kind, _, name = uri.removeprefix("quillspark://").partition("/")
    if kind == "note" and name:
        return cut(e.read(name), MOST_RESOURCE)
    if name or kind not in RESOURCES:
        raise RpcError(-32602, f"unknown resource '{uri}'")
    got = getattr(e, kind)()
    return cut(got[0] if kind == "daily" else json.dumps(got, ensure_ascii=False, default=str), MOST_RESOURCE)


def schema(tool: str) -> dict:
    names = {str: "string", int: "integer", bool: "boolean"}
    fields = {n: ({"type": names[k]} if k in names else {}) for n, (_, k, _) in TOOLS[tool].items()}
    return {"name": tool, "inputSchema": {"type": "object", "properties": fields, "required": [n for n, (_, _, d) in TOOLS[tool].items() if d is ...]}}


def answer(e: Engine, method: str, params: dict):
    match method:
        case "initialize":
            return {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}, "resources": {}}, "serverInfo": {"name": "quillspark", "version": "1"}}
        case "ping":
            return {}
        case "tools/list":
            return {"tools": [schema(t) for t in TOOLS]}
        case "tools/call":
            name, given = params.get("name"), params.get("arguments") or {}
            if name not in TOOLS or not isinstance(given, dict):
                raise RpcError(-32602, f"unknown tool '{name}'")
            try:
                text, failed = call(e, name, given)
            except (ValueError, OSError) as err:
                text, failed = f"error: {err}", True
            return {"content": [{"type": "text", "text": text}], "isError": failed}
        case "resources/list":
            return {"resources": [{"uri": f"quillspark://{r}", "name": r} for r in RESOURCES]}
        case "resources/templates/list":
            return {"resourceTemplates": [{"uriTemplate": "quillspark://note/{name}", "name": "note"}]}
        case "resources/read":
            uri = params.get("uri")
            if not isinstance(uri, str):
                raise RpcError(-32602, "uri is required")
            return {"contents": [{"uri": uri, "text": resource(e, uri)}]}
    raise RpcError(-32601, f"unknown method '{method}'")


def handle(e: Engine, raw: bytes | RpcError) -> dict | None:
    """The answer to one message; none to a notification. No error ends the server."""
    ident = None
    try:
        if isinstance(raw, RpcError):
            raise raw
        try:
            m = json.loads(raw)
        except ValueError:
            raise RpcError(-32700, "not JSON") from None
        if not isinstance(m, dict) or m.get("jsonrpc") != "2.0" or not isinstance(m.get("method"), str) or not isinstance(m.get("params", {}), (dict, type(None))):
            ident = m.get("id") if isinstance(m, dict) else None
            raise RpcError(-32600, "not a request")
        if "id" not in m:
            return None
        ident = m["id"]
        return {"jsonrpc": "2.0", "id": ident, "result": answer(e, m["method"], m.get("params") or {})}
    except RpcError as err:
        return {"jsonrpc": "2.0", "id": ident, "error": {"code": err.code, "message": str(err)}}
    except Exception as err:
        return {"jsonrpc": "2.0", "id": ident, "error": {"code": -32603, "message": f"{type(err).__name__}: {err}"}}


def serve(e: Engine, source: BinaryIO, sink: BinaryIO) -> None:
    for raw in messages(source):
        if (out := handle(e, raw)) is not None:
            sink.write(json.dumps(out, ensure_ascii=False, default=str).encode() + b"\n")
            sink.flush()
