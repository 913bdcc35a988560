"""The tools of a loaded session over a line protocol: one JSON request and one JSON answer a line.

Methods are ``initialize``, ``ping``, ``tools/list`` and ``tools/call``; a
request without an id is a notice and gets no answer.  An error of one request
never ends the session.
"""

from __future__ import annotations

import inspect
import json
from typing import TextIO

from pyspark.sql import DataFrame

from semgraph.tools import Session

VERSION = "2024-11-05"
# The error codes of the protocol.
PARSE_ERROR, INVALID_REQUEST, METHOD_NOT_FOUND, INVALID_PARAMS, INTERNAL_ERROR = -32700, -32600, -32601, -32602, -32603
#: rows of an answer at most; the rest is told by ``truncated``
MAX_ROWS = 1_000


def tool_names() -> list[str]:
    return sorted(n for n, f in inspect.getmembers(Session, inspect.isfunction) if not n.startswith("_") and n not in ("reload", "envelope"))


def _plain(value, limit: int):
    """An answer as JSON values; tables become lists of rows."""
    if isinstance(value, DataFrame):
        rows = value.limit(limit + 1).collect()
        return {"rows": [r.asDict(recursive=True) for r in rows[:limit]], "truncated": len(rows) > limit}
    if isinstance(value, dict):
        return {k: _plain(v, limit) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [_plain(v, limit) for v in value]
    return value


class Server:
    def __init__(self, session: Session, max_rows: int = MAX_ROWS):
        self.session, self.max_rows = session, max_rows

    def answer(self, request: dict) -> dict | None:
        """The answer to one request, none to a notice."""
        id_ = request.get("id")
        if not isinstance(request.get("method"), str):
            return _error(id_, INVALID_REQUEST, "a request has a method")
        if "id" not in request:
            return None
        method, params = request["method"], request.get("params") or {}
        if method == "initialize":
            return _result(id_, {"protocolVersion": VERSION, "serverInfo": {"name": "semgraph"}, "capabilities": {"tools": {}}})
        if method == "ping":
            return _result(id_, {})
        if method == "tools/list":
            return _result(id_, {"tools": [{"name": n, "description": (getattr(Session, n).__doc__ or "").strip(), "arguments": [p for p in inspect.signature(getattr(Session, n)).parameters if p != "self"]} for n in tool_names()]})
        if method != "tools/call":
            return _error(id_, METHOD_NOT_FOUND, f"no method {method}")
        name = params.get("name")
        if name not in tool_names():
            return _error(id_, INVALID_PARAMS, f"no tool {name}")
        args = params.get("arguments") or {}
        try:
            inspect.signature(getattr(self.session, name)).bind(**args)
        except TypeError as e:
            return _error(id_, INVALID_PARAMS, str(e))
        try:
            told = _plain(getattr(self.session, name)(**args), self.max_rows)
        except Exception as e:
            return _error(id_, INTERNAL_ERROR, f"{type(e).__name__}: {e}"[:2_000])
        env = self.session.envelope(name)
        return _result(id_, {"content": told, "envelope": {"tier": env.tier, "band": env.band, "limitations": env.limitations, "stale": env.stale, "generation": env.generation}})

    def run(self, lines: TextIO, out: TextIO) -> None:
        """Answers line by line until the input ends; blank lines are skipped."""
        for line in lines:
            if not line.strip():
                continue
            try:
                request = json.loads(line)
                reply = self.answer(request) if isinstance(request, dict) else _error(None, INVALID_REQUEST, "a request is an object")
            except ValueError:
                reply = _error(None, PARSE_ERROR, "no JSON")
            if reply is not None:
                out.write(json.dumps(reply, default=str) + "\n")
                out.flush()


def _result(id_, result: dict) -> dict:
    return {"jsonrpc": "2.0", "id": id_, "result": result}


def _error(id_, code: int, message: str) -> dict:
    return {"jsonrpc": "2.0", "id": id_, "error": {"code": code, "message": message}}
