"""The query tools by name, and a server that answers JSON-RPC requests line by line."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import TextIO

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Tools:
    """Functions that give DataFrames, with a description and the names of their arguments."""

    def __init__(self) -> None:
        self.known: dict[str, tuple[Callable[..., DataFrame], str, tuple[str, ...]]] = {}

    def register(self, name: str, tool: Callable[..., DataFrame], description: str, arguments: tuple[str, ...]) -> None:
        if name in self.known:
            raise ValueError(f"there is a tool {name!r} already")
        self.known[name] = tool, description, arguments

    def call(self, name: str, arguments: dict) -> list[dict]:
        """The rows of a tool's answer, which a caller reads whole."""
        if name not in self.known:
            raise ValueError(f"unknown tool {name!r}; there are: {', '.join(sorted(self.known))}")
        tool, _, names = self.known[name]
        wrong = set(arguments) - set(names)
        if wrong:
            raise ValueError(f"{name} has no argument {', '.join(sorted(wrong))}")
        return [json.loads(x[0]) for x in tool(**arguments).select(F.to_json(F.struct("*"))).collect()]

    def answer(self, request: dict) -> dict | None:
        """The response to one request; a notification has none."""
        if "id" not in request:
            return None
        out = {"jsonrpc": "2.0", "id": request["id"]}
        params = request.get("params") or {}
        try:
            if request.get("method") == "tools/list":
                listed = [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": {a: {} for a in names}}} for n, (_, d, names) in sorted(self.known.items())]
                return out | {"result": {"tools": listed}}
            if request.get("method") == "tools/call":
                return out | {"result": {"content": self.call(params.get("name", ""), params.get("arguments") or {}), "isError": False}}
            if request.get("method") == "initialize":
                return out | {"result": {"serverInfo": {"name": "quarry"}, "capabilities": {"tools": {}}}}
            return out | {"error": {"code": -32601, "message": f"unknown method {request.get('method')!r}"}}
        except ValueError as e:
            return out | {"error": {"code": -32602, "message": str(e)}}
        except Exception:
            return out | {"error": {"code": -32603, "message": "the tool failed"}}  # details may hold secrets

    def serve(self, requests: TextIO, responses: TextIO) -> None:
        """Answers one request a line until the requests end; a line that isn't JSON gets an error."""
        for line in requests:
            if not line.strip():
                continue
            try:
                answer = self.answer(json.loads(line))
            except json.JSONDecodeError:
                answer = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not JSON"}}
            if answer is not None:
                responses.write(json.dumps(answer, ensure_ascii=False) + "\n")
                responses.flush()
