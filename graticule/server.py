"""The HTTP surface over an engine, on the standard library's server."""

from __future__ import annotations

import gzip
import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from .engine import Engine
from .plans.parser import ParseError


def answer(engine: Engine, path: str, q: dict[str, list[str]]) -> tuple[int, dict]:
    """(status code, body) of a request; ``q`` holds its parameters."""

    def arg(name: str) -> str | None:
        return q[name][0] if q.get(name) else None

    def need(*names: str) -> list[str]:
        missing = [n for n in names if arg(n) is None]
        if missing:
            raise ValueError(f"missing parameter {missing[0]!r}")
        return [arg(n) for n in names]

    try:
        limit = int(arg("limit") or 0)
        if limit < 0:
            raise ValueError("limit must not be negative")
        span = (arg("start") or "0", arg("end") or "9999999999")
        match = q.get("match[]")
        if path == "/api/v1/query":
            out = engine.query(*need("query"), arg("time"), limit)
        elif path == "/api/v1/query_range":
            out = engine.query_range(*need("query", "start", "end", "step"), limit)
        elif path == "/api/v1/plan":
            out = {"status": "success", "data": engine.plan(*need("query"), arg("time") or 0)}
        elif path == "/api/v1/plan_range":
            out = {"status": "success", "data": engine.plan_range(*need("query", "start", "end", "step"))}
        elif path == "/api/v1/series":
            out = engine.series(match or [], *span, limit)
        elif path == "/api/v1/labels":
            out = engine.label_names(match, *span, limit)
        elif path.startswith("/api/v1/label/") and path.endswith("/values"):
            out = engine.label_values(path.split("/")[4], match, *span, limit)
        elif path == "/api/v1/status/config":
            out = {"status": "success", "data": engine.config()}
        elif path == "/-/ready":
            return (200, {"status": "success"}) if engine.ready() else (503, {"status": "error", "error": "not ready"})
        else:
            return 404, {"status": "error", "errorType": "not_found", "error": path}
    except (ValueError, ParseError) as e:
        return 400, {"status": "error", "errorType": "bad_data", "error": str(e)}
    return out.pop("code", 200), out


def serve(engine: Engine, port: int = 9090, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """A server bound to the port; call ``serve_forever`` on it."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            url = urlsplit(self.path)
            self._reply(url.path, parse_qs(url.query, keep_blank_values=True))

        def do_POST(self) -> None:
            url = urlsplit(self.path)
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0)).decode()
            self._reply(url.path, parse_qs(url.query) | parse_qs(body, keep_blank_values=True))

        def _reply(self, path: str, q: dict) -> None:
            code, body = answer(engine, path, q)
            data = json.dumps(body).encode()
            zipped = "gzip" in self.headers.get("Accept-Encoding", "")
            data = gzip.compress(data) if zipped else data
            self.send_response(code)
            self.send_header("Content-Type", "application/json")
            if zipped:
                self.send_header("Content-Encoding", "gzip")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
