"""A small HTTP adapter of the standard library: GET /health and GET /demo?seed&rows&cost_bps."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from .plans.experiment import demo


def respond(spark, target: str) -> tuple[int, dict]:
    """Status and document of a request target; parameters out of range give 422."""
    url = urlsplit(target)
    if url.path == "/health":
        return 200, {"status": "ok"}
    if url.path != "/demo":
        return 404, {"detail": "not found"}
    given = {k: v[-1] for k, v in parse_qs(url.query).items()}
    try:
        how = {"seed": int(given.get("seed", 42)), "rows": int(given.get("rows", 900)), "cost_bps": float(given.get("cost_bps", 5.0))}
        return 200, demo(spark, **how)
    except ValueError as e:
        return 422, {"detail": str(e)}


def serve(spark, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            status, document = respond(spark, self.path)
            body = json.dumps(document, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

    return ThreadingHTTPServer((host, port), Handler)
