"""An HTTP endpoint for metrics that a scraper pulls, and for a health probe."""

from __future__ import annotations

from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from threading import Thread

from pyspark.sql import DataFrame

from ..functions.config import DEFAULTS


def exposition_text(lines: DataFrame) -> str:
    """The (place, line) rows of metrics.exposition() as one text; some fifty rows."""
    return "\n".join(r["line"] for r in lines.orderBy("place").collect()) + "\n"


class MetricsEndpoint:
    """Serves /metrics (what render() returns at each request) and /health, 404 elsewhere, from a daemon thread.

    A render that fails answers 500 and leaves the server up. Port 0 takes a
    free one; `port` says which.
    """

    def __init__(self, render: Callable[[], str], port: int = DEFAULTS.metrics_port, host: str = "0.0.0.0"):
        class Handler(BaseHTTPRequestHandler):
            def do_GET(self) -> None:
                status, body = 404, ""
                if self.path == "/health":
                    status, body = 200, "OK"
                elif self.path == "/metrics":
                    try:
                        status, body = 200, render()
                    except Exception as failure:
                        status, body = 500, type(failure).__name__
                data = body.encode()
                self.send_response(status)
                self.send_header("Content-Type", "text/plain; charset=utf-8")
                self.send_header("Content-Length", str(len(data)))
                self.end_headers()
                self.wfile.write(data)

            def log_message(self, *_) -> None:
                return

        self.server = ThreadingHTTPServer((host, port), Handler)
        self.port = self.server.server_address[1]
        Thread(target=self.server.serve_forever, daemon=True).start()

    def stop(self) -> None:
        self.server.shutdown()
        self.server.server_close()
