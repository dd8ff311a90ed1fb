"""A thin HTTP shell over the engine: status, metrics, report and runs, one run at a time."""

from __future__ import annotations

import json
import threading
import time
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from mutabik.plans.engine import run
from mutabik.plans.render import report_html, summary_dict
from mutabik.sources.store import ParquetStore


class Metrics:
    """Counters in the text format of Prometheus."""

    def __init__(self) -> None:
        self.lock, self.runs, self.last = threading.Lock(), Counter(), {}

    def done(self, status: str, seconds: float = 0.0, values: dict | None = None) -> None:
        with self.lock:
            self.runs[status] += 1
            if values:
                self.last = {"seconds": seconds, **values}

    def text(self) -> str:
        with self.lock:
            lines = ["# TYPE reconciliation_runs_total counter"] + [f'reconciliation_runs_total{{status="{s}"}} {n}' for s, n in sorted(self.runs.items())]
            if self.last:
                lines += ["# TYPE reconciliation_last_run_seconds gauge", f"reconciliation_last_run_seconds {self.last['seconds']:.3f}"]
                for name, label in (("by_kind", "kind"), ("by_type", "type")):
                    lines += [f"# TYPE reconciliation_last_{name} gauge"] + [f'reconciliation_last_{name}{{{label}="{k}"}} {v}' for k, v in self.last[name].items()]
        return "\n".join(lines) + "\n"


def make_server(store: ParquetStore, address: tuple[str, int]) -> ThreadingHTTPServer:
    metrics, busy = Metrics(), threading.Lock()

    class Handler(BaseHTTPRequestHandler):
        def reply(self, code: int, body: str, kind: str = "application/json", **headers: str) -> None:
            data = body.encode()
            self.send_response(code)
            for k, v in {"Content-Type": f"{kind}; charset=utf-8", "Content-Length": str(len(data)), **headers}.items():
                self.send_header(k.replace("_", "-"), v)
            self.end_headers()
            self.wfile.write(data)

        def guarded(self, f) -> None:
            try:
                f()
            except Exception:
                metrics.done("error")
                self.reply(500, json.dumps({"error": "internal error"}))

        def do_GET(self) -> None:
            if self.path == "/":
                self.reply(302, "", "text/plain", Location="/report")
            elif self.path == "/healthz":
                self.reply(200, json.dumps({"status": "ok"}))
            elif self.path == "/readyz":
                try:
                    store.ping()
                    self.reply(200, json.dumps({"status": "ready"}))
                except Exception:
                    self.reply(503, json.dumps({"status": "unavailable"}))
            elif self.path == "/metrics":
                self.reply(200, metrics.text(), "text/plain")
            elif self.path == "/report":
                self.guarded(lambda: self.reply(200, report_html(store.load(), run(store.load())), "text/html"))
            else:
                self.reply(404, json.dumps({"error": "not found"}))

        def do_POST(self) -> None:
            if self.path != "/api/v1/reconciliation-runs":
                self.reply(404, json.dumps({"error": "not found"}))
            elif not busy.acquire(blocking=False):
                metrics.done("conflict")
                self.reply(409, json.dumps({"error": "a run is in progress"}))
            else:
                try:
                    self.guarded(self.run_once)
                finally:
                    busy.release()

        def run_once(self) -> None:
            began = time.perf_counter()
            book = store.load()
            out = run(book)
            store.save(out)
            s = summary_dict(book, out)
            metrics.done("ok", time.perf_counter() - began, s)
            self.reply(200, json.dumps(s))

        def log_message(self, *_: object) -> None:
            pass

    server = ThreadingHTTPServer(address, Handler)
    server.busy, server.metrics = busy, metrics  # type: ignore[attr-defined]
    return server
