"""Endpoints over a scorer: functions of requests, and a small HTTP server of the standard library.

A batch is one plan; single requests are batches of one."""

from __future__ import annotations

import json
import threading
import time
from collections import defaultdict, deque
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import SparkSession

from .operators.serving import REQUEST, Scorer


class Service:
    """predict, predict_batch, health and model_info, with a limit of requests a minute for each client and a log."""

    def __init__(self, spark: SparkSession, scorer: Scorer | None = None, version: str = "1", per_minute: int = 60, clock=time.time):
        self.spark, self.scorer, self.version, self.per_minute, self.clock = spark, scorer, version, per_minute, clock
        self.started: float | None = None
        self.seen: dict[str, deque] = defaultdict(deque)
        self.log: deque = deque(maxlen=1000)
        self.lock = threading.Lock()

    def startup(self) -> None:
        self.scorer = self.scorer or Scorer()
        self.started = self.clock()

    def shutdown(self) -> None:
        self.started = None

    def health(self) -> dict:
        """healthy only between startup and shutdown."""
        up = self.started is not None
        return {"status": "healthy" if up else "unhealthy", "model_loaded": up and self.scorer is not None, "uptime": self.clock() - self.started if up else 0.0}

    def model_info(self) -> dict:
        if self.scorer is None:
            raise RuntimeError("no model is loaded")
        return {"version": self.version, "features": sorted(self.scorer.beta), "calibration": {"a": self.scorer.a, "b": self.scorer.b}}

    def predict_batch(self, requests: list[dict]) -> list[dict]:
        """A result a request, in their order; errors are part of a result."""
        if self.started is None:
            raise RuntimeError("the service is not started")
        rows = [{**r, "request_id": k} for k, r in enumerate(requests)]
        if not rows:
            return []
        out = self.scorer.score(self.spark.read.schema(REQUEST).json(self.spark.sparkContext.parallelize([json.dumps(r) for r in rows])))
        return [r.asDict(True) for r in sorted(out.collect(), key=lambda r: r.request_id)]

    def predict(self, request: dict) -> dict:
        return self.predict_batch([request])[0]

    def allowed(self, client: str) -> bool:
        """Whether the client is within its limit; counts the request if so."""
        now = self.clock()
        with self.lock:
            times = self.seen[client]
            while times and now - times[0] >= 60:
                times.popleft()
            if len(times) >= self.per_minute:
                return False
            times.append(now)
            return True

    def handle(self, method: str, path: str, body: dict | list | None = None, client: str = "") -> tuple[int, dict | list]:
        """Status and answer of a request; each is logged with the time it took."""
        began = self.clock()
        status, answer = self._answer(method, path, body, client)
        self.log.append({"client": client, "method": method, "path": path, "status": status, "seconds": self.clock() - began})
        return status, answer

    def _answer(self, method, path, body, client):
        routes = {("GET", "/health"): lambda: self.health(), ("GET", "/model/info"): lambda: self.model_info(), ("POST", "/predict"): lambda: self.predict(body), ("POST", "/predict/batch"): lambda: self.predict_batch(body)}
        if not self.allowed(client):
            return 429, {"detail": "too many requests"}
        if (method, path) not in routes:
            return 404, {"detail": "not found"}
        if path == "/predict" and not isinstance(body, dict) or path == "/predict/batch" and not (isinstance(body, list) and all(isinstance(x, dict) for x in body)):
            return 422, {"detail": "a request is an object, a batch a list of them"}
        try:
            return 200, routes[method, path]()
        except RuntimeError as e:
            return 503, {"detail": str(e)}


def server(service: Service, host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
    """An HTTP server of the service's routes; serve_forever() runs it."""

    class Handler(BaseHTTPRequestHandler):
        def _reply(self, method: str) -> None:
            raw = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            try:
                body = json.loads(raw) if raw else None
                status, answer = service.handle(method, self.path, body, self.client_address[0])
            except ValueError:
                status, answer = 400, {"detail": "malformed JSON"}
            text = json.dumps(answer).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(text)))
            self.end_headers()
            self.wfile.write(text)

        def do_GET(self):
            self._reply("GET")

        def do_POST(self):
            self._reply("POST")

        def log_message(self, *args):
            pass  # the service keeps its own log

    service.startup()
    return ThreadingHTTPServer((host, port), Handler)
