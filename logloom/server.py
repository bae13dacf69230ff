"""The store over HTTP: POST /push and /query, GET /partitions and /hello, OPTIONS /query.

A thin front for interactive use; bulk ingest goes through ``streaming.live``.
"""

from __future__ import annotations

import itertools
import json
import threading
from collections.abc import Iterator
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import SparkSession

from logloom.plans.planner import Request
from logloom.plans.render import pieces
from logloom.schema import PUSHED
from logloom.sources import store

FIELDS = {"ts": int, "indexes": list, "structured": bool, "raw_data": str, "json_keys": list}
REQUEST = {"query": str, "start_ts": int, "end_ts": int, "count": int, "offset": int, "partitions": list, "forward": bool}


def _fields(body, kinds: dict) -> dict:
    """The named fields of an object, all of them mandatory and of their type."""
    if not isinstance(body, dict):
        raise ValueError("the body is no JSON object")
    for name, kind in kinds.items():
        if name not in body:
            raise ValueError(f"missing field `{name}`")
        v = body[name]
        if not isinstance(v, kind) or (kind is int and (isinstance(v, bool) or not 0 <= v < 1 << 63)):
            raise ValueError(f"invalid field `{name}`")
    return {name: body[name] for name in kinds}


class Store:
    """One store on disk; pushes are serialised, as they number lines."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.lock = spark, path, threading.Lock()

    def push(self, body) -> None:
        own = _fields(body, {"source": str, "lines": list})
        rows = [(own["source"], i, *_fields(x, FIELDS).values()) for i, x in enumerate(own["lines"])]
        schema = "source string, place bigint, ts bigint, indexes array<string>, structured boolean, raw_data string, json_keys array<string>"
        if rows:
            with self.lock:
                store.ingest(self.spark.createDataFrame(rows, schema), self.path, ["place"])

    def query(self, body) -> Iterator[str]:
        r = _fields(body, REQUEST)
        request = Request(r["start_ts"], r["end_ts"], r["count"], r["offset"], tuple(r["partitions"]), r["forward"])
        return pieces(store.search(self.spark, self.path, r["query"], request), r["query"])

    def partitions(self) -> str:
        names = [r.source for r in store.sources(store.read(self.spark, self.path)).orderBy("source").collect()]
        return json.dumps({"partitions": names})


def server(spark: SparkSession, path: str, port: int = 5180) -> ThreadingHTTPServer:
    """A server that is bound but not yet serving; port 0 takes a free one."""
    own = Store(spark, path)

    class Handler(BaseHTTPRequestHandler):
        def reply(self, code: int, text: str, kind: str = "application/json", **headers: str) -> None:
            data = text.encode()
            self.send_response(code)
            for k, v in {"Content-Type": kind, "Content-Length": str(len(data)), "Access-Control-Allow-Origin": "*", **headers}.items():
                self.send_header(k, v)
            self.end_headers()
            self.wfile.write(data)

        def stream(self, f) -> None:
            """Pieces of text as they come; what fails before the first is the client's answer."""
            try:
                texts = f()
                head = [next(texts), next(texts)]
            except Exception as e:  # noqa: BLE001
                self.reply(406, str(e).split("\n")[0], "text/plain")
                return
            self.send_response(200)
            for k, v in {"Content-Type": "application/json", "Access-Control-Allow-Origin": "*", "Connection": "close"}.items():
                self.send_header(k, v)
            self.end_headers()
            for text in itertools.chain(head, texts):
                self.wfile.write(text.encode())

        def attempt(self, f, code: int = 200) -> None:
            try:
                self.reply(code, f())
            except Exception as e:  # noqa: BLE001 - whatever went wrong is the client's answer
                self.reply(406, str(e).split("\n")[0], "text/plain")

        def body(self):
            return json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"null")

        def do_GET(self) -> None:  # noqa: N802
            if self.path == "/hello":
                self.reply(200, "hello", "text/plain")
            elif self.path == "/partitions":
                self.attempt(own.partitions)
            else:
                self.reply(404, "", "text/plain")

        def do_POST(self) -> None:  # noqa: N802
            if self.path == "/push":
                self.attempt(lambda: own.push(self.body()) or "ok", 201)
            elif self.path == "/query":
                self.stream(lambda: own.query(self.body()))
            else:
                self.reply(404, "", "text/plain")

        def do_OPTIONS(self) -> None:  # noqa: N802
            self.reply(200, "", **{"Access-Control-Allow-Methods": "POST", "Access-Control-Allow-Headers": "Content-Type"})

        def log_message(self, *args) -> None:
            pass

    assert set(FIELDS) == set(PUSHED.names)
    return ThreadingHTTPServer(("127.0.0.1", port), Handler)
