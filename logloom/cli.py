"""logs, apps and tail on a store: ``python -m logloom.cli --store PATH logs --query '...'``."""

from __future__ import annotations

import argparse
import re
import time

from pyspark.sql import SparkSession

from logloom.plans.planner import Request
from logloom.plans.render import pieces
from logloom.server import server
from logloom.sources import store
from logloom.streaming.live import tail

UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400}


def seconds(text: str) -> int:
    """A duration such as 90s, 15m, 3h or 1h30m."""
    parts = re.findall(r"(\d+)([smhd])", text)
    if not parts or "".join(n + u for n, u in parts) != text:
        raise argparse.ArgumentTypeError(f"not a duration: {text}")
    return sum(int(n) * UNITS[u] for n, u in parts)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="logloom")
    p.add_argument("--store", required=True)
    sub = p.add_subparsers(dest="what", required=True)
    logs = sub.add_parser("logs", help="answer a query")
    logs.add_argument("--query", default="")
    logs.add_argument("--apps", action="append", default=[])
    logs.add_argument("--since", type=seconds, default=0)
    follow = sub.add_parser("tail", help="follow sources")
    follow.add_argument("--apps", action="append", default=[])
    follow.add_argument("--once", action="store_true", help="stop at what is there now")
    sub.add_parser("apps", help="list the sources")
    sub.add_parser("serve", help="answer over HTTP").add_argument("--port", type=int, default=5180)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("logloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.what == "serve":
        server(spark, args.store, args.port).serve_forever()
        return
    if args.what == "tail":
        def show(batch, _):
            for r in batch.toLocalIterator():
                print(f"APP: {r.app}, ts: {time.strftime('%Y-%m-%d %H:%M:%S', time.gmtime(r.ts))}, line: {r.inner}")

        q = tail(spark, args.store, args.apps).writeStream.foreachBatch(show)
        (q.trigger(availableNow=True) if args.once else q).start().awaitTermination()
        return
    if args.what == "apps":
        print("App Names")
        for r in store.sources(store.read(spark, args.store)).orderBy("source").toLocalIterator():
            print(r.source)
        return
    now = int(time.time())
    request = Request(now - args.since if args.since else 0, now if args.since else 0, partitions=tuple(args.apps))
    for text in pieces(store.search(spark, args.store, args.query, request), args.query):
        print(text)


if __name__ == "__main__":
    main()
