"""Command line: list, run and explain registered queries, time them, and show a schema or a migration.

    python -m starloom.cli queries
    python -m starloom.cli run b1_filter --data DIR [--limit 20]
    python -m starloom.cli explain b1_filter --data DIR
    python -m starloom.cli bench b1_filter scd2 --data DIR
    python -m starloom.cli ask "top customers by revenue" --names customer orders.o_totalprice=revenue
"""

from __future__ import annotations

import argparse
import json
import time

from . import catalog
from .config import Config


def _session(config: Config):
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("starloom").config(map=config.spark()).getOrCreate()


def main(arguments: list[str] | None = None, spark=None, out=print) -> int:
    parser = argparse.ArgumentParser(prog="starloom", description=__doc__.splitlines()[0])
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("queries")
    for name in ("run", "explain", "bench"):
        c = commands.add_parser(name)
        c.add_argument("query", nargs="+" if name == "bench" else None)
        c.add_argument("--data", required=True)
        c.add_argument("--limit", type=int, default=20)
    ask = commands.add_parser("ask")
    ask.add_argument("text")
    ask.add_argument("--names", nargs="*", default=[], help="table.column or table.column=other word")
    a = parser.parse_args(arguments)
    queries = catalog.queries()
    if a.command == "queries":
        for name, f in sorted(queries.items()):
            out(f"{name}: {(f.__doc__ or '').strip().splitlines()[0] if f.__doc__ else ''}".rstrip(": "))
        return 0
    if a.command == "ask":
        from .planning import phrases

        names = phrases.Entities()
        for n in a.names:
            target, _, word = n.partition("=")
            names.add(target, *([word] if word else []))
        out(json.dumps({"band": phrases.band(a.text), "time": phrases.temporal(a.text), "composition": phrases.composition(a.text), "entities": names.find(a.text)}))
        return 0
    asked = a.query if isinstance(a.query, list) else [a.query]
    if unknown := [q for q in asked if q not in queries]:
        out(f"no query {', '.join(unknown)}")
        return 2
    spark = spark or _session(Config.load())
    for q in asked:
        df = queries[q](spark, a.data)
        if a.command == "explain":
            df.explain("formatted")
        elif a.command == "bench":
            began = time.time()
            df.write.format("noop").mode("overwrite").save()
            out(f"{q} {time.time() - began:.3f} s")
        else:
            for r in df.limit(a.limit).toLocalIterator():
                out(json.dumps(r.asDict(recursive=True), default=str))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
