"""Commands: materialize views of patterns, answer a query with them, test against golden counts.

    python -m quiltgraph.cli materialize --data G --view P [P ...] --views DIR
    python -m quiltgraph.cli answer --data G --query Q [--views DIR] [--limit N] [--timeout S]
    python -m quiltgraph.cli test --data G --queries DIR --patterns DIR --answers FILE --views DIR

G is a text graph or a Parquet layout; P and Q are text patterns.  test builds
view_<i> for query_<i> of equal order, answers through it and compares.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from .engine import Engine
from .model import Pattern
from .scratch import children, exists, read_text
from .sources.text import parse_answers
from .views import store


def _graph(engine: Engine, path: str):
    return engine.load_parquet(path) if exists(engine.spark, f"{path}/edges") else engine.load_text(path)


def _pattern(engine: Engine, path: str) -> Pattern:
    return Pattern.parse(read_text(engine.spark, path))


def _materialize(engine: Engine, args) -> int:
    graph = _graph(engine, args.data)
    first = len(store.store_names(engine.spark, args.views))
    for i, path in enumerate(args.view):
        view = engine.materialize(graph, _pattern(engine, path), f"{args.views}/view_{first + i:04d}", timeout=args.timeout)
        print(json.dumps({"view": path, "status": view.status, "parts": view.parts, "bytes": sum(store.memory(view).values())}))
    return 0


def _answer(engine: Engine, args) -> int:
    views = engine.views(args.views) if args.views else []
    query = _pattern(engine, args.query)
    result = engine.match(_graph(engine, args.data), query, views, args.limit, args.timeout)
    print(json.dumps({"count": result.count, "timed_out": result.timed_out, "seconds": round(result.seconds, 3), "views": len(views)} | result.stats))
    return 0


def _test(engine: Engine, args) -> int:
    graph = _graph(engine, args.data)
    expected = parse_answers(read_text(engine.spark, args.answers))
    for name, pattern in zip(children(engine.spark, args.queries), children(engine.spark, args.patterns)):
        view = engine.materialize(graph, _pattern(engine, f"{args.patterns}/{pattern}"), f"{args.views}/{pattern}")
        result = engine.match(graph, _pattern(engine, f"{args.queries}/{name}"), [store.load(engine.spark, view.path)] if view.status in (store.BUILT, store.NO_ANSWER) else [], args.limit, args.timeout)
        want = expected.get(name.rsplit(".", 1)[0], expected.get(name))
        if result.count != want:
            print(f"{name}: {result.count}, expected {want}")
            return 1
    print(f"{len(expected)} passed")
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quiltgraph")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, run in (("materialize", _materialize), ("answer", _answer), ("test", _test)):
        command = commands.add_parser(name)
        command.set_defaults(run=run)
        command.add_argument("--data", required=True)
        command.add_argument("--timeout", type=float, default={"answer": 300.0, "test": 10.0}.get(name))
        if name == "materialize":
            command.add_argument("--view", nargs="+", required=True)
        if name == "answer":
            command.add_argument("--query", required=True)
        if name == "test":
            for x in ("--queries", "--patterns", "--answers"):
                command.add_argument(x, required=True)
        command.add_argument("--views", required=name != "answer")
        if name != "materialize":
            command.add_argument("--limit", type=int, default={"answer": 100_000, "test": 10**10}[name])
    args = parser.parse_args(argv)
    return args.run(Engine(SparkSession.builder.getOrCreate()), args)


if __name__ == "__main__":
    sys.exit(main())
