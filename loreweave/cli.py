"""Command line: python -m loreweave.cli --kb FOLDER COMMAND ..."""

from __future__ import annotations

import argparse
import sys

VERSION = "0.1.0"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loreweave")
    p.add_argument("--kb", default=".", help="folder with config.yaml")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("version", "info", "serve"):
        sub.add_parser(name)
    sub.add_parser("import").add_argument("path")
    for name in ("search", "vector-search", "fts-search"):
        s = sub.add_parser(name)
        s.add_argument("query")
        s.add_argument("--node-type")
        s.add_argument("--limit", type=int, default=10)
        if name == "search":
            s.add_argument("--alpha", type=float, default=0.5)
    s = sub.add_parser("get-source-record")
    s.add_argument("source_table")
    s.add_argument("source_id", type=int)
    sub.add_parser("query-raw-sql").add_argument("sql")
    for name, direction, depth in (("get-neighbors", "both", None), ("traverse", "out", 3), ("extract-subgraph", None, 2)):
        s = sub.add_parser(name)
        s.add_argument("node_type")
        s.add_argument("node_id")
        s.add_argument("--edge-types")
        if direction:
            s.add_argument("--direction", default=direction)
            s.add_argument("--limit", type=int, default=100 if name == "get-neighbors" else 1000)
        if depth:
            s.add_argument("--max-depth", type=int, default=depth)
        if name == "traverse":
            s.add_argument("--no-paths", dest="return_paths", action="store_false")
        if name == "extract-subgraph":
            s.add_argument("--node-limit", type=int, default=100)
            s.add_argument("--edge-limit", type=int, default=200)
    s = sub.add_parser("find-paths")
    for a in ("from_type", "from_id", "to_type", "to_id"):
        s.add_argument(a)
    s.add_argument("--edge-types")
    s.add_argument("--max-depth", type=int, default=5)
    s.add_argument("--limit", type=int, default=10)
    s = sub.add_parser("graph-search")
    s.add_argument("query")
    s.add_argument("--node-type")
    s.add_argument("--edge-types")
    s.add_argument("--direction", default="both")
    for name, default in (("traverse-depth", 1), ("search-limit", 5), ("neighbor-limit", 10)):
        s.add_argument(f"--{name}", type=int, default=default)
    s.add_argument("--alpha", type=float, default=0.5)
    return p



def main(argv: list[str] | None = None) -> int:
    args = vars(parser().parse_args(argv))
    command, kb = args.pop("command"), args.pop("kb")
    if command == "version":
        print(VERSION)
        return 0
    from pyspark.sql import SparkSession

    from loreweave.plans.engine import Engine
    from loreweave.plans.service import tools

    spark = SparkSession.builder.appName("loreweave").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    engine = Engine(spark, kb)
    if command == "serve":
        from loreweave.plans.mcp import serve

        serve(engine, sys.stdin, sys.stdout, VERSION)
    else:
        print(tools(engine)[command.replace("-", "_")](**args))
    return 0


if __name__ == "__main__":
    sys.exit(main())
