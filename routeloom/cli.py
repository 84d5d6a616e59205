"""The command line: ``python -m routeloom.cli routes|trace|export …``."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from routeloom.plans import discovery
from routeloom.plans.trace import trace
from routeloom.sinks import artifacts, exports, terminal
from routeloom.sources.repository import parse_spec, read_repositories

VERSION = "0.2.0"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="routeloom", description="HTTP routes of source repositories, and what happens inside a request.")
    p.add_argument("--version", action="version", version=VERSION)
    commands = p.add_subparsers(dest="command", required=True)
    routes, traced, export = (commands.add_parser(name, help=said) for name, said in (("routes", "discover routes"), ("trace", "trace one request"), ("export", "export a stored artifact or a collection")))
    for c in (routes, traced):
        c.add_argument("--repo", action="append", required=True, metavar="NAME=PATH")
        c.add_argument("--output", metavar="FILE|FOLDER")
        c.add_argument("--json", action="store_true", help="print JSON")
    traced.add_argument("path")
    traced.add_argument("--method")
    export.add_argument("kind", choices=("trace", "postman"))
    export.add_argument("input")
    export.add_argument("--output", metavar="FILE|FOLDER", required=True)
    export.add_argument("--name", default="Tests")
    return p


def routes_command(spark: SparkSession, args) -> str:
    repos = [parse_spec(r) for r in args.repo]
    found = discovery.discover(read_repositories(spark, args.repo)).cache()
    if not (args.json or args.output):
        return terminal.render_routes(found, repos)
    document = {"repos": [{"name": n, "root": r} for n, r in repos], "routes": exports.as_json(found.orderBy("repo", "method", "path", "file", "handler"))}
    if args.output:
        return "\n".join(map(str, exports.write_routes(args.output, document)))
    return exports.render(document)


def trace_command(spark: SparkSession, args) -> str:
    t = trace(read_repositories(spark, args.repo), args.path, args.method)
    if not (args.json or args.output):
        return terminal.render_trace(t.summary, t.steps, t.sinks, t.links)
    top = exports.as_json(t.summary)
    parts = {
        "target": {"path": args.path, "method": args.method}, "repos": [dict(zip(("name", "root"), parse_spec(r), strict=True)) for r in args.repo],
        "nodes": exports.as_json(t.steps.orderBy("ord")), "edges": exports.as_json(t.layer_edges), "flows": [], "layers": exports.as_json(t.layers.orderBy("depth", "ord")),
        "sinks": exports.as_json(t.sinks), "unknowns": exports.as_json(t.endpoint.filter("rank > 1").drop("evidence", "ord")), "summary": top[0] if top else {"confidence": 0.0},
    }
    if args.output:
        return "\n".join(map(str, exports.write_trace(args.output, parts, {"links": exports.as_json(t.links), "followed": exports.as_json(t.followed)})))
    return exports.render(exports.export_trace(parts))


def export_command(spark: SparkSession, args) -> str:
    if args.kind == "trace":
        document, name = exports.export_stored(json.loads(Path(args.input).read_text(encoding="utf-8"))), "trace_export.json"
    else:
        tests = exports.read_matrix(spark, args.input)
        none = F.lit(None).cast("string")
        asked = artifacts.scenario_requests(tests.select(
            "name", "summary", "category", "contract_refs", "method", "route", F.col("request.method").alias("request_method"), F.col("request.path").alias("request_path"), none.alias("route_method"), none.alias("route_path"),
            F.col("request.headers").alias("headers"), F.col("request.body").alias("body"), F.lit(None).cast("map<string,string>").alias("query"), (F.col("group_ord") * 10_000 + F.col("ord")).alias("ord"),
        ))
        document, name = json.loads(artifacts.postman_collection(asked, args.name).first()[0]), "postman_collection.json"
    path = exports.output_file(args.output, name)
    path.write_text(exports.render(document) + "\n", encoding="utf-8")
    return str(path)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("routeloom").getOrCreate()
    try:
        print({"routes": routes_command, "trace": trace_command, "export": export_command}[args.command](spark, args))
    except ValueError as e:
        print(f"routeloom: {e}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
