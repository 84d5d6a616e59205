"""Parsers over relations of files."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from routeloom.extract import calls, python_contracts, python_flow, routes, scan, symbols
from routeloom.functions import kinds
from routeloom.functions.routes import api_path, call_verb, client_service, url_service
from routeloom.operators.scores import call_confidence


def per_file(files: DataFrame, parse: Callable[[str], list[dict]], schema: str, keep: tuple[str, ...] = ("repo", "path"), text: str = "text") -> DataFrame:
    """Rows that ``parse`` makes of each file's text, with the columns ``keep`` and the row's place in its file, ``pos``.

    A null text has no rows. Files are independent: no shuffle.
    """
    own = StructType([files.schema[c] for c in keep]).add("pos", "long")
    made = StructType.fromDDL(schema)
    arrow = to_arrow_schema(made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, pos, rows = [], [], []
            for i, value in enumerate(batch.column(len(keep))):
                found = parse(value.as_py()) if value.is_valid else []
                at += [i] * len(found)
                pos += range(1, len(found) + 1)
                rows += found
            index = pa.array(at, pa.int64())
            columns = [batch.column(i).take(index) for i in range(len(keep))] + [pa.array(pos, pa.int64())]
            columns += [pa.array([r[f.name] for r in rows], f.type) for f in arrow]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "pos", *made.names])

    return files.select(*keep, text).mapInArrow(run, StructType([*own.fields, *made.fields]))


def declared_routes(files: DataFrame) -> DataFrame:
    """Routes declared in source files (repo, path, text), in the shape that merging takes but for its ``ord``; ``pos`` is a route's place in its file."""
    found = per_file(
        files.filter(kinds.file_role(F.col("path")) == "source_route_candidate").withColumnRenamed("path", "file"), routes.all_routes,
        "framework string, method string, path string, handler string, line long, label string, snippet string", ("repo", "file"),
    )
    return found.select(
        "pos", "method", "path", "handler", "file", "repo", F.lit(None).cast("string").alias("service"), F.lit(1.0).alias("confidence"),
        F.lit("deterministic").alias("status"), F.array(F.struct("file", F.col("handler").alias("symbol"), "label", "snippet")).alias("evidence"), "framework", "line",
    )


def route_facts(files: DataFrame) -> DataFrame:
    return per_file(files.withColumnRenamed("path", "file"), routes.route_facts, "kind string, line long, receiver string, method string, path string, name string, snippet string", ("repo", "file"))


def imports(files: DataFrame) -> DataFrame:
    """The imports among :func:`route_facts`; other lines are not read."""
    return per_file(files.withColumnRenamed("path", "file"), routes.imports, "line long, path string, name string", ("repo", "file"))


#: Which parser reads the symbols of a file, by its suffix; add a language here.
SYMBOL_PARSERS: dict[str, Callable[[str], list[dict]]] = dict.fromkeys((".ts", ".tsx", ".js", ".jsx"), symbols.js_symbols)


def js_symbols(files: DataFrame) -> DataFrame:
    """Symbols of the files whose suffix has a parser."""
    parsers = dict(SYMBOL_PARSERS)
    known = files.filter(kinds.suffix(F.col("path")).isin(*parsers))
    packed = known.withColumn("_in", F.concat_ws("\n", kinds.suffix(F.col("path")), "text")).filter("text IS NOT NULL")

    def read(value: str) -> list[dict]:
        ending, _, code = value.partition("\n")
        return parsers[ending](code)

    return per_file(
        packed, read,
        "name string, qualified_name string, kind string, parent string, start_line long, end_line long, export_kind string, is_static boolean, is_async boolean, params string",
        text="_in",
    )


def outbound_calls(files: DataFrame) -> DataFrame:
    """Outbound calls with normal forms and confidences: a chain has 0.8 at least, a method alone 0.4."""
    found = per_file(files, calls.outbound_calls, "line long, symbol string, client string, verb string, target string, form string, raw string")
    method, path = call_verb(F.col("verb")), api_path(F.col("target"))
    service = F.coalesce(client_service(F.col("client")), url_service(F.col("target")))
    score = call_confidence(method, path, service)
    confidence = F.when(F.col("form") == "chain", F.greatest(F.lit(0.8), score)).when(F.col("form") == "method_only", 0.4).otherwise(score)
    return found.select("repo", "path", "pos", "line", "symbol", "form", "raw", method.alias("method"), path.alias("target_path"), service.alias("service"), confidence.alias("confidence"))


def _of_handlers(handlers: DataFrame, parse: Callable[..., list[dict]], schema: str) -> DataFrame:
    """Rows that ``parse(text, handler, method)`` makes of each handler (repo, file, handler, method, text)."""
    packed = handlers.withColumn("_in", F.to_json(F.struct("handler", "method", "text")))

    def read(value: str) -> list[dict]:
        x = json.loads(value)
        return parse(x.get("text") or "", x.get("handler") or "", x.get("method"))

    return per_file(packed, read, schema, ("repo", "file", "handler"), "_in")


def handler_steps(handlers: DataFrame) -> DataFrame:
    """Steps of Python handlers: ``handlers`` (repo, file, handler, method, text), a row for each."""
    return _of_handlers(handlers, python_flow.handler_steps, "line long, seq long, kind string, name string")


def request_fields(handlers: DataFrame) -> DataFrame:
    """Fields that Python handlers read of their requests."""
    return _of_handlers(handlers, lambda t, h, _: python_contracts.request_fields(t, h), "place string, name string, type string, required boolean, line long")


def responses(handlers: DataFrame) -> DataFrame:
    """Statuses that Python handlers answer with, and the types of their bodies."""
    return _of_handlers(handlers, python_contracts.responses, "status string, shape string, line long")


def model_fields(files: DataFrame) -> DataFrame:
    """Fields of model classes in Python files."""
    return per_file(files.filter(F.col("path").endswith(".py")), python_contracts.model_fields, "model string, field string, type string, line long")


def test_payloads(files: DataFrame) -> DataFrame:
    """Bodies that the tests among files send."""
    tests = files.filter(kinds.basename(F.col("path")).rlike(r"^test.*\.py$"))
    return per_file(
        tests, lambda t: [{**r, "route": r["path"]} for r in python_contracts.payloads(t)], "method string, route string, field string, type string, line long"
    )


def body_statements(functions: DataFrame) -> DataFrame:
    """Statements of functions (repo, path, name, start_line, end_line, text): ``repo, path, name, pos, first, last, statement``."""
    packed = functions.withColumn("_in", F.to_json(F.struct("start_line", "end_line", "text")))

    def read(value: str) -> list[dict]:
        x = json.loads(value)
        return [{"first": a, "last": b, "statement": t} for a, b, t in symbols.body_statements(x.get("text") or "", x["start_line"], x.get("end_line"))]

    return per_file(packed, read, "first long, last long, statement string", ("repo", "path", "name"), "_in")


def called_names(statements: DataFrame) -> DataFrame:
    """``repo, path, pos, call, followable``: names that statements (repo, path, text) call."""
    return per_file(statements, lambda t: [{"call": n, "followable": scan.is_followable(n)} for n in scan.called_names(t)], "call string, followable boolean")
