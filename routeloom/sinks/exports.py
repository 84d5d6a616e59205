"""Exports: results as JSON documents and files, and test matrices read back."""

from __future__ import annotations

import json
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parts of an exported trace; those that are always there, and those that are there if they hold something.
ALWAYS = ("version", "target", "repos", "nodes", "edges", "flows", "tests", "unknowns", "notes", "summary")
OPTIONAL = ("matched_endpoint", "flow", "layers", "sinks", "resolved_handlers", "budgets", "diagnostics", "artifacts", "test_matrix")
#: What a stored graph calls the parts of a trace.
_GRAPH_PARTS = {"repos": "repo_inputs", "tests": "tests", "unknowns": "unknowns", "notes": "notes"}
EXPORT_FORMAT, EXPORT_VERSION = "routeloom_trace_json", "v1"


def without_nulls(value):
    """A JSON value without null fields, at any depth."""
    if isinstance(value, dict):
        return {k: without_nulls(v) for k, v in value.items() if v is not None}
    return [without_nulls(v) for v in value] if isinstance(value, list) else value


def as_json(df: DataFrame) -> list[dict]:
    """Rows of a bounded result as JSON values; null fields are left out."""
    return [json.loads(r) for r in df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))).toPandas().iloc[:, 0]]


def export_trace(parts: dict, now: datetime | None = None) -> dict:
    """The document of a trace: its parts, null fields left out, and metadata."""
    if "target" not in parts or "summary" not in parts:
        raise ValueError("a trace has a target and a summary")
    usual = {"version": "v1"} | {p: [] for p in ALWAYS if p not in ("version", "target", "summary")}
    out = {p: without_nulls(parts.get(p, usual.get(p))) for p in ALWAYS}
    out |= {p: without_nulls(parts[p]) for p in OPTIONAL if parts.get(p)}
    out["metadata"] = {"format": EXPORT_FORMAT, "export_version": EXPORT_VERSION, "trace_version": out["version"], "exported_at": (now or datetime.now(UTC)).isoformat()}
    return out


def export_stored(payload, now: datetime | None = None) -> dict:
    """The document of a stored artifact: a trace, an envelope with a ``result``, or one with a ``graph``."""
    if not isinstance(payload, dict):
        raise ValueError("an artifact is a JSON object")
    if "result" in payload:
        parts, kind = payload["result"], "trace_result_envelope"
    elif "graph" in payload:
        graph, kind = payload["graph"], "trace_graph_envelope"
        if not isinstance(graph, dict) or not isinstance(payload.get("target"), dict):
            raise ValueError("a graph artifact has a graph and a target")
        parts = {"version": payload.get("version", "v1"), "target": payload["target"], "summary": {"key_flow_id": payload.get("key_flow_id"), "confidence": payload.get("confidence")}}
        parts |= {p: graph.get(p, []) for p in ("nodes", "edges", "flows")} | {p: payload.get(name, []) for p, name in _GRAPH_PARTS.items()}
    elif {"target", "nodes", "edges", "flows", "summary"} <= payload.keys():
        parts, kind = payload, "trace_result"
    else:
        raise ValueError("neither a trace nor a stored trace or graph")
    if not isinstance(parts, dict):
        raise ValueError("an artifact's result is a JSON object")
    out = export_trace(parts, now)
    out["metadata"] |= without_nulls({"source_artifact_kind": kind, "source_timestamp": payload.get("timestamp"), "artifact": payload.get("artifact_metadata")})
    return out


def output_file(output: str | Path, default_name: str) -> Path:
    """Where one document goes: into ``output`` if that is a folder or does not end in ``.json``, else to it."""
    kind, path = output_target(output)
    return path if kind == "file" else path / default_name


def output_target(output: str | Path) -> tuple[str, Path]:
    """``("file" | "directory", path)``; folders that are missing are made."""
    path = Path(output)
    if path.exists() and not (path.is_dir() or path.is_file()):
        raise ValueError(f"neither a file nor a folder: {path}")
    is_file = path.is_file() or (not path.exists() and path.suffix.lower() == ".json")
    folder = path.parent if is_file else path
    if folder.exists() and not folder.is_dir():
        raise ValueError(f"not a folder: {folder}")
    folder.mkdir(parents=True, exist_ok=True)
    return ("file" if is_file else "directory"), path


def render(value) -> str:
    """A document as indented JSON."""
    return json.dumps(value, indent=2, ensure_ascii=False, default=str)


def write_documents(output: str | Path, main: tuple[str, dict], others: dict[str, object] | None = None) -> list[Path]:
    """Write a document, and the others beside it if ``output`` is a folder; those that are None are left out."""
    kind, path = output_target(output)
    files = {path: main[1]} if kind == "file" else {path / f"{name}.json": doc for name, doc in {main[0]: main[1], **(others or {})}.items() if doc is not None}
    for file, doc in files.items():
        file.write_text(render(doc) + "\n", encoding="utf-8")
    return list(files)


def write_trace(output: str | Path, parts: dict, others: dict[str, object] | None = None) -> list[Path]:
    """A trace's document; in a folder also its graph, its test matrix and whatever else was made for it."""
    trace = without_nulls(parts)
    graph = {"target": parts.get("target"), "key_flow_id": (parts.get("summary") or {}).get("key_flow_id"), **{p: parts.get(p, []) for p in ("nodes", "edges", "flows")}}
    return write_documents(output, ("trace_result", trace), {"trace_graph": graph, "test_matrix": parts.get("test_matrix"), **(others or {})})


def write_routes(output: str | Path, routes: dict, contract: dict | None = None) -> list[Path]:
    """Routes, and in a folder their contract."""
    return write_documents(output, ("routes", routes), {"api_contract": contract})


TEST = (
    "name string, route string, method string, summary string, category string, priority string, request struct<method:string,path:string,headers:map<string,string>,body:string>, "
    "expected struct<status:string,behavior:string,response_schema_ref:string>, contract_refs array<string>"
)


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """Scenarios of a test matrix, an object with a list ``groups``: ``group_ord, ord, group_category, title`` and the fields of a test."""
    schema = f"groups array<struct<category:string,title:string,tests:array<struct<{TEST.replace(' string', ':string').replace('request struct', 'request:struct').replace('expected struct', 'expected:struct').replace('contract_refs array', 'contract_refs:array')}>>>>"
    found = spark.read.schema(schema).option("multiLine", True).json(path)
    if found.filter("groups IS NOT NULL").isEmpty():
        raise ValueError(f"{path}: no object with a list of groups")
    groups = found.select(F.posexplode("groups").alias("group_ord", "g"))
    return groups.select("group_ord", F.col("g.category").alias("group_category"), "g.title", F.posexplode("g.tests").alias("ord", "t")).select("group_ord", "ord", "group_category", "title", "t.*")
