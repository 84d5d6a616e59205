"""What happens inside a request: from a path and a method to steps, sinks, links and a confidence."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from routeloom.extract import tables
from routeloom.functions import kinds
from routeloom.functions.evidence import EVIDENCE, declares_route
from routeloom.functions.kinds import any_of
from routeloom.operators import follow, grounding, relational, scores
from routeloom.plans import discovery
from routeloom.session import cut

# What a step that writes to a database says.
DB_WRITES = ("db.add", "db.commit", "db.execute", "db.refresh", "repository.save")


@dataclass
class Trace:
    """``endpoint``: the selection; ``steps``: flow_id, ord, kind, name, file, repo; ``sinks``; ``links`` of outbound calls; ``followed``: what became of the calls in
    the handler; ``layers``: endpoint, handler and followed calls by depth; ``layer_edges`` between them; ``summary``: one row."""

    endpoint: DataFrame
    steps: DataFrame
    sinks: DataFrame
    links: DataFrame
    followed: DataFrame
    layers: DataFrame
    layer_edges: DataFrame
    summary: DataFrame


def derive_sinks(steps: DataFrame) -> DataFrame:
    """Inferred database sinks of steps (flow_id, ord, name, symbol, file, repo) whose text writes to one; route declarations are none."""
    said = F.lower(F.trim(F.concat_ws(" ", "name", "symbol")))
    writes = any_of(said, DB_WRITES) | said.rlike(r"\b(insert|update|delete)\b")
    found = steps.filter((said != "") & ~declares_route(said) & writes)
    return found.select("flow_id", "ord", F.lit("database").alias("kind"), F.lit("database").alias("name"), F.lit("write").alias("action"), "file", "repo", F.lit("inferred").alias("status"))


def python_steps(selected: DataFrame, files: DataFrame) -> DataFrame:
    """Steps of selected Python handlers."""
    source = files.select("repo", F.col("path").alias("file"), "text").filter(F.col("file").endswith(".py"))
    found = tables.handler_steps(selected.select("flow_id", "repo", "file", "handler", "method").join(source, ["repo", "file"]).drop("flow_id"))
    return selected.select("flow_id", "repo", "file", "handler").join(found, ["repo", "file", "handler"]).select("flow_id", F.col("seq").alias("ord"), "kind", "name", F.col("handler").alias("symbol"), "file", "repo")


def _signalled(functions: DataFrame, *keep: str) -> DataFrame:
    """Statements of functions (keep…, repo, path, name, start_line, end_line, text) with their signals and kinds: ``index, text, signals, kind_hint``."""
    said = tables.body_statements(functions.select("repo", "path", "name", "start_line", "end_line", "text").distinct())
    signals = kinds.statement_signals(F.col("statement"))
    rows = said.select("repo", "path", "name", F.col("pos").alias("index"), F.col("statement").alias("text"), signals.alias("signals"))
    rows = rows.withColumn("kind_hint", kinds.statement_kind(F.col("text"), F.col("signals")))
    return functions.select(*keep, "repo", "path", "name").distinct().join(rows, ["repo", "path", "name"])


def handler_statements(selected: DataFrame, files: DataFrame, facts: DataFrame, declared: DataFrame) -> DataFrame:
    """Statements of selected handlers in scripts: ``flow_id, handler, repo, path, index, text, signals, kind_hint``; of the function that the handler resolves to."""
    where = discovery.resolve_handlers(selected, declared, facts.filter("kind = 'import'")).filter("status = 'resolved'")
    found = _bodies(where, files, declared).withColumnRenamed("handler", "_handler")
    flows = selected.select("flow_id", "repo", "file", F.col("handler").alias("_handler"))
    functions = found.join(flows, ["repo", "file", "_handler"])
    return _signalled(functions, "flow_id", "_handler").withColumnRenamed("_handler", "handler")


def _bodies(where: DataFrame, files: DataFrame, declared: DataFrame) -> DataFrame:
    """Where handlers (repo, file, handler, target_file, start_line) are implemented, with their spans and texts."""
    spans = declared.select("repo", F.col("path").alias("target_file"), "start_line", "end_line", "name").distinct()
    text = files.select("repo", F.col("path").alias("target_file"), "text")
    return where.join(spans, ["repo", "target_file", "start_line"]).join(text, ["repo", "target_file"]).withColumn("path", F.col("target_file"))


def script_steps(statements: DataFrame) -> DataFrame:
    """Steps of handlers in scripts: their statements."""
    kind = kinds.step_kind(F.col("kind_hint"), F.col("signals"), F.col("text"))
    return statements.select("flow_id", F.col("index").alias("ord"), kind.alias("kind"), F.col("text").alias("name"), F.col("handler").alias("symbol"), F.col("path").alias("file"), "repo")


def follow_calls(selected: DataFrame, statements: DataFrame, files: DataFrame, facts: DataFrame, declared: DataFrame, budgets: follow.Budgets = follow.Budgets()) -> tuple[DataFrame, DataFrame]:
    """What becomes of the calls in handlers, and the layers: see :func:`routeloom.operators.follow.follow` and :func:`~routeloom.operators.follow.layered_steps`.

    A call is resolved like a handler, but that of several symbols of its name one may be preferred.
    """
    own = statements.withColumnRenamed("flow_id", "endpoint_id").withColumn("file", F.col("path"))
    calls = cut(follow.calls_of(own))
    asked = calls.select("endpoint_id", F.col("file"), F.col("call").alias("handler")).join(own.select("endpoint_id", "repo").distinct(), "endpoint_id")
    where = cut(discovery.resolve_handlers(asked, declared, facts.filter("kind = 'import'"), break_ties=True))
    there = _bodies(where.filter("status = 'resolved'"), files, declared)
    inner = cut(_signalled(there, "file", "handler"))
    lists = inner.groupBy("repo", "file", "handler").agg(F.array_sort(F.collect_list(F.struct("index", "text", "signals"))).alias("statements"))
    bodies = asked.distinct().join(where, ["repo", "file", "handler"]).join(lists, ["repo", "file", "handler"], "left").select(
        "endpoint_id", F.col("handler").alias("call"), F.when(F.col("status") == "resolved", F.col("target_file")).alias("target_file"), F.when(F.col("status") == "resolved", F.col("handler")).alias("target"), "statements",
        F.when(F.col("status") == "ambiguous", "ambiguous").alias("reason"),
    )
    primary = own.groupBy("endpoint_id", "file", "handler").agg(F.count(F.lit(1)).cast("int").alias("steps"))
    went = cut(follow.follow(calls, bodies, primary, budgets))
    callee = asked.distinct().join(inner, ["repo", "file", "handler"]).select("endpoint_id", F.col("handler").alias("target"), "index", "kind_hint", "text", "signals")
    endpoints = selected.select(F.col("flow_id").alias("endpoint_id"), "method", "path", "handler")
    return went, follow.layered_steps(endpoints, own.select("endpoint_id", "index", "kind_hint", "text", "signals"), went, callee)


def trace(files: DataFrame, path: str, method: str | None = None) -> Trace:
    """Trace one request over ``files`` (repo, path, text) of any number of repositories.

    What several relations are made of is cut from its lineage, so that no file is parsed more than once for each kind of fact.
    """
    routes = cut(discovery.discover(files))
    endpoint = relational.match_target(routes.withColumn("ord", F.struct("repo", "method", "path", "file", "handler")), path, method)
    selected = cut(endpoint.filter("rank = 1").withColumn("flow_id", F.lit(1).cast("long")))
    facts, declared = cut(tables.route_facts(files)), cut(tables.js_symbols(files))
    statements = cut(handler_statements(selected, files, facts, declared))
    steps = cut(python_steps(selected, files).unionByName(script_steps(statements)))
    followed, layers = follow_calls(selected, statements, files, facts, declared)
    layers = cut(layers)
    no_sinks = steps.sparkSession.createDataFrame([], "flow_id long, ord long, kind string, name string, action string, file string, repo string, status string")
    sinks = relational.merge_sinks(no_sinks, derive_sinks(steps))

    own = selected.select("repo", F.col("file").alias("path"))
    seen = files.join(own.unionByName(steps.select("repo", F.col("file").alias("path"))).distinct(), ["repo", "path"], "left_semi")
    calls = tables.outbound_calls(seen).select(F.xxhash64("repo", "path", "pos").alias("call_id"), "repo", "method", F.col("target_path").alias("path"), "service", "confidence")
    others = routes.join(own.select("repo").distinct(), "repo", "left_anti").withColumn("ord", F.row_number().over(Window.partitionBy("repo", "file").orderBy("method", "path", "handler")).cast("long"))
    links = relational.link_calls(calls.drop("repo"), others)

    counted = selected.select("flow_id", "method", "path", "handler", "file", "repo", F.col("confidence").alias("endpoint_confidence"))
    strong = grounding.has_strong_evidence(F.col("symbol"), F.array().cast(EVIDENCE))
    of_steps = steps.groupBy("flow_id").agg(F.count(F.lit(1)).alias("steps"), F.count_if(strong).alias("grounded_steps"), F.count_if(~strong).alias("weak_steps"))
    of_sinks = sinks.groupBy("flow_id").agg(F.count(F.lit(1)).alias("sinks"))
    of_layers = followed.filter("outcome = 'followed'").groupBy(F.col("endpoint_id").alias("flow_id")).agg(F.count(F.lit(1)).alias("followed"))
    of_links = links.agg(F.count_if(F.col("target_id").isNotNull()).alias("linked")).withColumn("flow_id", F.lit(1).cast("long"))  # a trace has one flow
    for df in (of_steps, of_sinks, of_layers, of_links):
        counted = counted.join(df, "flow_id", "left")
    counted = counted.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("steps", "grounded_steps", "weak_steps", "sinks", "followed", "linked")})
    facts_row = counted.withColumns({
        "selected": F.lit(True), "has_method_path": F.col("method").isNotNull() & F.col("path").isNotNull(), "has_handler": F.col("handler").isNotNull(), "has_file": F.col("file").isNotNull(), "has_repo": F.col("repo").isNotNull(),
        "dropped_steps": F.lit(False), "edges": F.col("steps") + F.col("sinks") + F.col("linked"),
    })
    summary = facts_row.select("method", "path", "handler", "file", "repo", "steps", "sinks", "followed", "linked", scores.trace_confidence(facts_row).alias("confidence"))
    return Trace(endpoint, steps, sinks, links, followed, layers, follow.next_steps(layers), summary)
