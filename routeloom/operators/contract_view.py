"""Contract views: facts of several artifacts about a route, merged, each with where it comes from and how well it is grounded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routeloom.functions import routes
from routeloom.functions.kinds import chain
from routeloom.operators.relational import first_per_key
from routeloom.operators.scores import grounding_label

# How artifacts rank, and labels of evidence by its kind.
ARTIFACTS = ("layered_trace_contract", "handler_body_slices", "trace_result", "api_contract", "llm_contract_refinement")
EVIDENCE_LABELS = {
    "request_input": "Reads request body fields", "database_write": "Database write", "database_read": "Database read", "response": "Response evidence",
}
_TABLE = r"[`\"']?([A-Za-z_]\w*)"


def side_effect(said: Column) -> Column:
    """``struct(kind, operation, target)`` of a sink, from its kind, operation and name: an SQL statement's verb and table, else what the words tell."""
    low = F.lower(said)
    write = F.upper(F.regexp_extract(said, r"(?i)\b(insert\s+into|update|delete\s+from)\s+" + _TABLE, 1))
    table = routes.blank_to_null(F.regexp_extract(said, r"(?i)\b(?:insert\s+into|update|delete\s+from)\s+" + _TABLE, 1))
    read = routes.blank_to_null(F.regexp_extract(said, r"(?is)\bselect\b.*?\bfrom\s+" + _TABLE, 1))
    kind = chain([(table.isNotNull(), "database_write"), (read.isNotNull(), "database_read"), (low.contains("database"), "database_write")], "side_effect")
    verb = F.when(table.isNotNull(), F.regexp_extract(write, r"^(\w+)", 1)).when(read.isNotNull(), "SELECT")
    return F.struct(kind.alias("kind"), verb.alias("operation"), F.coalesce(table, read).alias("target"))


def side_effects(sinks: DataFrame) -> DataFrame:
    """``route_id, kind, operation, target, label, confidence, ord``: what a route does beside answering, once for each kind, operation and target.

    ``sinks``: route_id, ord, kind, operation, name.
    """
    rows = sinks.withColumn("s", side_effect(F.concat_ws(" ", "kind", "operation", "name")))
    label = F.when(F.col("s.target").isNotNull(), F.concat_ws(" ", F.replace(F.col("s.kind"), F.lit("_"), F.lit(" ")), F.col("s.target"))).otherwise(F.coalesce(F.nullif("name", F.lit("")), F.lit("Side effect")))
    shown = rows.select(
        "route_id", "ord", "s.kind", "s.operation", "s.target", F.concat(F.upper(F.substring(label, 1, 1)), F.substring(label, 2, 10_000)).alias("label"),
        F.when(F.col("s.kind").isin("database_write", "database_read"), "high").otherwise("medium").alias("confidence"),
    )
    return first_per_key(shown, ["route_id", "kind", F.coalesce("operation", F.lit("")), F.coalesce("target", F.lit(""))], F.col("ord"))


def attach_evidence(fields: DataFrame, evidence: DataFrame) -> DataFrame:
    """``route_id, field, kind, evidence``: for each field the pieces whose snippet holds one of its expressions, each once, in order.

    ``fields``: route_id, field, kind, exprs. ``evidence``: route_id, ord, file, line, snippet. A field meets the evidence of its own route only.
    """
    pairs = fields.join(evidence.select("route_id", "ord", F.struct("file", "line", "snippet").alias("e")), "route_id")
    hits = pairs.filter(F.exists("exprs", lambda x: (x != "") & F.coalesce(F.col("e.snippet"), F.lit("")).contains(x)))
    once = hits.groupBy("route_id", "field", "kind", "e").agg(F.min("ord").alias("ord"))
    found = once.groupBy("route_id", "field", "kind").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "e"))), lambda p: p["e"]).alias("evidence"))
    none = F.array().cast("array<struct<file:string,line:bigint,snippet:string>>")
    return fields.select("route_id", "field", "kind").join(found, ["route_id", "field", "kind"], "left").withColumn("evidence", F.coalesce("evidence", none))


def accepted_refinements(refinements: DataFrame, targets: DataFrame) -> DataFrame:
    """``route_id, accepted, reason``: refinements of contracts (route_id, method, path, error) that are about the route asked for. ``targets``: route_id, method, path."""
    same = (F.upper("r_method") == F.upper("method")) & (routes.unified_path(F.col("r_path")) == routes.unified_path(F.col("path")))
    rows = refinements.select("route_id", F.col("method").alias("r_method"), F.col("path").alias("r_path"), "error").join(targets, "route_id")
    reason = chain([(F.col("error").isNotNull(), F.col("error")), (~F.coalesce(same, F.lit(False)), "endpoint_mismatch")])
    return rows.select("route_id", reason.isNull().alias("accepted"), reason.alias("reason"))


def contract_view(targets: DataFrame, fields: DataFrame, responses: DataFrame, sinks: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row per route: ``route_id, method, path, request, responses, side_effects, grounded, inferred, scaffold, confidence``.

    ``targets``: route_id, method, path. ``fields``: route_id, place (path, query, header, body), field, type, required, artifact, grounding, exprs. ``responses``: route_id, status,
    description, artifact. ``sinks`` and ``evidence``: as above. Of a field said by several artifacts the best grounded one stays, then by rank of the
    artifact; the type is the first that is known, and all artifacts are named. Responses replace each other by rank.
    """
    rank = lambda c: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, ARTIFACTS)), c), F.lit(0)), F.lit(99))
    firm = lambda c: F.when(c == "grounded", 0).when(c == "inferred", 1).otherwise(2)
    order = F.struct(firm(F.col("grounding")).alias("g"), rank(F.col("artifact")).alias("r"))
    known = F.when(F.coalesce("type", F.lit("unknown")) != "unknown", order)
    merged = fields.groupBy("route_id", "place", "field").agg(
        F.min_by("grounding", order).alias("grounding"), F.coalesce(F.min_by("type", known), F.lit("unknown")).alias("type"), F.max("required").alias("required"),
        F.array_sort(F.collect_set("artifact")).alias("artifacts"), F.array_distinct(F.flatten(F.collect_set("exprs"))).alias("exprs"),
    )
    shown = attach_evidence(merged.select("route_id", "field", F.col("place").alias("kind"), "exprs"), evidence).withColumnRenamed("kind", "place")
    full = merged.join(shown, ["route_id", "place", "field"]).groupBy("route_id").agg(
        F.array_sort(F.collect_list(F.struct("place", "field", "type", "required", "grounding", "artifacts", F.size("evidence").alias("evidence")))).alias("request"),
        *[F.count_if(F.col("grounding") == g).alias(g) for g in ("grounded", "inferred", "scaffold")],
    )
    scaffolded = F.col("description").startswith("Default ")
    replies = first_per_key(responses, ["route_id", "status"], rank(F.col("artifact"))).groupBy("route_id").agg(
        F.array_sort(F.collect_list(F.struct("status", "description", F.when(scaffolded, "scaffold").otherwise("inferred").alias("grounding")))).alias("responses"),
        F.count_if(~F.coalesce(scaffolded, F.lit(False))).alias("_inferred"), F.count_if(scaffolded).alias("_scaffold"),
    )
    effects = side_effects(sinks).groupBy("route_id").agg(F.array_sort(F.collect_list(F.struct("kind", "operation", "target", "label"))).alias("side_effects"), F.count(F.lit(1)).alias("_effects"))
    n = lambda *cols: sum((F.coalesce(c, F.lit(0)) for c in cols), F.lit(0)).cast("long")
    named = F.when(F.col("method").isNotNull() | F.col("path").isNotNull(), 1).otherwise(0)
    out = targets.join(full, "route_id", "left").join(replies, "route_id", "left").join(effects, "route_id", "left").withColumns({
        "grounded": n("grounded", "_effects") + named, "inferred": n("inferred", "_inferred"), "scaffold": n("scaffold", "_scaffold"),
    })
    return out.withColumn("confidence", grounding_label(F.col("grounded"), F.col("inferred"), F.col("scaffold"))).select(
        "route_id", "method", "path", "request", "responses", "side_effects", "grounded", "inferred", "scaffold", "confidence"
    )
