"""API contracts of routes: scaffolds, overridden section by section by what source text shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routeloom.functions import kinds, routes
from routeloom.operators.scores import contract_confidence

_FIELD = "struct<name:string,type:string,required:boolean>"


def scaffold(endpoints: DataFrame) -> DataFrame:
    """``endpoints`` with ``path_params, body, statuses, contract_confidence`` that method and path alone suggest."""
    names = routes.path_parameters(F.coalesce("path", F.lit("")))
    typed = F.transform(names, lambda n: F.struct(
        n.alias("name"),
        F.when(F.regexp_like(F.col("path"), F.concat(F.lit("<(int|integer):"), n, F.lit(">"))), "integer")
        .when(F.regexp_like(F.col("path"), F.concat(F.lit("<(float|number|double|decimal):"), n, F.lit(">"))), "number").otherwise("string").alias("type"),
        F.lit(True).alias("required"),
    ))
    writes = F.upper(F.coalesce("method", F.lit(""))).isin("POST", "PUT", "PATCH")
    return endpoints.withColumns({
        "path_params": typed, "body": F.when(writes, F.array().cast(f"array<{_FIELD}>")), "statuses": F.array(kinds.default_status(F.col("method"))), "contract_confidence": F.lit("low"),
    })


def from_source(contracts: DataFrame, fields: DataFrame, answers: DataFrame) -> DataFrame:
    """Contracts (endpoint_id, …) with what their handlers read and answer, section by section: a section that source text shows takes the place of the scaffold's.

    ``fields``: endpoint_id, place, name, type, required; ``answers``: endpoint_id, status. Adds ``query_params`` and ``headers``; a guard counts as a header.
    """
    place = F.when(F.col("place") == "auth", "header").otherwise(F.col("place"))
    one = F.struct("name", "type", "required")
    listed = fields.withColumn("_place", place).groupBy("endpoint_id").agg(*[F.array_sort(F.collect_set(F.when(F.col("_place") == p, one))).alias(f"_{p}") for p in ("body", "query", "header")])
    statuses = answers.groupBy("endpoint_id").agg(F.array_sort(F.collect_set("status")).alias("_statuses"))
    rows = contracts.join(listed, "endpoint_id", "left").join(statuses, "endpoint_id", "left")
    none = F.array().cast(f"array<{_FIELD}>")
    shown = lambda c, other: F.when(F.size(c) > 0, F.col(c)).otherwise(other)
    return rows.withColumns({
        "body": shown("_body", F.col("body")), "query_params": shown("_query", none), "headers": shown("_header", none), "statuses": shown("_statuses", F.col("statuses")),
    }).drop("_body", "_query", "_header", "_statuses")


def body_fields_of(statements: Column) -> Column:
    """Fields that statements read from a request body, each once; ``body['x']`` and ``req.body.x`` are required, ``get('x')`` is not."""
    code = F.array_join(statements, "\n")
    must = F.concat(F.regexp_extract_all(code, F.lit(r"""\b(?:data|payload|body)\[\s*['"](\w+)['"]"""), F.lit(1)), F.regexp_extract_all(code, F.lit(r"\breq(?:uest)?\.body\.(\w+)"), F.lit(1)))
    may = F.regexp_extract_all(code, F.lit(r"""\b(?:data|payload|body)\.get\(\s*['"](\w+)['"]"""), F.lit(1))
    return F.transform(F.array_distinct(F.concat(must, may)), lambda n: F.struct(n.alias("name"), kinds.property_type(n)["type"].alias("type"), F.array_contains(must, n).alias("required")))


def explicit_statuses_of(statements: Column) -> Column:
    code = F.array_join(statements, "\n")
    return F.array_sort(F.array_distinct(F.concat(
        F.regexp_extract_all(code, F.lit(r"\bres\s*\.\s*status\(\s*(\d{3})"), F.lit(1)), F.regexp_extract_all(code, F.lit(r"\babort\(\s*(\d{3})"), F.lit(1)),
        F.regexp_extract_all(code, F.lit(r"status_code\s*=\s*(\d{3})"), F.lit(1)),
    )))


def enrich(contracts: DataFrame, statements: DataFrame) -> DataFrame:
    """Contracts with what handlers do: ``statements`` (endpoint_id, statements). Explicit statuses replace all defaults; fields add to the body."""
    found = statements.select("endpoint_id", body_fields_of(F.col("statements")).alias("_fields"), explicit_statuses_of(F.col("statements")).alias("_statuses"), F.array_join("statements", "\n").contains("ServerResponse").alias("_wrapped"))
    rows = contracts.join(found, "endpoint_id", "left")
    fields, statuses = F.coalesce("_fields", F.array().cast(f"array<{_FIELD}>")), F.coalesce("_statuses", F.array().cast("array<string>"))
    return rows.withColumns({
        "contract_confidence": contract_confidence(F.col("contract_confidence"), F.size(fields), F.size(statuses), F.coalesce("_wrapped", F.lit(False))),
        "body": F.when(F.size(fields) > 0, fields).otherwise(F.col("body")), "statuses": F.when(F.size(statuses) > 0, statuses).otherwise(F.col("statuses")),
    }).drop("_fields", "_statuses", "_wrapped")


def merge_fields(base: Column, extra: Column) -> Column:
    """Fields (name, type, grounding, origin, source_expr) of two artifacts by name: a grounded one beats an inferred one; unknown types and null expressions are filled; origins add up."""
    at = lambda arr, n: F.try_element_at(F.filter(arr, lambda y: y["name"] == n), F.lit(1))

    def both(x: Column) -> Column:
        o = at(extra, x["name"])
        wins = F.coalesce((o["grounding"] == "grounded") & (x["grounding"] != "grounded"), F.lit(False))
        known = F.when(wins, F.coalesce(F.nullif(o["type"], F.lit("unknown")), x["type"])).otherwise(F.coalesce(F.nullif(x["type"], F.lit("unknown")), o["type"], x["type"]))
        origin = F.array_join(F.array_distinct(F.concat(F.split(x["origin"], r"\+"), F.coalesce(F.split(o["origin"], r"\+"), F.array().cast("array<string>")))), "+")
        return F.struct(x["name"].alias("name"), known.alias("type"), F.when(wins, o["grounding"]).otherwise(x["grounding"]).alias("grounding"), origin.alias("origin"), F.coalesce(F.when(wins, o["source_expr"]), x["source_expr"], o["source_expr"]).alias("source_expr"))

    names = F.transform(base, lambda x: x["name"])
    return F.concat(F.transform(base, both), F.filter(extra, lambda y: ~F.array_contains(names, y["name"])))


def match_contract(routes_df: DataFrame, contracts: DataFrame) -> DataFrame:
    """Each route (route_id, method, path) with its contract (contract_ord): same method and path identity, else the first of the path."""
    key = lambda df, n: df.select("*", routes.path_identity(F.col("path")).alias("_key"), routes.method(F.col("method")).alias(n))
    # the first contract of each path and method, and of each path: a route meets one row of each
    firsts = key(contracts, "_rm").groupBy("_key", "_rm").agg(F.min("contract_ord").alias("_exact")).filter("_key IS NOT NULL")
    anys = firsts.groupBy("_key").agg(F.min("_exact").alias("_any"))
    hits = key(routes_df, "_rm").select("route_id", "_key", "_rm").join(anys, "_key", "left").join(firsts.filter("_rm IS NOT NULL"), ["_key", "_rm"], "left")
    best = hits.groupBy("route_id").agg(F.min("_exact").alias("_exact"), F.min("_any").alias("_any"))
    return best.select("route_id", F.coalesce("_exact", "_any").alias("contract_ord"), F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_any").isNotNull(), "path_only").alias("match"))


def uncovered_statuses(contracts: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Statuses that scenarios expect of an endpoint, and that its contract does not have."""
    has = contracts.select("endpoint_id", F.explode("statuses").alias("status"))
    return scenarios.select("endpoint_id", "status").filter("status IS NOT NULL").distinct().join(has, ["endpoint_id", "status"], "left_anti")
