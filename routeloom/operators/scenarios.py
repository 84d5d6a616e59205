"""Test scenarios of endpoints, from a table of rules.

A rule is a condition on an endpoint's facts and a template. All rules are tried within the endpoint's row, so there is no
join and no shuffle: an endpoint's scenarios are an array, cut to the cap in order of category.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routeloom.functions import kinds, routes

#: Order in which categories fill the cap.
CATEGORY_ORDER = ("happy_path", "data_shape", "failure_modes", "validation", "persistence", "side_effects", "state_consistency", "edge_cases")
#: Scenarios of an endpoint, at most.
MAX_SCENARIOS = 7

# Fixed values: (category, condition, name, summary, expectation, what is expected, target). Conditions are over the facts
# post, get, update, delete, id_param, db_write, db_read, db_add, db_commit, external, queue, cross_repo, auth, validated, unique, fetchable.
RULES = [
    ("happy_path", "post", "creates_resource", "verifies {m} {r} creates a new {e} and returns success", "http_response", "request succeeds with expected response", None),
    ("data_shape", "post", "returns_created_entity_shape", "verifies {m} {r} returns created {e} data with expected fields", "data_shape", "created {e} response includes id and expected fields", None),
    ("validation", "post", "rejects_missing_required_field", "verifies {m} {r} rejects missing required fields", "validation", "missing required field is rejected", None),
    ("validation", "post", "rejects_invalid_payload", "verifies {m} {r} rejects invalid payloads", "validation", "invalid payload is rejected", None),
    ("validation", "post AND unique", "rejects_duplicate_{u}", "verifies {m} {r} rejects duplicate {v} values", "validation", "duplicate {v} value is rejected", None),
    ("persistence", "post AND db_write", "writes_to_database", "verifies {m} {r} causes a database write", "side_effect", "database write occurs", "database"),
    ("failure_modes", "post AND db_write AND db_commit", "database_commit_failure_handled", "verifies {m} {r} handles database commit failures safely", "failure_mode", "database commit failure is handled safely", "database"),
    ("state_consistency", "post AND fetchable", "create_then_fetch_consistent", "verifies created {e} is retrievable in a follow-up fetch", "state_consistency", "create followed by fetch returns consistent state", None),
    ("happy_path", "get AND NOT external", "returns_entity_or_list", "verifies {m} {r} returns the expected entity/list response", "http_response", "response returns entity/list data", None),
    ("happy_path", "get AND external AND NOT cross_repo", "proxies_downstream_response", "verifies {m} {r} returns {w} from a downstream service call", "http_response", "response returns entity/list data", None),
    ("happy_path", "get AND external AND cross_repo", "proxies_downstream_response", "verifies {m} {r} returns {w} from the linked downstream service", "http_response", "response returns entity/list data", None),
    ("edge_cases", "get AND id_param", "returns_not_found_for_missing_resource", "verifies {m} {r} handles not-found resources", "edge_case", "not found case is handled correctly", None),
    ("edge_cases", "get AND NOT id_param AND NOT external", "handles_empty_result_set", "verifies {m} {r} safely handles empty result sets", "edge_case", "empty list/result is handled safely", None),
    ("data_shape", "get AND NOT id_param", "returns_expected_response_shape", "verifies {m} {r} response schema/shape remains stable", "data_shape", "response shape remains valid for collection output", None),
    ("validation", "get AND id_param", "rejects_invalid_path_param", "verifies {m} {r} rejects invalid path parameter values", "validation", "invalid id/path parameter is rejected", None),
    ("failure_modes", "get AND db_read", "database_read_failure_handled", "verifies {m} {r} handles database read failures safely", "failure_mode", "database read failure is handled safely", "database"),
    ("happy_path", "update", "updates_resource", "verifies {m} {r} updates the target {e}", "http_response", "update request succeeds", None),
    ("validation", "update", "rejects_invalid_payload", "verifies {m} {r} rejects invalid payloads", "validation", "invalid payload is rejected", None),
    ("state_consistency", "update", "update_then_fetch_consistent", "verifies updated {e} is returned in follow-up fetch", "state_consistency", "update followed by fetch returns the latest persisted state", None),
    ("happy_path", "delete", "deletes_resource", "verifies {m} {r} deletes the target {e}", "http_response", "delete request succeeds", None),
    ("state_consistency", "delete", "deleted_resource_not_returned", "verifies deleted {e} is no longer returned by follow-up fetch", "state_consistency", "deleted resource is not returned after deletion", None),
    ("failure_modes", "external", "downstream_unavailable", "verifies {m} {r} handles downstream service unavailability", "failure_mode", "downstream connection failure is handled safely", "external_api"),
    ("failure_modes", "external", "downstream_timeout", "verifies {m} {r} handles downstream timeout safely", "failure_mode", "downstream timeout is handled safely", "external_api"),
    ("data_shape", "external", "downstream_empty_payload_handled", "verifies {m} {r} safely handles empty downstream payloads", "data_shape", "empty downstream entity/list is handled safely", "external_api"),
    ("data_shape", "external", "downstream_malformed_payload_handled", "verifies {m} {r} safely handles malformed downstream payloads", "data_shape", "malformed downstream payload is handled safely", "external_api"),
    ("data_shape", "cross_repo", "cross_service_contract_compatible", "verifies {m} {r} response remains compatible with linked downstream service contract", "contract", "cross-service response contract remains compatible", "cross_repo"),
    ("failure_modes", "db_write", "database_write_failure_handled", "verifies {m} {r} handles database write failures safely", "failure_mode", "database write failure is handled safely", "database"),
    ("persistence", "db_write", "write_path_is_idempotent", "verifies repeated {m} {r} calls preserve safe state semantics", "state_consistency", "repeated write calls do not corrupt state", "database"),
    ("persistence", "db_write AND db_add", "write_sequence_persists_entity", "verifies {m} {r} persists {e} through add/commit workflow", "persistence", "entity is persisted after add/commit sequence", "database"),
    ("edge_cases", "db_read", "empty_result_handled", "verifies {m} {r} safely handles empty read results", "edge_case", "empty database read result is handled safely", "database"),
    ("failure_modes", "queue", "queue_publish_failure_handled", "verifies {m} {r} handles queue publish failures safely", "failure_mode", "queue publish failure is handled or retried safely", "queue"),
    ("validation", "auth", "rejects_unauthenticated_requests", "verifies {m} {r} rejects unauthenticated requests", "auth", "unauthenticated request is rejected", None),
    ("validation", "auth", "rejects_unauthorized_requests", "verifies {m} {r} rejects unauthorized requests", "auth", "unauthorized request is rejected", None),
    ("validation", "validated AND NOT post AND NOT update", "rejects_invalid_or_missing_fields", "verifies {m} {r} rejects invalid or missing required fields", "validation", "invalid or missing required fields are rejected", None),
]

FACTS = ("db_write", "db_read", "db_add", "db_commit", "external", "queue", "cross_repo", "auth", "validated", "unique", "explicit_get")


def resource_words(path: Column) -> Column:
    """The last static segment, in words."""
    last = F.try_element_at(F.filter(routes.static_segments(path), lambda s: ~(s.startswith("<") & s.endswith(">"))), F.lit(-1))
    return F.coalesce(F.translate(last, "-_", "  "), F.lit("data"))


def generate_scenarios(endpoints: DataFrame, cap: int = MAX_SCENARIOS) -> DataFrame:
    """``endpoint_id, pos, category, canonical, name, summary, expects, description, target`` for each of an endpoint's scenarios.

    ``endpoints``: endpoint_id, method, path and the facts :data:`FACTS` (null: false). Categories fill the cap in their order, each in order of the rules.
    """
    m = F.upper(F.coalesce("method", F.lit("ANY")))
    rows = endpoints.withColumns({f: F.coalesce(F.col(f), F.lit(False)) for f in FACTS}).withColumns({
        "_m": m, "post": m == "POST", "get": m == "GET", "update": m.isin("PUT", "PATCH"), "delete": m == "DELETE",
        "id_param": routes.has_path_parameter(F.col("path")),
        "fetchable": F.col("explicit_get") | (F.col("db_write") & m.isin("POST", "PUT", "PATCH")),
    })
    words = {
        "{m}": F.col("_m"), "{r}": F.col("path"), "{e}": routes.entity_label(F.col("path")), "{w}": resource_words(F.col("path")),
        "{u}": F.when(F.col("unique_field") == "email", "email").otherwise("unique_field") if "unique_field" in endpoints.columns else F.lit("unique_field"),
        "{v}": F.when(F.col("unique_field") == "email", "email").otherwise("unique field") if "unique_field" in endpoints.columns else F.lit("unique field"),
    }
    fill = lambda t: reduce(lambda c, w: F.replace(c, F.lit(w[0]), w[1]) if w[0] in t else c, words.items(), F.lit(t))
    stem = F.concat(F.lower("_m"), F.lit("_"), routes.route_token(F.col("path")), F.lit("_"))
    made = [
        F.when(
            F.expr(cond),
            F.struct(
                F.lit(CATEGORY_ORDER.index(category)).alias("rank"), F.lit(i).alias("rule"), F.lit(category).alias("category"), F.concat(stem, fill(name)).alias("name"), fill(summary).alias("summary"),
                F.lit(kind).alias("expects"), fill(said).alias("description"), F.lit(target).cast("string").alias("target"),
            ),
        )
        for i, (category, cond, name, summary, kind, said, target) in enumerate(RULES)
    ]
    listed = F.slice(F.array_sort(F.array_compact(F.array(*made))), 1, cap)
    out = rows.select("endpoint_id", F.posexplode(listed).alias("pos", "s")).select("endpoint_id", "pos", "s.*")
    return out.withColumn("canonical", kinds.test_category(F.col("category"))).drop("rank", "rule")


def scenario_quality(df: DataFrame) -> Column:
    """Quality of scenarios with: has_request, status, contract_refs, has_related, purpose, has_side_effects, has_evidence, category, name, summary, method, has_body."""
    on = lambda c, w, other=0: F.when(F.coalesce(c, F.lit(False)), w).otherwise(other)
    said = F.lower(F.concat_ws(" ", "name", "summary"))
    category = kinds.test_category(F.col("category"))
    writes = F.upper(F.coalesce("method", F.lit(""))).isin("POST", "PUT", "PATCH", "DELETE")
    return (
        on(F.col("has_request"), 5) + on(F.col("status").isNotNull(), 5, -5) + on(F.size("contract_refs") > 0, 4) + on(F.col("has_related"), 3) + on(F.col("purpose").isNotNull() & (F.col("purpose") != ""), 3)
        + on(F.col("has_side_effects"), 2) + on(F.col("has_evidence"), 2) + on(category != "edge_case", 2) - on(said.rlike("invalid[ _]payload"), 4) - on(said.rlike("missing[ _]required[ _]field"), 4)
        - on((category == "validation") & writes & ~F.coalesce(F.col("has_body"), F.lit(False)), 3)
    )


def scenario_cap(method: Column, path: Column) -> Column:
    """How many scenarios an endpoint may have."""
    low = F.lower(F.coalesce(path, F.lit("")))
    return F.when(kinds.any_of(low, ("/health", "/ready", "/live", "/ping", "/status")), 2).when(F.upper(F.coalesce(method, F.lit("GET"))).isin("POST", "PUT", "PATCH", "DELETE"), 12).otherwise(8)


#: Validation scenarios that a contract's body gives, and sink scenarios, at most.
MAX_BODY_SCENARIOS, MAX_SINK_SCENARIOS = 5, 4
# Names of response fields that must not be shown.
SENSITIVE = ("password", "token", "secret", "api_key", "password_hash")
_ROW = "array<struct<category:string,name:string,summary:string,priority:string,status:string,contract_ref:string>>"


def contract_scenarios(contracts: DataFrame) -> DataFrame:
    """``endpoint_id, pos, category, name, summary, priority, status, contract_ref``: what a contract asks to be tested, each name once.

    ``contracts``: endpoint_id, method, path, body_fields (array of struct(name, type, format, required)), path_params and query_params (array of struct(name, type, required)),
    has_auth, statuses, response_fields (array of strings), sinks (array of kinds). Nulls count as empty.
    """
    fields = "array<struct<name:string,type:string,format:string,required:boolean>>"
    params = "array<struct<name:string,type:string,required:boolean>>"
    c = lambda name, kind: F.coalesce(F.col(name), F.array().cast(kind))
    body, in_path, query, statuses = c("body_fields", fields), c("path_params", params), c("query_params", params), c("statuses", "array<string>")
    shown, sinks = c("response_fields", "array<string>"), c("sinks", "array<string>")
    m = F.upper(F.coalesce("method", F.lit("ANY")))
    stem = F.concat(F.lower(m), F.lit("_"), routes.route_token(F.col("path")), F.lit("_"))
    target = F.concat_ws(" ", m, F.col("path"))

    def row(category, name, summary, priority, status, ref):
        as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
        return F.struct(
            as_col(category).alias("category"), F.concat(stem, as_col(name)).alias("name"), as_col(summary).alias("summary"), as_col(priority).alias("priority"), as_col(status).cast("string").alias("status"), as_col(ref).cast("string").alias("contract_ref")
        )

    named = lambda pattern, p: F.replace(F.lit(pattern), F.lit("{}"), p["name"])
    ok = F.coalesce(F.try_element_at(F.filter(statuses, lambda s: s.startswith("2")), F.lit(1)), F.lit("200"))
    refers = F.concat(F.lit("responses."), ok)
    writes = m.isin("POST", "PUT", "PATCH", "DELETE")
    happy = F.array(row("positive", "contract_happy_path", F.concat(F.lit("verifies "), target, F.lit(" succeeds with contract-valid request")), F.when(writes, "high").otherwise("medium"), ok, refers))
    missing = F.transform(F.filter(body, lambda p: p["required"]), lambda p: row("validation", named("missing_required_{}", p), named("rejects missing required field `{}`", p), "high", "400", named("request.body.{}", p)))
    typed = F.flatten(F.transform(body, lambda p: F.array_compact(F.array(
        row("validation", named("invalid_type_{}", p), named("rejects invalid type for `{}`", p), "medium", "400", named("request.body.{}", p)),
        F.when(p["format"] == "email", row("validation", named("invalid_email_{}", p), named("rejects invalid email format for `{}`", p), "high", "400", named("request.body.{}", p))),
    ))))
    of_path = F.flatten(F.transform(in_path, lambda p: F.array_compact(F.array(
        F.when(p["type"].isin("integer", "number"), row("validation", named("invalid_path_param_{}", p), named("rejects invalid path parameter `{}`", p), "medium", "400", named("request.path_params.{}", p))),
        F.when((m == "GET") & F.lower(p["name"]).endswith("id"), row("edge_case", named("not_found_for_missing_{}", p), named("returns not found for unknown `{}`", p), "medium", "404", named("request.path_params.{}", p))),
    ))))
    of_query = F.transform(F.filter(query, lambda p: p["required"]), lambda p: row("validation", named("missing_query_{}", p), named("rejects missing required query param `{}`", p), "medium", "400", named("request.query.{}", p)))
    auth = F.when(F.coalesce("has_auth", F.lit(False)), F.array(
        row("auth", "missing_authorization", "rejects missing Authorization header", "high", "401", "request.headers.Authorization"), row("auth", "invalid_authorization", "rejects invalid or expired token", "high", "401", "request.headers.Authorization"),
    )).otherwise(F.array().cast(_ROW))
    leaky = F.exists(shown, lambda f: kinds.any_of(F.lower(f), SENSITIVE))
    schema = F.when(F.array_contains(statuses, ok), F.array(row(F.when(leaky, "security").otherwise("error_handling"), "response_schema_validation", "validates response body shape matches contract", "medium", ok, refers))).otherwise(F.array().cast(_ROW))
    of_sinks = F.slice(F.array_compact(F.array(
        F.when(F.array_contains(sinks, "database"), row("database", "database_failure_handled", "handles database failure without partial write", "high", "500", None)),
        F.when(F.array_contains(sinks, "external_api"), row("external_api", "downstream_timeout_handled", "handles downstream timeout gracefully", "medium", "502", None)),
        F.when(F.array_contains(sinks, "queue"), row("queue_event", "queue_publish_failure_handled", "handles queue publish failure correctly", "high", "500", None)),
    )), 1, MAX_SINK_SCENARIOS)
    every = F.concat(happy, F.slice(F.concat(missing, typed), 1, MAX_BODY_SCENARIOS), of_path, of_query, auth, schema, of_sinks)
    names = F.transform(every, lambda s: F.concat_ws(":", s["category"], s["name"]))
    once = F.filter(every, lambda s, i: F.array_position(names, F.concat_ws(":", s["category"], s["name"])) == i + 1)
    return contracts.select("endpoint_id", F.posexplode(once).alias("pos", "s")).select("endpoint_id", "pos", "s.*")
