"""What models tell of tests, summaries and contracts, held against what is known; and flows merged from code and from models."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routeloom.functions import kinds, routes, text
from routeloom.functions.kinds import any_of, chain
from routeloom.operators.grounding import text_field, text_list, told_sinks, told_steps
from routeloom.operators.relational import first_per_key, merge_sinks

# Categories whose scenarios are about sinks, and priorities of calls.
SINK_CATEGORIES = ("database", "cache", "external_api", "queue_event", "side_effect")
PRIORITIES = ("high", "medium", "low")
#: Risks kept of a summary.
MAX_RISKS = 8


# --- scenarios -------------------------------------------------------------------------------------------


def _said(*cols: Column) -> Column:
    return F.lower(F.concat_ws(" ", *cols))


def has_body_ref(field: Column, refs: Column, name: Column, summary: Column, purpose: Column, words: tuple[str, ...]) -> Column:
    """Whether a scenario refers to a field of the body and speaks of one of ``words``."""
    return F.array_contains(refs, F.concat(F.lit("request.body."), field)) & any_of(_said(name, summary, purpose), words)


def is_malformed_json(name: Column, summary: Column) -> Column:
    said = _said(name, summary)
    return said.contains("malformed") & said.contains("json")


def checks_response_schema(status: Column, refs: Column, schema_ref: Column) -> Column:
    ref = F.concat(F.lit("responses."), status)
    return F.coalesce(F.array_contains(refs, ref) & (schema_ref == ref), F.lit(False))


def is_field_validation(category: Column, refs: Column) -> Column:
    return (kinds.test_category(category) == "validation") & F.exists(refs, lambda r: r.startswith("request.body."))


def is_sink_scenario(category: Column, related_sinks: Column, side_effects: Column) -> Column:
    return (F.size(related_sinks) > 0) | (F.size(side_effects) > 0) | kinds.test_category(category).isin(*SINK_CATEGORIES)


def told_tests(answers: DataFrame) -> DataFrame:
    """Scenarios in answers (trace_id, method, path, has_contract, answer), an object with ``groups`` of ``tests``: ``trace_id, group_ord, ord, category, name, summary, purpose,
    method, path, priority, status, contract_refs, related_steps, related_sinks, dropped``.

    ``dropped`` is why a scenario is not taken: something is missing, it is about another endpoint, its status is no number, or nothing grounds it. Of the ungrounded,
    a positive one stays where there is a contract.
    """
    groups = F.try_variant_get(text.json_payload(F.col("answer")), "$.groups", "array<variant>")
    g = answers.select("trace_id", F.upper("method").alias("_m"), F.col("path").alias("_p"), "has_contract", F.posexplode(groups).alias("group_ord", "g"))
    t = g.select("*", F.posexplode(F.try_variant_get("g", "$.tests", "array<variant>")).alias("ord", "t"))
    item = F.col("t")
    status = F.coalesce(F.try_variant_get(item, "$.expected.status", "string"), F.lit(None).cast("string"))
    evidence = F.size(F.coalesce(F.try_variant_get(item, "$.evidence", "array<variant>"), F.array().cast("array<variant>")))
    rows = t.select(
        "trace_id", "group_ord", "ord", "_m", "_p", "has_contract", "t", text_field(item, "category").alias("category"), text_field(item, "name").alias("name"), text_field(item, "summary").alias("summary"), text_field(item, "purpose").alias("purpose"),
        F.upper(F.coalesce(text_field(item, "method"), text_field(item, "request.method"), "_m")).alias("method"), F.coalesce(text_field(item, "route"), text_field(item, "request.path"), "_p").alias("path"),
        F.coalesce(text_field(item, "priority"), F.lit("medium")).alias("priority"), status.alias("status"), *[text_list(item, c).alias(c) for c in ("contract_refs", "related_steps", "related_sinks")], (evidence > 0).alias("_shown"),
    )
    grounded = (F.size("contract_refs") > 0) | (F.size("related_steps") > 0) | (F.size("related_sinks") > 0) | F.col("_shown")
    positive = F.coalesce("has_contract", F.lit(False)) & (kinds.test_category(F.col("category")) == "positive")
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    dropped = chain([
        (~F.schema_of_variant(item).startswith("OBJECT"), "not an object"),
        (empty("name") | empty("category") | empty("method") | empty("path") | (empty("summary") & empty("purpose")), "missing fields"),
        (~F.coalesce((F.col("method") == F.col("_m")) & (routes.unified_path(F.col("path")) == routes.unified_path(F.col("_p"))), F.lit(False)), "endpoint mismatch"),
        (F.col("status").isNotNull() & ~F.col("status").rlike("^[0-9]+$"), "status is no number"), (~(grounded | positive), "not grounded"),
    ])
    return rows.withColumn("dropped", dropped).withColumns({"summary": F.coalesce("summary", "purpose"), "purpose": F.coalesce("purpose", "summary")}).drop("_m", "_p", "_shown", "has_contract", "t")


def merge_matrices(current: DataFrame, told: DataFrame) -> DataFrame:
    """Scenarios of a matrix (trace_id, group_ord, …), and behind its groups those that were told and taken."""
    columns = [c for c in current.columns if c in told.columns]
    last = current.groupBy("trace_id").agg((F.max("group_ord") + 1).alias("_base"))
    more = told.filter("dropped IS NULL").join(last, "trace_id", "left").withColumn("group_ord", (F.col("group_ord") + F.coalesce("_base", F.lit(0))).cast("int"))
    return current.select(*columns).unionByName(more.select(*columns))


# --- summaries and contracts ------------------------------------------------------------------------------


def told_summaries(answers: DataFrame) -> DataFrame:
    """``trace_id, ord, name, kind, detail, source_step_ids, dropped``: step summaries in answers (trace_id, answer, step_ids) that name steps of the input only."""
    items = F.try_variant_get(text.json_payload(F.col("answer")), "$.step_summaries", "array<variant>")
    rows = answers.select("trace_id", "step_ids", F.posexplode(items).alias("ord", "i"))
    ids, refs = text_list(F.col("i"), "source_step_ids"), text_list(F.col("i"), "evidence_refs")
    known = lambda c: F.forall(c, lambda s: F.array_contains("step_ids", s))
    dropped = chain([
        (~F.schema_of_variant("i").startswith("OBJECT"), "not an object"), (F.size(ids) == 0, "no source steps"), (F.size(refs) == 0, "no evidence"),
        (~known(ids), "unknown source steps"), (~known(refs), "unknown evidence"),
    ])
    return rows.select("trace_id", "ord", *[F.coalesce(F.trim(text_field(F.col("i"), c)), F.lit("")).alias(c) for c in ("name", "kind", "detail")], ids.alias("source_step_ids"), dropped.alias("dropped"))


def told_calls(answers: DataFrame) -> DataFrame:
    """``trace_id, ord, call, reason, priority, should_follow``: ranked calls in answers (trace_id, answer, calls) that are among the candidates."""
    items = F.try_variant_get(text.json_payload(F.col("answer")), "$.ranked_follow_calls", "array<variant>")
    rows = answers.select("trace_id", "calls", F.posexplode(items).alias("ord", "i")).withColumn("call", text_field(F.col("i"), "call"))
    priority = F.lower(F.coalesce(text_field(F.col("i"), "priority"), F.lit("low")))
    return rows.filter(F.array_contains("calls", F.col("call"))).select(
        "trace_id", "ord", "call", F.coalesce(F.trim(text_field(F.col("i"), "reason")), F.lit("")).alias("reason"), F.when(priority.isin(*PRIORITIES), priority).otherwise("low").alias("priority"),
        F.coalesce(F.try_variant_get("i", "$.should_follow", "boolean"), F.lit(False)).alias("should_follow"),
    )


def refined_contracts(answers: DataFrame) -> DataFrame:
    """``route_id, method, path, confidence, body, dropped``: refined contracts in answers (route_id, method, path, answer) that are about their endpoint."""
    body = text.json_payload(F.col("answer"))
    method, path = F.upper(F.coalesce(text_field(body, "method"), "method")), F.coalesce(text_field(body, "path"), "path")
    dropped = chain([
        (~F.coalesce(F.schema_of_variant(body).startswith("OBJECT"), F.lit(False)), "not an object"),
        (~F.coalesce((method == F.upper("method")) & (routes.unified_path(path) == routes.unified_path(F.col("path"))), F.lit(False)), "endpoint_mismatch"),
    ])
    return answers.select("route_id", "method", "path", F.coalesce(text_field(body, "confidence"), F.lit("medium")).alias("confidence"), body.cast("string").alias("body"), dropped.alias("dropped"))


# --- flows ---------------------------------------------------------------------------------------------------


def expand_flows(baseline: DataFrame, answers: DataFrame, derive: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Steps and sinks of flows (``derive`` makes sinks of steps): those that code shows (flow_id, ord, kind, name, symbol, file, repo), then those that models tell and that hold; a step of one
    kind, name, symbol, file and repository counts once, a sink as in :func:`routeloom.operators.relational.merge_sinks`."""
    columns = ["flow_id", "ord", "kind", "name", "symbol", "file", "repo"]
    told = told_steps(answers).filter("dropped IS NULL").withColumn("ord", F.col("ord") + F.lit(1 << 20))
    blank = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    every = baseline.select(*columns).unionByName(told.select(*columns))
    steps = first_per_key(every, ["flow_id", *[blank(c) for c in columns[2:]]], F.col("ord"))
    said = told_sinks(answers).filter("dropped IS NULL").select("flow_id", "ord", "kind", "name", "action", "file", "repo", "status")
    return steps, merge_sinks(said, derive(steps))


# --- prompts ----------------------------------------------------------------------------------------------------

# Characters that a prompt may have.
PROMPT_CHARS = {"planner": 12_000, "summary": 12_000, "refinement": 14_000, "tests": 14_000}
TASKS = {
    "planner": "Say how this repository declares, groups and mounts its HTTP routes. Name only what is shown. Answer with JSON only.",
    "flow": "List the steps and sinks of the handler below in the order they run. Leave out what the code does not show. Answer with JSON only: {\"steps\": [...], \"sinks\": [...], \"confidence\"}.",
    "summary": "Summarise these steps and rank the calls worth following. Refer to steps by their ids only. Answer with JSON only.",
    "refinement": "Refine this contract by the evidence given. Keep its method and path. Answer with JSON only.",
    "tests": "Propose integration tests for this endpoint, grouped by category, each with what grounds it. Answer with JSON only: {\"groups\": [...]}.",
}


def prompt(task: str, lists: dict[str, Column], rest: Column | None = None, steps: tuple[float, ...] = (1.0, 0.5, 0.25, 0.1, 0.0)) -> Column:
    """A prompt: the task, and JSON of lists that are cut to a share of their elements until it is short enough for :data:`PROMPT_CHARS`."""
    limit = PROMPT_CHARS.get(task)

    def made(share: float) -> Column:
        cut = [F.slice(c, F.lit(1), F.ceil(F.size(c) * F.lit(share)).cast("int")).alias(k) for k, c in lists.items()]
        return F.concat(F.lit(TASKS[task] + "\n"), F.to_json(F.struct(*cut, *([rest.alias("context")] if rest is not None else []))))

    if limit is None:
        return made(1.0)
    *tries, last = [made(s) for s in steps]
    return reduce(lambda later, p: F.when(F.length(p) <= limit, p).otherwise(later), reversed(tries), text.truncate(last, limit))

