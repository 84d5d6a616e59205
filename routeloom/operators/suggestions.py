"""Integration tests that a trace suggests, and what its request body holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routeloom.functions import routes
from routeloom.functions.kinds import any_of, chain
from routeloom.operators.trace_graph import SINK_TYPES, node_text, selected_nodes

# Marks of code that reads a request's body.
BODY_MARKS = (
    "request.get_json(", "request.json", "request.form", "request.data", "request.post", "await request.json(", "req.body", "request.body",
    "ctx.request.body", "await req.json(", "@requestbody", "json.newdecoder(r.body).decode", "io.readall(r.body)",
)
# What suggestions are called and say; {m} method, {r} route, {t} route as a word, {e} entity.
PLAIN_SUMMARY = "validate primary route behavior from inferred flow and sink evidence"
PRIMARY = (  # (condition, name, summary, what is expected beside a response, and of what)
    ("m = 'POST' AND db_write", "creates_record", "verifies {m} {r} persists a new {e} record", ("side_effect", "persists a new {e} record", "database")),
    ("m = 'GET' AND db_read", "returns_retrieved_data", "verifies {m} {r} returns retrieved {e} data", ("behavior", "response includes retrieved entity or list", "database")),
    ("db_write", "writes_to_database", PLAIN_SUMMARY, ("side_effect", "database write occurs", "database")),
    ("db_read", "reads_from_database", PLAIN_SUMMARY, ("behavior", "response reflects retrieved data", "database")),
    ("true", "returns_success", PLAIN_SUMMARY, None),
)
MAX_SUGGESTIONS = 3
_EXPECTS = "array<struct<kind:string,description:string,target:string>>"


def _expected(kind: str, description, target) -> Column:
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(F.lit(kind).alias("kind"), as_column(description).alias("description"), as_column(target).cast("string").alias("target"))


def suggest_tests(facts: DataFrame) -> DataFrame:
    """``trace_id, pos, name, summary, expectations``: up to three tests for each trace, each name once.

    ``facts``: as :func:`routeloom.operators.trace_graph.trace_facts` gives them.
    """
    m = F.upper(F.coalesce("method", F.lit("ANY")))
    entity = routes.entity_label(F.col("path"))
    rows = facts.withColumns({"m": m, "_e": entity, "_stem": F.concat(F.lower(m), F.lit("_"), routes.route_token(F.col("path")), F.lit("_"))})
    e, method, stem = F.col("_e"), F.col("m"), F.col("_stem")

    def fill(words: str) -> Column:
        out = F.lit(words)
        for mark, value in (("{m}", method), ("{r}", F.col("path")), ("{e}", e)):
            out = F.replace(out, F.lit(mark), value) if mark in words else out
        return out

    first = lambda i: chain([(F.expr(p[0]), fill(p[i])) for p in PRIMARY])
    none = F.array().cast(_EXPECTS)
    only = lambda c, x: F.when(F.col(c), F.array(x).cast(_EXPECTS)).otherwise(none)
    own = chain([(F.expr(p[0]), F.array(_expected(p[3][0], fill(p[3][1]), p[3][2])).cast(_EXPECTS) if p[3] else none) for p in PRIMARY])
    response = F.array(_expected("http_response", "request succeeds with expected response", F.concat_ws(" ", method, "path"))).cast(_EXPECTS)
    queue = only("queue", _expected("side_effect", "event/message emission occurs", "queue"))
    external = only("external", _expected("side_effect", "outbound dependency interaction occurs", "external_api"))
    returned = only("returns", _expected("behavior", "response payload reflects returned domain data", "response"))
    made = [F.struct(F.lit(0).alias("n"), F.concat(stem, first(1)).alias("name"), first(2).alias("summary"), F.concat(response, own, returned, queue, external).alias("expectations"))]

    post = method == "POST"
    payload = F.when(post, "response returns created entity data").otherwise("response payload includes expected created or fetched data")
    made.append(F.when(F.col("returns"), F.struct(
        F.lit(1).alias("n"), F.concat(stem, F.when(post, "returns_created_entity").otherwise("returns_response_payload")).alias("name"),
        F.when(post, fill("verifies the response returns created {e} data")).otherwise("validate response body shape from return-like flow steps").alias("summary"),
        F.array(_expected("behavior", payload, None)).cast(_EXPECTS).alias("expectations"),
    )))
    effect = F.when(F.col("db_write"), _expected("side_effect", "database write occurs", "database")).otherwise(_expected("side_effect", "observable side effects occur in dependencies", "integration"))
    made.append(F.when(F.col("db_write") | F.col("queue") | F.col("external"), F.struct(
        F.lit(2).alias("n"), F.concat(stem, F.when(F.col("db_write"), "writes_to_database").otherwise("verifies_side_effects")).alias("name"),
        F.lit("validate major side effects inferred from sink semantics").alias("summary"), F.concat(F.array(effect).cast(_EXPECTS), queue, external).alias("expectations"),
    )))
    listed = F.filter(F.array(*made), lambda s: s.isNotNull())
    names = F.transform(listed, lambda s: F.lower(s["name"]))
    once = F.slice(F.filter(listed, lambda s, i: F.array_position(names, F.lower(s["name"])) == i + 1), 1, MAX_SUGGESTIONS)
    return rows.select("trace_id", F.posexplode(once).alias("pos", "s")).select("trace_id", "pos", "s.name", "s.summary", "s.expectations")


def _fields(snippet: Column, pattern: str, kind: str, required: bool) -> Column:
    names = F.regexp_extract_all(snippet, F.lit(pattern), F.lit(1))
    return F.transform(names, lambda n: F.struct(n.alias("name"), F.lit(kind).alias("type"), F.lit(required).alias("required")))


def body_signals(targets: DataFrame, nodes: DataFrame, flow_steps: DataFrame, models: DataFrame, payloads: DataFrame) -> DataFrame:
    """``trace_id, consumed, fields``: whether a request has a body, and its fields (name, type, required, by name).

    ``targets``: trace_id, method, path. ``models`` (model, field, type) of classes, of which one field counts once; ``payloads`` (method, path, field, type) of requests in tests.
    A model's field comes first, then what the flow reads, ``data['x']`` as required; tests fill in what is missing or unknown.
    """
    flow = selected_nodes(flow_steps, nodes)
    kind = F.lower(routes.strip(F.coalesce(F.col("metadata")["step_kind"], F.lit(""))))
    bare = routes.strip(F.col("name"))
    model = F.when((F.col("type") == "internal_step") & (F.col("metadata")["step_kind"] == "input_model"), F.when(F.lower(bare).contains("input model:"), routes.strip(F.regexp_replace(bare, "^[^:]*:", ""))).otherwise(bare))
    named = routes.strip(F.regexp_replace(F.regexp_replace(model, r"\[.*$", ""), r"^[^.]*\.", ""))
    seen = flow.groupBy("trace_id").agg(
        F.max(kind.isin("input", "input_model") | any_of(node_text(snippets=True), BODY_MARKS)).alias("_read"), F.min_by(named, F.when(named.isNotNull(), F.col("pos"))).alias("_model")
    )
    snippet = F.coalesce(F.when(F.col("x.snippet") != "", F.col("x.snippet")), "x.label", F.lit(""))
    pieces = flow.select("trace_id", F.explode("evidence").alias("x")).select("trace_id", F.explode(F.concat(
        _fields(snippet, r"""data\s*\[\s*["']([A-Za-z_]\w*)["']\s*\]""", "string", True), _fields(snippet, r"""data\.get\(\s*["']([A-Za-z_]\w*)["']""", "unknown", False),
    )).alias("f")).select("trace_id", F.lit(1).alias("_rank"), "f.*")
    of_model = seen.select("trace_id", F.col("_model").alias("model")).join(models.select("model", F.col("field").alias("name"), "type").distinct(), "model").select("trace_id", F.lit(0).alias("_rank"), "name", "type", F.lit(True).alias("required"))
    key = lambda c: F.coalesce(F.nullif(F.regexp_replace(c, r"/+\z", ""), F.lit("")), F.lit("/"))
    of_tests = targets.select("trace_id", F.upper(F.coalesce("method", F.lit("ANY"))).alias("_m"), key(F.col("path")).alias("_p")).join(
        payloads.select(F.upper("method").alias("_m"), key(F.col("path")).alias("_p"), F.col("field").alias("name"), "type").distinct(), ["_m", "_p"]
    ).select("trace_id", F.lit(2).alias("_rank"), "name", "type", F.lit(False).alias("required"))
    every = of_model.unionByName(pieces).unionByName(of_tests)
    # code before tests, but a type that is known before one that is not
    best = F.min(F.struct((F.col("type") == "unknown").alias("open"), "_rank", "type"))
    merged = every.groupBy("trace_id", "name").agg(best.alias("b"), F.max("required").alias("required"))
    fields = merged.groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct("name", F.col("b.type").alias("type"), "required"))).alias("fields"))
    out = targets.select("trace_id").join(seen, "trace_id", "left").join(fields, "trace_id", "left")
    consumed = F.coalesce("_read", F.lit(False)) | F.col("_model").isNotNull() | F.col("fields").isNotNull()
    return out.select("trace_id", consumed.alias("consumed"), F.coalesce("fields", F.array().cast("array<struct<name:string,type:string,required:boolean>>")).alias("fields"))


def sink_labels(nodes: DataFrame) -> DataFrame:
    """``trace_id, labels``: what a trace's sinks are called, each once."""
    return nodes.filter(F.col("type").isin(*SINK_TYPES)).groupBy("trace_id").agg(F.array_sort(F.collect_set("name")).alias("labels"))
