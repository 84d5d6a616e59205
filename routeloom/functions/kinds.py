"""Ordered rules that classify files, steps, sinks, errors and properties, as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from routeloom.functions.routes import strip

# What paths tell of a file's role.
DOCS_SUFFIXES = (".md", ".rst", ".adoc")
TEST_DIRS = ("tests", "test", "__tests__", "spec")
TEST_SUFFIXES = (".test.ts", ".spec.ts", ".test.js", ".spec.js", ".test.jsx", ".spec.jsx", ".test.tsx", ".spec.tsx")
SOURCE_SUFFIXES = (".py", ".js", ".ts", ".jsx", ".tsx", ".java", ".go", ".rb", ".php", ".cs", ".kt")

# Sink kinds and actions, and the marks that tell of them, in the order they are tried.
SINK_KINDS = ("database", "external_api", "queue", "file_sink")
SINK_ACTIONS = ("read", "write", "publish", "consume")
KIND_MARKS = (
    ("database", ("db", "database", "sql", "postgres", "mysql", "mongo", "redis")),
    ("queue", ("queue", "kafka", "rabbit", "sqs", "pubsub", "topic")),
    ("file_sink", ("file", "fs", "storage", "s3", "blob", "bucket")),
    ("external_api", ("api", "http", "https", "webhook", "grpc", "external")),
)
NAME_MARKS = (
    ("database", ("db", "database", "sql", "table", "collection")),
    ("queue", ("queue", "topic", "stream", "kafka", "rabbit", "sqs", "pubsub")),
    ("file_sink", ("file", "storage", "bucket", "s3")),
    ("external_api", ("api", "http", "webhook", "service", "client")),
)
ACTION_MARKS = (
    ("write", ("write", "insert", "update", "delete", "save", "upsert", "create", "upload")),
    ("read", ("read", "select", "query", "fetch", "get", "load")),
    ("publish", ("publish", "enqueue", "push", "produce", "send", "emit")),
    ("consume", ("consume", "dequeue", "poll", "read_message", "subscribe")),
)

# Kinds of steps and older names of some.
STEP_KINDS = (
    "endpoint", "middleware", "prehandler", "handler", "request_input", "request_params", "request_query", "validation_branch",
    "database_read", "database_write", "database_query", "storage_call", "external_call", "service_call", "response_branch",
    "response", "response_transform", "transform", "unknown_important",
)
STEP_ALIASES = {
    "db_write": "database_write",
    "db_read": "database_read",
    "external_api": "external_call",
    "external_api_call": "external_call",
    "request_body_read": "request_input",
    "request_params_read": "request_params",
    "request_query_read": "request_query",
    "branch": "validation_branch",
    "return": "response",
}

# Edges from a flow to a sink, by kind and action.
SINK_EDGES = {
    ("database", "read"): "READS_DB",
    ("database", "write"): "WRITES_DB",
    ("database", None): "ACCESSES_DB",
    ("external_api", None): "CALLS_EXTERNAL",
    ("queue", "publish"): "PUBLISHES_QUEUE",
    ("queue", "consume"): "CONSUMES_QUEUE",
    ("queue", None): "INTERACTS_QUEUE",
    ("file_sink", "write"): "WRITES_FILE",
    ("file_sink", None): "INTERACTS_FILE",
}

# Names of test categories.
CATEGORY_ALIASES = {
    "happy_path": "positive",
    "data_shape": "response_schema",
    "authn": "auth",
    "validation_error": "validation",
    "side_effects": "side_effect",
    "state_consistency": "business_rule",
    "edge_cases": "edge_case",
    "failure_modes": "error_handling",
    "persistence": "database",
    "downstream_failure": "external_api",
    "cross_service_contract": "response_schema",
}
CATEGORIES = (
    "positive", "validation", "auth", "authorization", "business_rule", "database", "cache", "external_api", "queue_event",
    "error_handling", "security", "response_schema", "side_effect", "edge_case",
)


# What statements show by the words they hold, and by their form.
SIGNAL_WORDS = {
    "await_call": ("await ",),
    "possible_db_call": ("db.query", ".query(", ".insert", ".update", ".delete", ".save", ".create", ".find"),
    "possible_external_call": ("upload", "fetch(", "axios.", "request(", "s3", "queue", "publish", "sendemail"),
    "request_body_read": ("req.body", "request.body"),
    "request_params_read": ("req.params", "request.params"),
    "request_query_read": ("req.query", "request.query"),
    "response_return": ("res.status", "res.send", "res.json", "return "),
    "sql_literal": ("insert into", "select ", "update ", "delete from"),
}
SIGNAL_FORMS = {"branch": r"\bif\s*\(", "response_transform": r"\bdata\.[a-z_]\w*\s*="}

# What messages of failed model calls say, and what that means, in the order they are tried.
ERROR_WORDS = (
    ("auth/config failure", ("api key is not configured", "api_key", "not set")),
    ("network/connectivity failure", ("unavailable at", "timed out", "reachable", "connection", "network")),
    ("model output parse failure", ("not valid json", "non-json", "missing completion text", "missing 'response' text", "parse")),
)


def any_of(c: Column, marks) -> Column:
    """Whether ``c`` holds one of ``marks``."""
    return reduce(lambda a, b: a | b, [c.contains(m) for m in marks])


def ends_with_any(c: Column, suffixes) -> Column:
    return reduce(lambda a, b: a | b, [c.endswith(s) for s in suffixes])


def chain(rules, default=None) -> Column:
    """The value of the first rule (condition, value) that holds."""
    value = lambda v: v if isinstance(v, Column) else F.lit(v)
    (first, then), *rest = rules
    out = F.when(first, value(then))
    for cond, v in rest:
        out = out.when(cond, value(v))
    return out.otherwise(value(default))


def basename(c: Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)


def suffix(c: Column) -> Column:
    """The extension with its dot, lower case; empty if there is none."""
    return F.regexp_extract(F.lower(basename(c)), r"[^.](\.[^.]+)$", 1)


def file_role(c: Column) -> Column:
    """``docs_candidate``, ``test_usage_candidate``, ``source_route_candidate`` or ``unknown``, by path alone."""
    low = F.lower(F.replace(strip(c), F.lit("\\"), F.lit("/")))
    name, parts = basename(low), F.split(low, "/")
    docs = (name == "readme.md") | low.contains("docs/") | F.array_contains(parts, "docs") | ends_with_any(name, DOCS_SUFFIXES)
    test = (
        F.arrays_overlap(parts, F.array(*map(F.lit, TEST_DIRS)))
        | (name.startswith("test_") & name.endswith(".py"))
        | name.endswith("_test.py")
        | ends_with_any(name, TEST_SUFFIXES)
    )
    return chain([(docs, "docs_candidate"), (test, "test_usage_candidate"), (suffix(low).isin(*SOURCE_SUFFIXES), "source_route_candidate")], "unknown")


def _token(c: Column) -> Column:
    return F.translate(F.lower(strip(F.coalesce(c, F.lit("")))), "- ", "__")


def sink_kind(kind: Column, name: Column) -> Column:
    k, n = _token(kind), _token(name)
    rules = [(k.isin(*SINK_KINDS), k)]
    rules += [(any_of(k, marks), v) for v, marks in KIND_MARKS] + [(any_of(n, marks), v) for v, marks in NAME_MARKS]
    return chain(rules, "unknown")


def sink_action(action: Column) -> Column:
    a = _token(action)
    return chain([(a.isin(*SINK_ACTIONS), a)] + [(any_of(a, marks), v) for v, marks in ACTION_MARKS])


def sink_edge(kind: Column, action: Column) -> Column:
    rules = [((kind == k) & (action == a) if a else (kind == k), v) for (k, a), v in SINK_EDGES.items()]
    return chain(rules, "INTERACTS_SINK")


def sink_node(kind: Column) -> Column:
    return F.when(kind.isin(*SINK_KINDS), kind).otherwise("sink")


def step_kind(raw: Column, signals: Column, text: Column) -> Column:
    """The kind of a step, from its own name, else from the signals of its statement."""
    low = F.lower(strip(F.coalesce(raw, F.lit(""))))
    kind = chain([(low == k, v) for k, v in STEP_ALIASES.items()], low)
    line = F.lower(F.coalesce(text, F.lit("")))
    marks = F.transform(F.coalesce(signals, F.array().cast("array<string>")), F.lower)
    has = lambda s: F.array_contains(marks, s)
    sql, db, out = has("sql_literal"), has("possible_db_call"), has("possible_external_call")
    return chain(
        [
            (kind.isin(*STEP_KINDS), kind),
            (has("request_body_read"), "request_input"),
            (has("request_params_read"), "request_params"),
            (has("request_query_read"), "request_query"),
            (has("response_transform"), "response_transform"),
            (has("response_return") & has("branch"), "response_branch"),
            (has("response_return"), "response"),
            (sql & line.contains("insert into"), "database_write"),
            (sql & line.contains("select "), "database_read"),
            (sql & (line.contains("update ") | line.contains("delete ")), "database_write"),
            (db & line.rlike(r"\b(insert|update|delete|create|save|commit|add)\b"), "database_write"),
            (db, "database_query"),
            (out & any_of(line, ("upload", "s3", "storage")), "storage_call"),
            (out, "external_call"),
            (has("await_call"), "service_call"),
            (has("branch"), "validation_branch"),
            (kind.isin("assignment", "statement", "await_call"), "transform"),
        ],
        "unknown_important",
    )


def step_name(kind: Column, detail: Column) -> Column:
    """How a step is shown: its kind in words, or its detail."""
    worded = ("database_write", "database_read", "database_query", "storage_call", "response", "response_branch", "service_call", "handler", "middleware", "prehandler", "endpoint", "request_params", "request_query", "response_transform", "validation_branch", "transform")
    return chain(
        [(kind == "request_input", "request body input"), (kind.isin(*worded), F.replace(kind, F.lit("_"), F.lit(" ")))],
        F.coalesce(F.nullif(detail, F.lit("")), F.lit("important step")),
    )


def statement_signals(text: Column) -> Column:
    """Sorted signals of a statement. All of it is compiled code, so the lower-case text is made once; words are sought as they are, forms by pattern."""
    t = F.lower(text)
    found = {s: any_of(t, words) for s, words in SIGNAL_WORDS.items()} | {s: t.rlike(form) for s, form in SIGNAL_FORMS.items()}
    return F.array_remove(F.array(*[F.when(found[s], F.lit(s)).otherwise(F.lit("")) for s in sorted(found)]), "")


def statement_kind(text: Column, signals: Column) -> Column:
    t = F.lower(strip(text))
    return chain(
        [
            (t.startswith("if "), "branch"),
            (F.array_contains(signals, "sql_literal"), "sql_literal_assignment"),
            (t.startswith("return "), "return"),
            (t.rlike("^(const|let|var) "), "assignment"),
            (F.array_contains(signals, "await_call"), "await_call"),
        ],
        "statement",
    )


def statement_confidence(text: Column, signals: Column) -> Column:
    return F.when(F.size(signals) > 0, 0.9).when(strip(text).rlike("^(if|return|await) "), 0.7).otherwise(0.5)


def error_class(message: Column) -> Column:
    """Where a failed call to a model server went wrong."""
    m = F.lower(message)
    config, *others = [(any_of(m, words), name) for name, words in ERROR_WORDS]
    missing = m.contains("model not available") | (m.contains("model '") & m.contains("not found"))
    return chain([config, (missing, "model unavailable"), *others], "llm failure")


def test_category(c: Column) -> Column:
    low = F.lower(strip(F.coalesce(c, F.lit("edge_case"))))
    known = chain([(low == k, v) for k, v in CATEGORY_ALIASES.items()], low)
    return F.when(known.isin(*CATEGORIES), known).otherwise("edge_case")


def category_rank(c: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, CATEGORIES)), c)


def property_type(name: Column) -> Column:
    """``struct(type, format, example)`` that a property's name suggests."""
    n = F.lower(name)
    made = lambda t, f, e: F.struct(F.lit(t).alias("type"), F.lit(f).cast("string").alias("format"), F.lit(e).alias("example"))
    return chain(
        [
            (n.contains("email"), made("string", "email", "test@example.com")),
            (n.isin("limit", "page", "count", "quantity", "total"), made("integer", None, "1")),
            (any_of(n, ("price", "amount", "total", "cost")), made("number", None, "9.99")),
            (n.endswith("_id") | (n == "id"), made("string", None, "id_123")),
        ],
        made("string", None, "example"),
    )


# An example of each type of a schema, and a value that is not of it, as JSON.
SCHEMA_EXAMPLES = {"integer": ("1", '"not-a-number"'), "number": ("1.25", '"not-a-number"'), "boolean": ("true", '"not-a-bool"'), "array": ("[]", '"not-an-array"'), "object": ("{}", '"not-an-object"')}


def example_value(kind: Column) -> Column:
    """A value of a schema type, as JSON; of an unknown type, that of a string."""
    low = F.lower(F.coalesce(kind, F.lit("string")))
    return chain([(low == k, v) for k, (v, _) in SCHEMA_EXAMPLES.items()], '"example"')


def invalid_value(kind: Column) -> Column:
    """A value that is not of a schema type, as JSON."""
    low = F.lower(F.coalesce(kind, F.lit("string")))
    return chain([(low == k, v) for k, (_, v) in SCHEMA_EXAMPLES.items()], "12345")


def sink_name(kind: Column, detail: Column) -> Column:
    """How a sink is shown: the verb and table of a statement, the call of a storage or a service, else its detail."""
    said = strip(F.coalesce(detail, F.lit("")))
    low = F.lower(said)
    table = lambda before: F.regexp_extract(low, before + r"\s+([a-z_]\w*)", 1)
    statements = (("INSERT", "insert into", r"insert\s+into"), ("UPDATE", "update ", "update"), ("DELETE", "delete from", r"delete\s+from"), ("SELECT", "select ", "from"))
    shown = [(low.contains(mark), F.concat_ws(" ", F.lit(verb), F.coalesce(F.nullif(table(before), F.lit("")), F.lit("query")))) for verb, mark, before in statements]
    first = lambda p, other: F.coalesce(F.nullif(F.regexp_extract(said, p, 1), F.lit("")), F.lit(other))
    rest = F.coalesce(F.nullif(F.when(F.length(said) > 120, F.concat(F.substring(said, 1, 117), F.lit("..."))).otherwise(said), F.lit("")), kind)
    return chain([
        (kind == "database", chain([*shown, (low.contains("db.query"), "db.query(q)")], rest)),
        (kind == "storage", first("(?i)(uploadBase64|uploadBuffer|uploadFile|downloadFile|putObject)", "storage call")),
        (kind == "external_api", first(r"([A-Za-z_]\w*)\s*\(", "external call")),
    ], rest)


def default_status(method: Column) -> Column:
    m = F.upper(F.coalesce(method, F.lit("")))
    return F.when(m == "POST", "201").when(m == "DELETE", "204").otherwise("200")


def success_status(method: Column, statuses: Column) -> Column:
    """The status of success that a test expects, of those that a contract has."""
    m, has = F.upper(F.coalesce(method, F.lit("GET"))), lambda s: F.array_contains(statuses, s)
    first = F.try_element_at(F.filter(statuses, lambda s: s.startswith("2")), F.lit(1))
    return chain(
        [
            (m == "POST", F.when(has("201"), "201").otherwise("200")),
            (m == "GET", "200"),
            (m.isin("PUT", "PATCH"), F.when(has("200"), "200").otherwise("204")),
            (m == "DELETE", F.when(has("204"), "204").otherwise("200")),
        ],
        F.coalesce(first, F.lit("200")),
    )


def contract_ref(c: Column) -> Column:
    return F.regexp_replace(strip(c), r"^response\.", "responses.")


def response_schema_ref(c: Column) -> Column:
    ref = contract_ref(c)
    return F.when(ref.startswith("responses."), F.substring_index(ref, ".", 2)).otherwise(ref)
