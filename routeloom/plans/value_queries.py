"""Queries on column functions: inputs are dealt from a list, and the SQL deals what should come of each."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from routeloom.extract import calls, scan
from routeloom.extract.tables import per_file
from routeloom.functions import kinds, routes, text
from routeloom.operators import follow, scenarios, scores, told
from routeloom.plans import derive
from routeloom.plans.queries import register
from routeloom.sinks import artifacts, cache, terminal


def _literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    return str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"


def _dealt(values, key: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int"))


def _rows(spark, sf_dir, columns: dict):
    k = F.col("p_partkey")
    return derive.table(spark, sf_dir, "part").select(k.alias("k"), *[_dealt(v, k).alias(c) for c, v in columns.items()])


def cases(name: str, inputs: dict[str, list], expected: list, make) -> None:
    """Registers a query: ``make`` of the inputs is ``value``, one of ``expected`` for each."""
    n = len(expected)
    kind = next((("BOOLEAN" if isinstance(v, bool) else "INTEGER" if isinstance(v, int) else "DOUBLE" if isinstance(v, float) else "VARCHAR") for v in expected if v is not None), "VARCHAR")
    listed = ", ".join(f"CAST({_literal(v)} AS {kind})" for v in expected)

    @register(name, f"SELECT p_partkey AS k, [{listed}][(p_partkey % {n} + 1)::INT] AS value FROM part")
    def query(spark, sf_dir):
        return make(_rows(spark, sf_dir, inputs)).select("k", "value")


def _value(fn):
    """The value of a function of the columns."""
    return lambda df: df.withColumn("value", fn(*[F.col(c) for c in df.columns if c != "k"]))


cases("sink_names", {"kind": ["database", "database", "database", "storage", "storage", "external_api", "queue", "database"], "detail": ["INSERT INTO Orders (a)", "select a from items", "plain", "svc.uploadFile(x)", "x", "post(u)", None, "delete from logs"]},
      ["INSERT orders", "SELECT items", "plain", "uploadFile", "storage call", "post", "queue", "DELETE logs"], _value(kinds.sink_name))
cases("example_values", {"kind": ["integer", "NUMBER", "boolean", "array", "object", "string"]}, ["1", "1.25", "true", "[]", "{}", '"example"'], _value(kinds.example_value))
cases("invalid_values", {"kind": ["integer", "NUMBER", "boolean", "array", "object", "string"]}, ['"not-a-number"', '"not-a-number"', '"not-a-bool"', '"not-an-array"', '"not-an-object"', "12345"], _value(kinds.invalid_value))
cases("step_names", {"kind": ["request_input", "database_write", "other", "other"], "detail": ["x", "y", "do it", ""]}, ["request body input", "database write", "do it", "important step"], _value(kinds.step_name))
cases("contract_refs", {"ref": [" response.200", "responses.404.body", "request.body.a"]}, ["responses.200", "responses.404.body", "request.body.a"], _value(kinds.contract_ref))
cases("posix_paths", {"path": ["a\\b", "./a//b/./c/", " x ", "", "a/"]}, ["a/b", "a/b/c", "x", None, "a"], _value(routes.posix_path))
cases("client_services", {"client": ["self.billing_client", "userService", "requests", "api", "a.orders"]}, ["billing", "user", None, None, "orders"], _value(routes.client_service))
cases("validated_paths", {"path": ["a//", "/", "/a/b/", "x"]}, ["/a", "/", "/a/b", "/x"], _value(routes.unified_path))
cases("truncated_texts", {"text": ["short", "x" * 40, "  a \n b "]}, ["short", "x" * 17 + "...", "a b"], _value(lambda c: text.snippet(c, 20)))
cases("scenario_ids", {"name": ["GET /a b!", "--", "Ünï"]}, ["get_a_b", "scenario", "n"], _value(text.scenario_id))
cases("json_payloads", {"answer": ['```json\n{"a": 1}\n```', 'text {"a":1} more', "none", "[1,2]"]}, ['{"a":1}', '{"a":1}', None, "[1,2]"], _value(lambda c: F.to_json(text.json_payload(c))))
cases("distinct_strings", {"listed": ["a, b,a", " ,x", ""]}, ["a|b", "x", ""], _value(lambda c: F.array_join(text.dedupe_strings(F.split(c, ",")), "|")))
cases("skip_reasons", {"call": ["ServerResponse", "getKey", "MAX_SIZE", "values", "load", "Thing"], "text": ["new ServerResponse(1)", "getKey(x)", "MAX_SIZE(1)", "insert into t values (1)", "load(x)", "new Thing(1)"]},
      ["low_value_response_wrapper", "low_value_key_builder", "string_literal_false_positive", "string_literal_false_positive", None, "constructor_wrapper_skipped"], _value(follow.skip_reason))
cases("call_importance", {"name": ["storage.uploadFile", "userService.load", "plain", "getKey"], "signals": ["await_call", "response_return", "", ""]}, [7, 4, 0, -3], _value(lambda n, s: scores.importance(n, F.split(s, ","))))
cases("contract_confidences", {"now": ["low", "high", "low", ""], "fields": [1, 0, 0, 0], "statuses": [1, 0, 1, 0]}, ["medium", "high", "low", "low"], _value(lambda a, b, c: scores.contract_confidence(a, b, c, F.lit(False))))
cases("relevant_files", {"path": ["a.py", "b/c.TSX", "d.md", "Makefile", "e.yaml"]}, [True, True, False, False, True], _value(cache.is_relevant))
cases("step_headlines", {"kind": ["dependency", "db_read", "db_write", "external_api_call", "input_model", None], "name": ["Depends(get_db)", "x", "y", "svc", "input model: Order", "load_user"], "entity": [None, "User", None, None, None, None]},
      ["dependency: get_db", "database read: User", "database write: y", "external call: svc", "input model: Order", "step: load user"], _value(terminal.step_headline))
cases("note_sections", {"note": ["Saved graph artifact", "Selected 3 files", "db write seen", "LLM timeout hit"]}, ["artifacts", "diagnostics", "evidence", "diagnostics"], _value(terminal.note_section))
cases("concise_notes", {"note": ["Saved graph artifact", "Selected 3 files", "Raw call text: x"]}, [True, False, False], _value(terminal.is_concise))
cases("group_titles", {"category": ["error_handling", "x"], "title": [None, " Own "]}, ["Error Handling", "Own"], _value(terminal.group_title))
cases("postman_paths", {"path": ["a//b", "/x", "", "//"]}, ["/a/b", "/x", "/", "/"], _value(artifacts.postman_path))
cases("malformed_scenarios", {"name": ["rejects_malformed", "ok"], "summary": ["JSON body", "JSON body"]}, [True, False], _value(told.is_malformed_json))
cases("field_validations", {"category": ["validation", "validation", "auth"], "refs": ["request.body.a", "responses.200", "request.body.a"]}, [True, False, False], _value(lambda c, r: told.is_field_validation(c, F.array(r))))
cases("sink_scenarios", {"category": ["database", "auth", "auth"], "sink": ["", "", "s"]}, [True, False, True], _value(lambda c, s: told.is_sink_scenario(c, F.array_remove(F.array(s), ""), F.array())))
cases("schema_scenarios", {"status": ["200", "200"], "ref": ["responses.200", "responses.404"]}, [True, False], _value(lambda s, r: told.checks_response_schema(s, F.array(F.lit("responses.200")), r)))


def _parsed(fn, kind: str):
    """The value of a parser of one text."""

    def make(df):
        found = per_file(df.withColumn("path", F.lit("p")), lambda t: [{"value": fn(t)}], f"value {kind}", ("k",), df.columns[1])
        return found

    return make


cases("declaration_lines", {"line": ["@app.get('/a')", "@GetMapping(\"/x\")", "router.post('/a', b)", "client.get('/a')", "x = app.get('/a')", "@login"]}, [True, True, True, False, False, False], _parsed(calls.is_declaration, "boolean"))
cases("outbound_lines", {"line": ["client.get('/a')", "await fetch('/a')", "x.retrieve()", "app.get('/a')", "billing_client.get()"]}, [True, True, True, False, False], _parsed(calls.is_outbound, "boolean"))
cases("handler_hints", {"line": ["router.get('/x', auth, wrap(ctl.show, o));", "app.get('/x', save)", "app.get('/x')", "app.get('/x', (a, b) => 1)"]}, ["ctl.show", "save", None, None], _parsed(scan.handler_hint, "string"))
cases("followable_names", {"name": ["svc.load", "res.json", "console.log", "send", "fmt"]}, [True, False, False, False, True], _parsed(scan.is_followable, "boolean"))
cases("split_arguments", {"code": ["'a,b', f(x, y), `z`", "", "a"]}, ["'a,b'|f(x, y)|`z`", "", "a"], _parsed(lambda t: "|".join(scan.split_arguments(t)), "string"))

_QUALITY = {"has_body": [True, False], "status": ["200", None], "category": ["positive", "validation"], "name": ["a", "rejects_invalid_payload"], "method": ["GET", "POST"]}


def _quality(df):
    filled = df.withColumns({
        "has_request": F.col("has_body"), "contract_refs": F.when(F.col("has_body"), F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")), "has_related": F.col("has_body"), "purpose": F.when(F.col("has_body"), "p"),
        "has_side_effects": F.col("has_body"), "has_evidence": F.col("has_body"), "summary": F.lit(None).cast("string"), "has_body": F.lit(False),
    })
    return filled.withColumn("value", scenarios.scenario_quality(filled).cast("int"))


cases("scenario_quality", _QUALITY, [26, -10], _quality)
