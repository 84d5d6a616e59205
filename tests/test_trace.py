"""Call following, layers, scenarios and contracts."""

from pyspark.sql import functions as F

from routeloom.operators import contracts, follow, scenarios

STATEMENTS = "endpoint_id long, file string, index long, text string, signals array<string>, kind_hint string"


def test_follow_keeps_within_budgets(spark):
    rows = [
        (1, "a.js", 1, "const k = await storage.uploadFile(x)", ["await_call"], "assignment"), (1, "a.js", 2, "save(y); res.json(1)", [], "statement"), (1, "a.js", 3, "main(); helper()", [], "statement"),
        (1, "a.js", 4, "return new ServerResponse(true)", ["response_return"], "return"), (1, "a.js", 5, "getKey(z)", [], "statement"),
    ]
    calls = follow.calls_of(spark.createDataFrame(rows, STATEMENTS))
    assert {r["call"] for r in calls.filter("NOT followable").collect()} == {"res.json"}
    body = [(1, f"s{i}", None) for i in range(1, 4)]
    targets = [(1, "storage.uploadFile", "s.js", "uploadFile", body, None), (1, "save", "b.js", "save", body, None), (1, "main", "a.js", "main", body, None), (1, "helper", None, None, None, "ambiguous")]
    schema = "endpoint_id long, call string, target_file string, target string, statements array<struct<index:long,text:string,signals:array<string>>>, reason string"
    primary = spark.createDataFrame([(1, "a.js", "main", 5)], "endpoint_id long, file string, handler string, steps int")
    got = {r["call"]: (r["pos"], r["outcome"], r["steps"]) for r in follow.follow(calls, spark.createDataFrame(targets, schema), primary, follow.Budgets(steps=9)).collect()}
    assert got == {
        "storage.uploadFile": (1, "followed", 3), "save": (2, "followed", 1), "main": (3, "cycle", 0), "helper": (4, "ambiguous", 0), "ServerResponse": (5, "low_value_response_wrapper", 0), "getKey": (6, "low_value_key_builder", 0),
    }
    stopped = follow.follow(calls, spark.createDataFrame(targets, schema), primary, follow.Budgets(steps=8)).collect()
    assert {r["call"]: r["outcome"] for r in stopped}["save"] == "max_steps" and len(stopped) == 2
    few = follow.follow(calls, spark.createDataFrame(targets, schema), primary, follow.Budgets(functions=2)).collect()
    assert {r["call"]: r["outcome"] for r in few}["save"] == "max_functions"


def test_layers(spark):
    endpoints = spark.createDataFrame([(1, "GET", "/a", "show")], "endpoint_id long, method string, path string, handler string")
    own = spark.createDataFrame([(1, "a.js", i, "return x", ["response_return"], "return") for i in range(1, 50)], STATEMENTS)
    went = spark.createDataFrame([(1, 1, "f", "followed", "b.js", "f", 2), (1, 2, "g", "cycle", "b.js", "g", 0)], "endpoint_id long, pos int, call string, outcome string, target_file string, target string, steps int")
    callee = spark.createDataFrame([(1, "f", i, "statement", "db.query(q)", ["possible_db_call"]) for i in range(1, 9)], "endpoint_id long, target string, index long, kind_hint string, text string, signals array<string>")
    layered = follow.layered_steps(endpoints, own, went, callee)
    got = [tuple(r) for r in layered.groupBy("depth", "kind").count().orderBy("depth", "kind").collect()]
    assert got == [(0, "endpoint", 1), (1, "handler", 1), (1, "response", 40), (2, "database_query", 2), (2, "service_call", 1)]
    edges = follow.next_steps(layered).collect()
    assert len(edges) == 44 and ("0:0", "1:0") in {(e["source"], e["target"]) for e in edges}


def test_scenarios(spark):
    facts = {f: False for f in scenarios.FACTS}
    rows = [(1, "post", "/v1/users", {**facts, "db_write": True, "unique": True}), (2, "GET", "/orders/{id}", facts), (3, "GET", "/items", {**facts, "external": True, "cross_repo": True}), (4, "HEAD", "/x", facts)]
    df = spark.createDataFrame([(i, m, p, *f.values(), "email") for i, m, p, f in rows], "endpoint_id long, method string, path string, " + ", ".join(f"{f} boolean" for f in scenarios.FACTS) + ", unique_field string")
    got = {}
    for r in scenarios.generate_scenarios(df, 99).orderBy("endpoint_id", "pos").collect():
        got.setdefault(r["endpoint_id"], []).append((r["category"], r["name"]))
    assert got[1][0] == ("happy_path", "post_v1_users_creates_resource") and ("validation", "post_v1_users_rejects_duplicate_email") in got[1]
    assert [c for c, _ in got[2]] == ["happy_path", "validation", "edge_cases"]
    names = [n for _, n in got[3]]
    assert "get_items_proxies_downstream_response" in names and "get_items_handles_empty_result_set" not in names and 4 not in got
    assert scenarios.generate_scenarios(df).groupBy("endpoint_id").count().agg(F.max("count")).first()[0] == 7


def test_contracts(spark):
    routes = spark.createDataFrame([(1, "POST", "/a/<int:id>"), (2, "DELETE", "/a/:id"), (3, None, None)], "endpoint_id long, method string, path string")
    c = contracts.scaffold(routes)
    by = {r["endpoint_id"]: r for r in c.collect()}
    assert by[1]["path_params"][0].asDict() == {"name": "id", "type": "integer", "required": True} and by[1]["statuses"] == ["201"] and by[1]["body"] == []
    assert by[2]["statuses"] == ["204"] and by[2]["body"] is None and by[3]["statuses"] == ["200"]
    seen = spark.createDataFrame([(1, ["const e = req.body.email;", "data.get('page')", "return res.status(409).send(x)"])], "endpoint_id long, statements array<string>")
    one = contracts.enrich(c, seen).filter("endpoint_id = 1").first()
    assert [f.asDict() for f in one["body"]] == [{"name": "email", "type": "string", "required": True}, {"name": "page", "type": "integer", "required": False}]
    assert one["statuses"] == ["409"] and one["contract_confidence"] == "medium"
    field = "array<struct<name:string,type:string,grounding:string,origin:string,source_expr:string>>"
    df = spark.createDataFrame([([("a", "unknown", "inferred", "x", None), ("b", "string", "grounded", "x", "e1")], [("a", "int", "grounded", "y", "e2"), ("b", "int", "grounded", "x", None), ("c", "int", "inferred", "z", None)])], f"l {field}, r {field}")
    got = [tuple(f) for f in df.select(contracts.merge_fields(F.col("l"), F.col("r"))).first()[0]]
    assert got == [("a", "int", "grounded", "x+y", "e2"), ("b", "string", "grounded", "x", "e1"), ("c", "int", "inferred", "z", None)]


def test_quality_score(spark):
    schema = "has_request boolean, status string, contract_refs array<string>, has_related boolean, purpose string, has_side_effects boolean, has_evidence boolean, category string, name string, summary string, method string, has_body boolean"
    rows = [(True, "200", ["x"], True, "p", True, True, "positive", "a", "b", "GET", False), (False, None, [], False, None, False, False, "validation", "rejects_invalid_payload", None, "POST", False), (None,) * 12]
    df = spark.createDataFrame(rows, schema)
    assert [r[0] for r in df.select(scenarios.scenario_quality(df)).collect()] == [26, -10, -5]


def test_contract_scenarios(spark):
    schema = (
        "endpoint_id long, method string, path string, body_fields array<struct<name:string,type:string,format:string,required:boolean>>, path_params array<struct<name:string,type:string,required:boolean>>, "
        "query_params array<struct<name:string,type:string,required:boolean>>, has_auth boolean, statuses array<string>, response_fields array<string>, sinks array<string>"
    )
    body = [("email", "string", "email", True), ("age", "integer", None, True), ("note", "string", None, False)]
    rows = [(1, "post", "/u", body, [], [("q", "string", True)], False, ["400", "201"], ["Password"], ["queue", "database"]), (2, None, "/x/{id}", None, [("id", "string", True)], None, None, None, None, None)]
    got = {}
    for r in scenarios.contract_scenarios(spark.createDataFrame(rows, schema)).orderBy("endpoint_id", "pos").collect():
        got.setdefault(r["endpoint_id"], []).append((r["category"], r["name"].split("_", 2)[2], r["status"]))
    assert got[1] == [
        ("positive", "contract_happy_path", "201"), ("validation", "missing_required_email", "400"), ("validation", "missing_required_age", "400"), ("validation", "invalid_type_email", "400"), ("validation", "invalid_email_email", "400"),
        ("validation", "invalid_type_age", "400"), ("validation", "missing_query_q", "400"), ("security", "response_schema_validation", "201"), ("database", "database_failure_handled", "500"), ("queue_event", "queue_publish_failure_handled", "500"),
    ]
    assert got[2] == [("positive", "id_contract_happy_path", "200")]
