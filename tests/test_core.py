"""Operators on small inputs with known results."""

import random

import pytest
from pyspark.sql import functions as F

from routeloom.functions import evidence as ev
from routeloom.functions import kinds, routes, text
from routeloom.operators import files as fo
from routeloom.operators import graph, relational, scores

ROUTE = f"ord long, method string, path string, handler string, file string, repo string, service string, confidence double, status string, evidence {ev.EVIDENCE}"


def values(spark, fn, rows, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], schema).select(fn(F.col("x"))).collect()]


@pytest.mark.parametrize(
    ("fn", "cases"),
    [
        (routes.method, {" get ": "GET", "": None, None: None}),
        (routes.call_verb, {"get": "GET", "requests.Put(": "PUT", "head": None, "forget": None, " 'POST' ": "POST", None: None}),
        (routes.path, {"a/": "/a", "/": "/", "/a//": "/a/", " ": None, None: None}),
        (routes.declared_path, {"": "/", "x": "/x"}),
        (routes.collapsed_path, {"//a///b/": "/a/b", None: "/", "": "/"}),
        (routes.path_identity, {"/i/<int:id>/": "/i/{id}", "/i/:id": "/i/{id}", "i/<id>": "/i/{id}", "/été/:né": "/été/{né}"}),
        (routes.api_path, {"https://h.x/a//b/?q#f": "/a/b", "'/a?x=1'": "/a", "http://h": None, "?q": None, "a": "/a"}),
        (routes.url_service, {"https://api.orders.svc.local:80/x": "orders", "http://127.0.0.1/": None, "/x": None}),
        (routes.client_service, {"self.billing_client": "billing", "requests": None, "userService": "user", "api": None}),
        (routes.handler, {" (save),": "save", "N/A": None, "{}": None, "a.b": "a.b"}),
        (routes.posix_path, {"a\\b/./c": "a/b/c", "./x": "x", " ": None, "a//b": "a/b"}),
        (routes.entity_label, {"/v1/categories": "category", "/users/{id}": "user", "/class": "class", "/": "record", "/order-items": "order item"}),
        (routes.route_token, {"/v1/user-items/{id}": "v1_user_items_id", "/": "root"}),
        (kinds.file_role, {"docs/a.py": "docs_candidate", "README.md": "docs_candidate", "src/test_a.py": "test_usage_candidate", "tests/a.py": "test_usage_candidate", "a.spec.ts": "test_usage_candidate", "src/a.go": "source_route_candidate", "Makefile": "unknown"}),
        (kinds.error_class, {"API_KEY": "auth/config failure", "timed out": "network/connectivity failure", "cannot parse": "model output parse failure", "x": "llm failure"}),
        (kinds.response_schema_ref, {"response.200.body": "responses.200", "request.body.x": "request.body.x"}),
        (text.scenario_id, {"GET /a b!": "get_a_b", "!!": "scenario"}),
        (lambda c: text.snippet(c, 8), {" a  b ": "a b", "abcdefghij": "abcde..."}),
    ],
)
def test_normal_forms(spark, fn, cases):
    assert values(spark, fn, list(cases)) == list(cases.values())


def test_path_parameters(spark):
    assert values(spark, lambda c: F.array_join(routes.path_parameters(c), ","), ["/a/{x}/:y/<int:z>", "/a", "/{x}/:x"]) == ["x,y,z", "", "x"]


def test_json_payload(spark):
    got = values(spark, lambda c: text.json_payload(c).cast("string"), ['```json\n{"a":1}\n```', 'so: [1, 2] ok', "none"])
    assert got == ['{"a":1}', "[1,2]", None]


def test_step_kinds(spark):
    rows = [("db_read", [], ""), ("x", ["sql_literal"], "INSERT INTO t"), ("x", ["possible_db_call"], "db.find()"), ("statement", [], ""), ("x", ["response_return", "branch"], ""), (None, None, None)]
    got = spark.createDataFrame(rows, "k string, s array<string>, t string").select(kinds.step_kind(F.col("k"), F.col("s"), F.col("t"))).collect()
    assert [r[0] for r in got] == ["database_read", "database_write", "database_query", "transform", "response_branch", "unknown_important"]


def test_mount_composition(spark):
    """app mounts /api/v1, which mounts /tasks; one mount resolves nowhere, and a cycle leads nowhere."""
    mounts = spark.createDataFrame(
        [(1, "app", "api", "/api/v1"), (2, "api", "tasks", "/tasks"), (3, "app", None, "/lost"), (4, "c1", "c2", "/x"), (5, "c2", "c1", "/y"), (6, "app", "tasks", "/t")],
        "mount_id long, parent string, child string, prefix string",
    )
    declared = spark.createDataFrame([(1, "tasks", "post", "/"), (2, "tasks", "get", "/project/:id"), (3, "alone", "get", "/z/"), (4, "c1", "get", "/q")], "decl_id long, container string, method string, path string")
    got = {(r["decl_id"], r["method"], r["full_path"], tuple(r["chain"])) for r in graph.compose_routes(declared, mounts).collect()}
    assert got == {
        (1, "POST", "/api/v1/tasks", (1, 2)), (2, "GET", "/api/v1/tasks/project/{id}", (1, 2)), (1, "POST", "/t", (6,)), (2, "GET", "/t/project/{id}", (6,)),
        (3, "GET", "/z", ()), (4, "GET", "/q", ()),
    }
    assert [r["mount_id"] for r in graph.unresolved_mounts(mounts).collect()] == [3]


def test_mounts_of_any_depth(spark):
    depth = 66
    mounts = spark.createDataFrame([(i, f"c{i}", f"c{i + 1}", f"/{i}") for i in range(depth)], "mount_id long, parent string, child string, prefix string").coalesce(1)
    got = {r["container"]: (r["prefix"], r["chain"]) for r in graph.mount_prefixes(mounts).collect()}
    assert len(got) == depth + 1 and got[f"c{depth}"] == ("".join(f"/{i}" for i in range(depth)), list(range(depth)))



def routes_frame(spark, rows):
    full = [(i, m, p, h, f, "r", s, c, st, [(f, None, label, None)] if label else []) for i, (m, p, h, f, s, c, st, label) in enumerate(rows)]
    return spark.createDataFrame(full, ROUTE)


def test_merge_is_a_left_fold(spark):
    """Three candidates of one route: the first wins over the second, the third fills nothing that is there."""
    got = relational.merge_routes(routes_frame(spark, [
        ("get", "/a/:id", "h1", "x.py", "a", 0.5, "llm", "seen"), ("GET", "/a/<id>", "h2", "x.py", None, 0.9, "deterministic", "@app.get('/a')"), ("GET", "a/{id}/", "h3", "tests/x.py", "c", 1.0, "llm", "client.get('/a')"),
        ("POST", None, "p", "y.py", None, None, None, None), ("POST", None, "q", "z.py", "s", 0.3, None, None),
    ])).collect()
    by = {r["method"] + str(r["path"]): r for r in got}
    one = by["GET/a/{id}"]
    assert (one["handler"], one["service"], one["confidence"], [e["label"] for e in one["evidence"]]) == ("h2", "a", 0.9, ["@app.get('/a')"])
    partial = by["POSTNone"]
    assert (partial["handler"], partial["service"], partial["confidence"]) == ("q", "s", 0.3)


def plain_merge(rows):
    """The fold, one candidate after the other."""
    role = {"x.py": 0, "y.py": 0, "notes": 1, "tests/x.py": 2}
    rank = lambda r: (r["status"] != "deterministic", role[r["file"]], -(-1.0 if r["confidence"] is None else r["confidence"]))
    high = lambda e: "@app.get" in (e[2] or "") and "client.get(" not in e[2]
    now = None
    for r in rows:
        if now is None:
            now = dict(r)
            continue
        won, lost = (r, now) if rank(r) < rank(now) else (now, r)
        evidence, seen = [], set()
        for e in won["evidence"] + lost["evidence"]:
            if (k := tuple(x or "" for x in e)) not in seen:
                seen.add(k)
                evidence.append(e)
        if any(map(high, evidence)):
            evidence = [e for e in evidence if high(e)]
        now = {**won, "evidence": evidence, **{c: won[c] if won[c] is not None else lost[c] for c in ("service", "confidence", "status")}}
    return now


@pytest.mark.parametrize("block", [4, 65_536])
def test_merge_is_the_fold_for_any_candidates(spark, monkeypatch, block):
    monkeypatch.setattr(relational, "BLOCK", block)
    rng, rows, names = random.Random(block), [], ("ord", "method", "path", "handler", "file", "repo", "service", "confidence", "status", "evidence")
    for route in range(150):
        quiet = rng.random()
        for _ in range(rng.choice([1, 2, 3, 5, 9, 20])):
            file = rng.choice(["x.py", "y.py", "notes", "tests/x.py"])
            evidence = [(rng.choice(["x.py", "n"]), rng.choice([None, ""]), rng.choice([None, "seen", "client.get('/a')", "seen2"] + ["@app.get('/a')"] * (route % 3)), None) for _ in range(rng.randrange(4))]
            rows.append((
                "get", f"/a/{route}", f"h{len(rows)}", file, "r", rng.choice([None, None, "s1", "s2", ""]), None if rng.random() < quiet else rng.choice([0.0, 0.3, 0.5, 0.9]),
                rng.choice([None, "llm", "other"] + ["deterministic"] * (route % 2)), evidence,
            ))
    rng.shuffle(rows)
    rows = [dict(zip(names, (i, *r))) for i, r in enumerate(rows)]
    want = {}
    for r in rows:
        want.setdefault(r["path"], []).append(r)
    got = {r["path"]: r.asDict() for r in relational.merge_routes(spark.createDataFrame([tuple(r.values()) for r in rows], ROUTE).repartition(5)).collect()}
    for path, group in want.items():
        w = plain_merge(group)
        g = {**got[path], "evidence": [tuple(e) for e in got[path]["evidence"]]}
        assert g == {k: w[k] for k in g if k != "method"} | {"method": "GET"}, path
    assert len(got) == len(want)


def test_merge_of_many_candidates(spark):
    n = 10_000
    df = spark.range(n).selectExpr(
        "id AS ord", "'get' AS method", "'/one' AS path", "concat('h', id) AS handler", "'x.py' AS file", "'r' AS repo", "string(null) AS service", "(id * 7919 % 10007) / 10007D AS confidence",
        "'llm' AS status", "array(named_struct('file', 'x.py', 'symbol', string(null), 'label', concat('seen', id), 'snippet', string(null))) AS evidence",
    )
    (row,) = relational.merge_routes(df).collect()
    best = max(range(n), key=lambda i: (i * 7919 % 10007, -i))
    assert row["handler"] == f"h{best}" and len(row["evidence"]) == n


def test_target_match(spark):
    df = routes_frame(spark, [("POST", "/checkout", "a", "x.py", None, 0.4, None, None), ("GET", "/checkout", "b", "x.py", None, 0.9, None, None), ("GET", "/status/", "c", "x.py", None, None, None, None)])
    assert [(r["handler"], r["rank"]) for r in relational.match_target(df, "/checkout", "post").collect()] == [("a", 1)]
    assert [r["handler"] for r in relational.match_target(df, "checkout/").orderBy("rank").collect()] == ["b", "a"]
    fell = relational.match_target(df, "/status", "PUT").collect()
    assert [(r["handler"], r["fell_back"], r["match_confidence"]) for r in fell] == [("c", True, 0.85)]
    assert relational.match_target(df, "/none").count() == 0


def test_linking(spark):
    endpoints = spark.createDataFrame(
        [(1, "b", "f", "POST", "/checkout", "pay", 1.0), (2, "c", "f", "POST", "/checkout/", None, 0.8), (3, "b", "g", "GET", "/only", None, None), (4, "b", "g", "GET", "/two", None, 0.9), (5, "c", "g", "GET", "/two", None, 0.7)],
        "ord long, repo string, file string, method string, path string, service string, confidence double",
    )
    calls = spark.createDataFrame(
        [(1, "post", "/checkout", None, 0.5), (2, "post", "/checkout?x", "PAY", 0.5), (3, "put", "/only", "zzz", None), (4, "get", "/gone", None, 0.5), (5, "get", None, None, None), (6, "GET", "http://h/two", None, 0.5)],
        "call_id long, method string, path string, service string, confidence double",
    )
    got = {}
    for r in relational.link_calls(calls, endpoints).collect():
        got.setdefault(r["call_id"], []).append((r["target_id"], r["link_type"], r["ambiguous"], r["confidence"]))
    assert len(got[1]) == 2 and all(x[2] for x in got[1])  # 1.0 - 0.8 is under 0.2 in binary
    assert got[2] == [("b:f:POST:/checkout", "exact_method_path", False, 0.75)]
    assert got[3] == [("b:g:GET:/only", "path_only", False, None)]
    assert got[4] == [(None, None, False, 0.4)] and got[5] == [(None, None, False, None)]
    assert got[6] == [("b:g:GET:/two", "exact_method_path", False, 0.7)]  # 0.9 - 0.7 is 0.2 or more


def test_sinks(spark):
    schema = "flow_id long, ord long, kind string, name string, action string, file string, repo string, status string"
    said = spark.createDataFrame([(1, 1, "postgres", "orders", "insert", "f", "r", "inferred"), (1, 2, "SQL", "again", "write", "f", "r", "x")], schema)
    found = spark.createDataFrame([(1, 1, "database", "database", "write", "f", "r", "inferred"), (1, 2, "database", "database", "write", "g", "r", "inferred"), (1, 3, "database", "d2", "write", "g", "r", "inferred")], schema)
    got = sorted((r["ord"], r["kind"], r["name"], r["file"]) for r in relational.merge_sinks(said, found).collect())
    assert got == [(1, "database", "orders", "f"), (2, "database", "again", "f"), (1_000_002, "database", "database", "g")]
    better = spark.createDataFrame([(1, 9, "database", "sure", "write", "f", "r", "confirmed")], schema)
    got = [r["name"] for r in relational.merge_sinks(said.limit(1), better).collect()]
    assert got == ["sure"]


@pytest.mark.parametrize(
    ("counts", "label", "least", "most"),
    [
        ((0, 250, 250, 60, 240, 2, 240, 0), "strong", 0.8, 1.0), ((0, 250, 250, 60, 6, 30, 6, 0), "weak", 0.0, 0.62), ((0,) * 8, "unknown", 0.0, 0.3), ((0, 40, 40, 0, 40, 0, 40, 3), None, 0.5, 0.8),
    ],
)
def test_coverage(spark, counts, label, least, most):
    names = "files_with_route_calls route_calls declarations mount_edges composed unresolved deterministic truncated".split()
    r = scores.discovery_coverage(spark.createDataFrame([counts], ", ".join(f"{n} int" for n in names))).first()
    assert least <= r["score"] <= most and (label is None or r["label"] == label)
    assert r["skip_model"] == (r["label"] in ("strong", "moderate"))


def test_ranking_puts_source_first(spark):
    paths = ["src/routes/user.py", "tests/test_user.py", "docs/routes.md", "main.py", "x/y/z/notes.txt"]
    files = spark.createDataFrame([("r", p) for p in paths], "repo string, path string")
    got = [r["path"] for r in fo.rank_files(files, fo.sense(files)).orderBy("rank").collect()]
    assert set(got[:2]) == {"main.py", "src/routes/user.py"} and "tests/test_user.py" not in got and "docs/routes.md" not in got


def test_quota_cap(spark):
    rows = [(1, i, c, q) for i, (c, q) in enumerate([("a", 1), ("a", 9), ("b", 0), ("c", 8), ("c", 7)])] + [(2, 0, "c", 1)]
    df = spark.createDataFrame(rows, "g long, ord long, c string, q int")
    got = sorted((r["g"], r["ord"]) for r in relational.cap_with_quota(df, ["g"], F.lit(3), [F.col("c") == "a", F.col("c") == "b"], F.col("q")).collect())
    assert got == [(1, 0), (1, 1), (1, 2), (2, 0)]


def test_snapshot_diff(spark):
    schema = "repo string, path string, mtime long, size long, sha string"
    old = spark.createDataFrame([("r", "same", 1, 1, "a"), ("r", "touched", 1, 1, "b"), ("r", "edited", 1, 1, "c"), ("r", "gone", 1, 1, "d")], schema)
    new = spark.createDataFrame([("r", "same", 1, 1, "a"), ("r", "touched", 2, 1, "b"), ("r", "edited", 2, 1, "z"), ("r", "fresh", 1, 1, "e")], schema)
    assert {(r["path"], r["change"]) for r in relational.snapshot_diff(old, new).collect()} == {("edited", "changed"), ("gone", "removed"), ("fresh", "added")}


def test_workspace_id_ignores_order(spark):
    import hashlib

    rows = [("a", "/x"), ("b", "/y")]
    want = hashlib.sha256(b"a=/x\nb=/y").hexdigest()[:16]
    for r in (rows, rows[::-1]):
        assert spark.createDataFrame(r, "n string, p string").agg(text.workspace_id(F.col("n"), F.col("p"))).first()[0] == want


def test_quality_reasons(spark):
    rows = [
        ("GET", "/a", "h", "src/a.py", None, 0.1, None, "client.get('/a')"), ("GET", "/a", "h", "src/a.py", None, 0.1, None, "@router.get('/a')"), (None, "/", None, "src/a.py", None, 0.1, None, "x"),
        (None, "/b", None, "src/a.py", None, 0.9, None, "x"), ("GET", None, None, "src/a.py", None, 0.1, None, "x"), ("GET", "/", "h", "docs/a.py", None, 1.0, None, None),
    ]
    cols = [F.col(c) for c in ("file", "repo", "method", "path", "handler", "confidence", "evidence")]
    got = [r[0] for r in routes_frame(spark, rows).orderBy("ord").select(ev.reject_reason(*cols)).collect()]
    assert got == ["route_invocation_not_declaration", None, "weak_root", None, "no_path_or_handler", "route_declared_in_docs_file"]
