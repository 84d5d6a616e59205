"""What grows with the tables: texts are parsed once and by many tasks, and pairs that no result has are never rows."""

import os

import pytest
from pyspark.sql import functions as F

from routeloom.extract import routes
from routeloom.operators import contracts, grounding, relational
from routeloom.plans import code_queries, discovery
from routeloom.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@needs_tables
def test_texts_are_dealt_out_before_they_are_parsed(spark):
    assert code_queries._files(spark, SF, code_queries.SCRIPT, ".ts", "part", "p_partkey").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_the_merge_of_discovered_routes_does_not_parse_again(spark):
    files = spark.createDataFrame([("r", "src/a.js", "app.get('/x', h)\n")], "repo string, path string, text string")
    assert "MapInArrow" not in _plan(discovery.discover(files))


@needs_tables
def test_handlers_are_resolved_in_one_reading_of_symbols_and_one_of_imports(spark):
    assert _plan(QUERIES["resolve_handlers"](spark, SF)).count("MapInArrow") == 2


@needs_tables
def test_no_side_of_handlers_is_broadcast_whatever_its_size_is_guessed(spark):
    assert "BroadcastExchange" not in QUERIES["resolve_handlers"](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_imports_are_those_among_the_facts():
    text = "import { save, load as get } from './a'\nimport b from \"./b\"; import c from './c'\n// import d from './d'\nx = 'import e from'\nexport default b\n  import {} from 'f'\nimportant()\n\napp.get('/x', h)\n"
    facts = [{k: r[k] for k in ("line", "path", "name")} for r in routes.route_facts(text) if r["kind"] == "import"]
    assert [{k: r[k] for k in ("line", "path", "name")} for r in routes.imports(text)] == facts
    assert [r["name"] for r in facts] == ["save", "get", "b", "c"]


def test_handlers_with_many_candidates(spark):
    symbols = spark.createDataFrame(
        [("r", "a.ts", "f", "f", "function", 1, None), ("r", "a.ts", "f", "f", "function", 9, None), ("r", "b.ts", "C", "C", "class", 1, "named"), ("r", "b.ts", "run", "C.run", "class_method", 2, "named"), ("r", "c.ts", "run", "D.run", "class_method", 2, None)],
        "repo string, path string, name string, qualified_name string, kind string, start_line long, export_kind string",
    )
    imports = spark.createDataFrame([("r", "x.ts", "C", "./b"), ("r", "x.ts", "C", "./b"), ("r", "x.ts", "run", "./c"), ("r", "y.ts", "f", "./a")], "repo string, file string, name string, path string")
    asked = [("r", "a.ts", "f"), ("r", "x.ts", "C"), ("r", "x.ts", "C.run"), ("r", "x.ts", "run"), ("r", "y.ts", "f"), ("r", "z.ts", "D.run"), ("r", "z.ts", "no"), (None, "z.ts", "f"), ("r", "z.ts", None)]
    got = {(r["repo"], r["file"], r["handler"]): (r["status"], r["target_file"], r["start_line"], r["candidates"]) for r in discovery.resolve_handlers(spark.createDataFrame(asked, "repo string, file string, handler string"), symbols, imports).collect()}
    assert got == {
        ("r", "a.ts", "f"): ("resolved", "a.ts", 1, 2), ("r", "x.ts", "C"): ("resolved", "b.ts", 1, 1), ("r", "x.ts", "C.run"): ("resolved", "b.ts", 2, 1), ("r", "x.ts", "run"): ("ambiguous", "b.ts", 2, 2),
        ("r", "y.ts", "f"): ("resolved", "a.ts", 1, 2), ("r", "z.ts", "D.run"): ("resolved", "c.ts", 2, 1), ("r", "z.ts", "no"): ("unresolved", None, None, 0), (None, "z.ts", "f"): ("unresolved", None, None, 0),
    }


def test_endpoints_are_counted_as_they_are_looked_up(spark):
    endpoints = spark.createDataFrame(
        [(1, "b", "f", "POST", "/a", "pay", 1.0), (2, "c", "f", "POST", "/a/", None, 0.8), (3, "b", "g", None, "/a", "pay", None), (4, "b", "g", "GET", "/b", "pay", 0.9), (5, "c", "g", "GET", "/b", None, 0.7), (6, "c", "g", "GET", None, None, 0.7)],
        "ord long, repo string, file string, method string, path string, service string, confidence double",
    )
    calls = spark.createDataFrame(
        [(1, "post", "/a", None, 0.5), (2, "post", "/a", "PAY", 0.5), (3, "put", "/a", "pay", None), (4, None, "/a", None, 0.5), (5, "get", None, None, None), (6, "GET", "http://h/b", "zzz", 0.5), (7, "get", "/gone", "pay", 0.5)],
        "call_id long, method string, path string, service string, confidence double",
    )
    counted = {r["call_id"]: (r["link_type"], r["matches"]) for r in relational.count_endpoints(calls, endpoints).collect()}
    assert counted == {1: ("exact_method_path", 2), 2: ("exact_method_path", 1), 3: ("path_only", 2), 4: ("path_only", 3), 5: (None, 0), 6: ("exact_method_path", 2), 7: (None, 0)}
    found = relational.lookup_endpoints(calls, endpoints).groupBy("call_id", "link_type").agg(F.count("target_id").alias("n")).collect()
    assert {r["call_id"]: (r["link_type"], r["n"]) for r in found} == counted


def test_a_route_meets_one_contract_of_its_path_and_one_of_its_method(spark):
    made = spark.createDataFrame([(3, "GET", "/x"), (1, "POST", "/x/"), (2, "GET", "/x"), (5, None, "/x"), (4, "GET", None)], "contract_ord long, method string, path string")
    routes = spark.createDataFrame([(1, "get", "/x"), (2, "put", "x"), (3, None, "/x"), (4, "get", "/y"), (5, "get", None)], "route_id long, method string, path string")
    matched = contracts.match_contract(routes, made)
    assert sorted(tuple(r) for r in matched.collect()) == [(1, 2, "exact"), (2, 1, "path_only"), (3, 1, "path_only"), (4, None, None), (5, None, None)]
    assert _plan(matched).count("Aggregate") > 2  # contracts become firsts before they are joined


def test_confidence_of_a_flow_takes_no_join(spark):
    answer = '{"steps": [{"name": "db.add(x)", "confidence": 0.5}], "sinks": [{"name": "t", "confidence": 1.0}]%s}'
    a = spark.createDataFrame([(1, "r", None, answer % ""), (2, "r", None, answer % ', "confidence": 0.9'), (2, "r", None, answer % ""), (3, "r", None, "{}"), (4, "r", None, None)], "flow_id long, repo string, code string, answer string")
    got = grounding.flow_confidence(a, grounding.told_steps(a), grounding.told_sinks(a))
    assert sorted((r["flow_id"], r["confidence"]) for r in got.collect() if r["flow_id"] < 3) == [(1, 0.75), (2, 0.75), (2, 0.9)]
    assert sorted((r["flow_id"], r["confidence"]) for r in got.collect() if r["flow_id"] > 2) == [(3, None), (4, None)]
    assert "Join" not in _plan(got)


def test_the_links_of_one_key_are_dealt_out_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(relational, "STREAMED", 32, raising=False)
    monkeypatch.setattr(relational, "HELD", 8, raising=False)
    endpoints = spark.range(1, 31, 1, 1).selectExpr("id AS ord", "'r' AS repo", "concat('f', id % 20) AS file", "'GET' AS method", "IF(id % 2 = 0, '/a', '/a/') AS path", "string(null) AS service", "0.5D AS confidence")
    calls = spark.range(0, 200, 1, 1).selectExpr("id AS call_id", "'get' AS method", "'/a' AS path", "string(null) AS service", "0.5D AS confidence")
    links = relational.link_calls(calls, endpoints)
    got = sorted((r["call_id"], r["target_id"], r["matches"], r["ambiguous"], r["confidence"]) for r in links.collect())
    assert got == sorted((c, f"r:f{e % 20}:GET:/a", 30, True, 0.5) for c in range(200) for e in range(1, 31))
    assert links.select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_calls_meet_endpoints_as_arrays(spark, monkeypatch):
    monkeypatch.setattr(relational, "STREAMED", 16)
    monkeypatch.setattr(relational, "HELD", 8)
    ends = [(i, "r", f"f{i % 3}", ("GET", "PUT", None)[i % 3], "/a", ("pay", None)[i % 2], (0.5, 0.6, None)[i % 3]) for i in range(40)]
    asks = [(i, ("get", "a put", "head", None)[i % 4], "//a/?q" if i % 2 else "/a", ("pay", "none")[i % 2], (None, 0.0, 0.3, 0.9)[i // 4 % 4]) for i in range(60)]
    endpoints = spark.createDataFrame(ends, "ord long, repo string, file string, method string, path string, service string, confidence double")
    calls = spark.createDataFrame([*asks, asks[0]], "call_id long, method string, path string, service string, confidence double")
    want = []
    for c, m, _, s, cc in [*asks, asks[0]]:
        verb = {"get": "GET", "a put": "PUT"}.get(m)
        hits = [e for e in ends if e[3] == verb] if verb else ends
        hits = [e for e in hits if e[5] == s] if s == "pay" else hits
        for _, r, f, em, p, _, ec in hits:
            score = None if cc is None and ec is None else min(0.95, max(0.0, ((cc or 0.45) + (ec or 0.45)) / 2))
            want.append((c, f"{r}:{f}:{em or 'ANY'}:{p}", "exact_method_path" if verb else "path_only", verb, p, len(hits), True, score))
    links = relational.link_calls(calls, endpoints)
    got = [(r["call_id"], r["target_id"], r["link_type"], r["method"], r["path"], r["matches"], r["ambiguous"], r["confidence"]) for r in links.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert "inline(" in _plan(links)


def test_the_strongest_of_a_key_come_from_any_spelling(spark):
    schema = "ord long, repo string, file string, method string, path string, service string, confidence double"
    endpoints = spark.createDataFrame(
        [(1, "b", "f", "POST", "/a", None, 0.5), (2, "b", "g", "post", "/a/", None, 0.9), (3, "c", "f", "POST", "a", "pay", 0.7), (4, "b", "f", "GET", "/b", None, -1.0), (5, None, None, "get", "/b/", None, None), (6, "b", "f", "PUT", "/c", None, 0.9), (7, "b", "f", "PUT", "/c", None, 0.9)],
        schema,
    )
    calls = spark.createDataFrame([(1, "post", "/a", None, 0.5), (2, None, "/a", "pay", 0.5), (3, "get", "/b", None, 0.5), (4, "put", "/c", None, 0.5)], "call_id long, method string, path string, service string, confidence double")
    got = sorted((r["call_id"], r["target_id"], r["ambiguous"], r["matches"]) for r in relational.link_calls(calls, endpoints).collect())
    assert got == [
        (1, "b:g:POST:/a", False, 3), (2, "c:f:POST:/a", False, 1), (3, "::GET:/b", True, 2), (3, "b:f:GET:/b", True, 2), (4, "b:f:PUT:/c", True, 2), (4, "b:f:PUT:/c", True, 2)
    ]


@needs_tables
def test_endpoints_of_links_are_read_by_spelling_not_by_row(spark):
    asked = [line for line in _plan(QUERIES["link_calls"](spark, SF)).splitlines() if "Filter" in line and "regexp" in line]
    assert all("(n#" in line for line in asked)


@needs_tables
def test_the_lookups_of_links_are_planned_once(spark):
    assert "Window" not in _plan(QUERIES["link_calls"](spark, SF))  # the strongest of each key are known by then
