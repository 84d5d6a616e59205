"""Caches, exports, renderers, the command line, model providers and readers."""

import json

import pytest
from pyspark.sql import functions as F

from routeloom import cli
from routeloom.functions import kinds
from routeloom.operators import grounding
from routeloom.plans import model_stage as ms
from routeloom.sinks import artifacts, cache, exports, terminal
from routeloom.sources.repository import read_ranked, read_repositories


@pytest.fixture
def shop(tmp_path):
    root = tmp_path / "shop"
    (root / "src").mkdir(parents=True)
    (root / "src" / "api.py").write_text("@app.post('/orders')\ndef create(o: Order):\n    db.add(o)\n    return {'id': 1}\n")
    (root / "notes.txt").write_text("x" * 9_000)
    return root


def test_cache_bundles(spark, shop, tmp_path):
    files = read_repositories(spark, [f"shop={shop}"])
    folder = cache.cache_folder(spark.createDataFrame([("shop", str(shop))], "name string, root string"), str(tmp_path / "store"), "w")
    assert cache.load_bundle(spark, folder, files, policy="auto")[0] == cache.Status(False, "cache_missing")
    made = {name: spark.createDataFrame([(name,)], "a string") for name in cache.ARTIFACTS if name not in cache.OPTIONAL}
    cache.save_bundle(folder, files, made, policy="auto")
    status, found = cache.load_bundle(spark, folder, files, policy="auto")
    assert status == cache.Status(True, "cache_hit") and found["route_index"].first()["a"] == "route_index"
    assert cache.load_bundle(spark, folder, files, policy="off")[0].reason == "policy_mismatch"
    assert cache.load_bundle(spark, folder, files, policy="auto", model="m")[0].reason == "model_mismatch"
    (shop / "notes.txt").write_text("y")  # not a file that counts
    (shop / "src" / "api.py").touch()  # another time, the same content
    assert cache.load_bundle(spark, folder, read_repositories(spark, [f"shop={shop}"]), policy="auto")[0].hit
    (shop / "src" / "b.py").write_text("x = 1\n")
    assert cache.load_bundle(spark, folder, read_repositories(spark, [f"shop={shop}"]), policy="auto")[0] == cache.Status(False, "changed_files", 1)
    cache.save_bundle(folder, files, {"repo_map": made["repo_map"]}, policy="auto")
    assert cache.load_bundle(spark, folder, files, policy="auto")[0].reason.startswith(("missing_artifact:", "changed_files"))


def test_exports():
    trace = {"target": {"path": "/a", "method": None}, "nodes": [{"id": 1, "x": None}], "edges": [], "flows": [], "summary": {"confidence": 0.5}, "sinks": []}
    out = exports.export_trace(trace)
    assert out["target"] == {"path": "/a"} and out["nodes"] == [{"id": 1}] and "sinks" not in out and out["metadata"]["trace_version"] == "v1"
    kind = lambda p: exports.export_stored(p)["metadata"]["source_artifact_kind"]
    assert kind(trace) == "trace_result" and kind({"result": trace, "timestamp": "t"}) == "trace_result_envelope"
    assert kind({"graph": {"nodes": []}, "target": {"path": "/a"}, "confidence": 1}) == "trace_graph_envelope"
    for bad in ([], {}, {"result": 1}, {"graph": {}}):
        with pytest.raises(ValueError):
            exports.export_stored(bad)


def test_output_targets(tmp_path):
    assert exports.output_file(tmp_path, "x.json") == tmp_path / "x.json"
    assert exports.output_file(tmp_path / "new", "x.json") == tmp_path / "new" / "x.json"
    assert exports.output_target(tmp_path / "deep" / "one.json") == ("file", tmp_path / "deep" / "one.json")
    (tmp_path / "f").write_text("")
    with pytest.raises(ValueError):
        exports.output_file(tmp_path / "f" / "one.json", "x.json")
    assert len(exports.write_trace(tmp_path / "t", {"target": {}, "summary": {}}, {"a": 1, "b": None})) == 3
    assert len(exports.write_routes(tmp_path / "r.json", {}, {})) == 1 and len(exports.write_routes(tmp_path / "r", {}, {})) == 2


def test_matrix_and_collection(spark, tmp_path):
    file = tmp_path / "m.json"
    tests = [{"name": "ok", "method": "get", "route": "a//b", "category": "auth"}, {"name": "two", "request": {"method": "put", "path": "/c", "headers": {"H": "v"}, "body": "{}"}, "contract_refs": ["request.headers.Authorization"]}]
    file.write_text(json.dumps({"groups": [{"category": "auth", "tests": tests}]}))
    assert cli.main(["export", "postman", str(file), "--output", str(tmp_path / "out")], spark) == 0
    items = json.loads((tmp_path / "out" / "postman_collection.json").read_text())["item"]
    assert [(i["request"]["method"], i["request"]["url"]["raw"], sorted(h["key"] for h in i["request"]["header"])) for i in items] == [
        ("GET", "{{baseUrl}}/a/b", ["Authorization"]), ("PUT", "{{baseUrl}}/c", ["Authorization", "Content-Type", "H"]),
    ]
    (tmp_path / "bad.json").write_text("{}")
    assert cli.main(["export", "postman", str(tmp_path / "bad.json"), "--output", str(tmp_path / "out")], spark) == 2


def test_commands(spark, shop, tmp_path, capsys):
    assert cli.main(["routes", "--repo", f"shop={shop}"], spark) == 0
    shown = capsys.readouterr().out
    assert "shop / (unknown-service):" in shown and "- POST /orders" in shown and "handler=create" in shown and "Routes discovered: 1" in shown
    assert cli.main(["trace", "/orders", "--method", "post", "--repo", f"shop={shop}"], spark) == 0
    shown = capsys.readouterr().out
    assert "Trace: POST /orders" in shown and "input model: Order" in shown and "database write: db.add" in shown
    assert cli.main(["trace", "/orders", "--repo", f"shop={shop}", "--output", str(tmp_path / "t")], spark) == 0
    assert json.loads((tmp_path / "t" / "trace_result.json").read_text())["summary"]["handler"] == "create"
    assert cli.main(["export", "trace", str(tmp_path / "t" / "trace_result.json"), "--output", str(tmp_path / "e.json")], spark) == 0
    assert cli.main(["routes", "--repo", "nothing"], spark) == 2
    with pytest.raises(SystemExit):
        cli.main(["--version"], spark)


def test_terminal_columns(spark):
    rows = [("load_user  now", None, "db_read"), ("a.b_c", "User", "db_write"), ("Depends(get_db)", None, "dependency")]
    df = spark.createDataFrame(rows, "name string, entity string, kind string")
    assert [r[0] for r in df.select(terminal.step_headline(F.col("kind"), F.col("name"), F.col("entity"))).collect()] == ["database read: load_user  now", "database write: User", "dependency: get_db"]
    notes = spark.createDataFrame([("Saved graph artifact to x",), ("Selected 3 files",), ("db write seen",)], "n string")
    assert [tuple(r) for r in notes.select(terminal.note_section(F.col("n")), terminal.is_concise(F.col("n"))).collect()] == [("artifacts", True), ("diagnostics", False), ("evidence", True)]
    titles = spark.createDataFrame([("error_handling", None), ("x", " Own ")], "c string, t string")
    assert [r[0] for r in titles.select(terminal.group_title(F.col("c"), F.col("t"))).collect()] == ["Error Handling", "Own"]


def test_index_keeps_all_entries(spark, tmp_path):
    root, df = str(tmp_path / "s"), spark.createDataFrame([(1, None)], "a int, b string")
    for run in ("r1", "r1", "r2"):
        artifacts.save_artifact(df, root, "w", run, "trace")
    assert {r["run_id"]: r["artifacts"] for r in artifacts.runs(spark, root, "w").collect()} == {"r1": 1, "r2": 1}
    assert [r["artifact_name"] for r in artifacts.artifacts_of(spark, root, "w", "r1").collect()] == ["trace"]
    assert artifacts.read_artifact(spark, root, "w", "r2", "trace").collect()[0].asDict() == {"a": 1}
    with pytest.raises(ValueError):
        artifacts.read_artifact(spark, root, "w", "r2", "none")


def test_profiles(spark, shop):
    by = {r["path"]: r for r in read_repositories(spark, [f"shop={shop}"], profile="flow").collect()}
    assert len(by["notes.txt"]["text"]) == 3_500 and by["notes.txt"]["truncated"] and not by["src/api.py"]["truncated"]
    assert read_repositories(spark, [f"shop={shop}"], maxFiles=1).count() == 1
    assert [r["path"] for r in read_ranked(spark, [f"shop={shop}"]).orderBy("rank").collect()] == ["src/api.py", "notes.txt"]


def test_providers():
    url, headers, body = ms.ProviderClient("openai", "m", "k", system="s").request("hi")
    assert url.endswith("/chat/completions") and headers["Authorization"] == "Bearer k" and [m["role"] for m in body["messages"]] == ["system", "user"]
    url, headers, body = ms.ProviderClient("anthropic", "m", "k", system="s").request("hi")
    assert url.endswith("/v1/messages") and headers["x-api-key"] == "k" and body["system"] == "s" and body["max_tokens"] == 4096
    url, headers, body = ms.client_from_settings("m", {"ollama_url": "http://h:1/", "temperature": "7", "timeout": "-1"}).request("hi")
    assert url == "http://h:1/api/generate" and body["prompt"] == "hi" and body["options"] == {"temperature": 1.0} and body["stream"] is False
    with pytest.raises(ms.ClientError):
        ms.ProviderClient("openai", "m").request("hi")

    class Quiet:
        model = "m"

        def generate(self, prompt):
            raise ms.ClientError("unavailable at x")

    assert ms.preflight(Quiet(), lambda: ["m", "n"]) == (True, None) and ms.preflight(Quiet(), lambda: ["n"]) == (False, "model not available: m; available: n")
    assert ms.preflight(Quiet()) == (False, "unavailable at x")


def test_values_and_names(spark):
    df = spark.createDataFrame([("database", "INSERT INTO orders (a)", "integer"), ("database", "x", None), ("storage", "svc.uploadFile(a)", "array"), ("external_api", "post(u)", "object"), ("queue", None, "boolean")], "k string, d string, t string")
    assert [r[0] for r in df.select(kinds.sink_name(F.col("k"), F.col("d"))).collect()] == ["INSERT orders", "x", "uploadFile", "post", "queue"]
    assert [tuple(map(json.loads, r)) for r in df.select(kinds.example_value(F.col("t")), kinds.invalid_value(F.col("t"))).collect()] == [
        (1, "not-a-number"), ("example", 12345), ([], "not-an-array"), ({}, "not-an-object"), (True, "not-a-bool"),
    ]


def test_answers_of_any_shape(spark):
    answers = [(1, '[{"name": "db.add(x)", "kind": "DB-Write", "confidence": 3, "evidence": [{"label": "l"}, 7]}, 5, {"symbol": "f()"}]'), (2, "no json"), (3, '{"steps": 1, "sinks": [{"symbol": "s"}, {}]}')]
    df = spark.createDataFrame([(i, "r", None, a) for i, a in answers], "flow_id long, repo string, code string, answer string")
    got = [(r["flow_id"], r["name"], r["kind"], r["confidence"], r["dropped"]) for r in grounding.told_steps(df).orderBy("flow_id", "ord").collect()]
    assert got == [(1, "db.add(x)", "db_write", 1.0, None), (1, None, "unknown", None, "not an object"), (1, "f", "unknown", None, None)]
    assert [(r["name"], r["dropped"]) for r in grounding.told_sinks(df).orderBy("ord").collect()] == [("s", None), (None, "missing name and symbol")]


def test_artifact_metadata(spark):
    rows = [('{"repo_inputs": [{"name": "a", "root": "/a"}], "target": {"method": "GET", "path": "/x"}, "timestamp": "t"}',), ('{"result": {"repos": [{"name": "b"}], "target": {"path": "/y"}}, "artifact_metadata": {"timestamp": "u"}}',), ("{}",)]
    got = spark.createDataFrame(rows, "j string").select(artifacts.artifact_metadata(F.parse_json(F.col("j"))).alias("m")).select("m.*").collect()
    assert [([r["name"] for r in g["repos"]], g["method"], g["path"], g["timestamp"]) for g in got] == [(["a"], "GET", "/x", "t"), (["b"], None, "/y", "u"), ([], None, None, None)]


def test_prompts_are_cut(spark):
    from routeloom.operators import told

    df = spark.createDataFrame([(["x" * 100] * 50,), (["x" * 100] * 400,), ([],)], "a array<string>")
    made = [r[0] for r in df.select(told.prompt("planner", {"files": F.col("a")}, F.lit("repo"))).collect()]
    assert all(len(p) <= 12_000 and p.startswith("Say how") for p in made)
    assert [len(json.loads(p.split("\n", 1)[1])["files"]) for p in made] == [50, 100, 0]
