"""Parsers, the repository source, discovery, artifacts and streams."""

import json

from routeloom.extract import calls, python_flow, routes, scan, symbols, tables
from routeloom.plans import discovery
from routeloom.sinks import artifacts
from routeloom.sources.repository import parse_spec, read_repositories
from routeloom.streaming import flows


def shape(found):
    return [(r["method"], r["path"], r["handler"]) for r in found]


def test_python_routes():
    text = "@app.route('/a/<int:id>/', methods=['GET', \"post\"])\n@login\n@bp.get('/b')\nasync def show(id):\n    pass\n\n@app.route('/c')\nx = 1\ndef no(): ...\n"
    assert shape(routes.python_routes(text)) == [("GET", "/a/{id}", "show"), ("POST", "/a/{id}", "show"), ("GET", "/b", "show")]


def test_express_routes():
    text = "app.get('/a/:id', auth, show)\nrouter.post(`/b/`, (req, res) => 1)\nmyapp.get('/c', x)\n@app.get('/d')\nrouter.all('/e')\n"
    assert shape(routes.express_routes(text)) == [("GET", "/a/{id}", "auth"), ("POST", "/b", "<inline>"), ("ALL", "/e", None)]


def test_spring_prefix():
    text = "@RestController\n@RequestMapping(\"/db\")\npublic class C {\n  @GetMapping(\"/books\")\n  public List<B> getBooks() {\n  @PostMapping(value = \"/users\")\n  public U createUser(@RequestBody U u) {\n  @RequestMapping(value = \"/x\", method = RequestMethod.PUT)\n  public void put() {\n"
    assert shape(routes.spring_routes(text)) == [("GET", "/db/books", "getBooks"), ("POST", "/db/users", "createUser"), ("PUT", "/db/x", "put")]


def test_arguments_and_handlers():
    assert scan.split_arguments("'a,b', f(x, y), `z`") == ["'a,b'", "f(x, y)", "`z`"]
    assert scan.handler_hint("router.get('/x', auth, wrap(ctl.show, opts));") == "ctl.show"
    assert scan.handler_candidates("auth, wrap(a, ctl.show)") == [(0, "auth", []), (1, "ctl.show", ["wrap"])]
    assert scan.called_names("await svc.load(x, `${fmt(y)}`) // skip(z)\n") == ["svc.load", "fmt"]
    assert not scan.is_followable("res.json") and scan.is_followable("svc.load")


def test_statements():
    lines = ["  const a = f({", "    b: ';' });", "", "  // note;", "  if (!a) return 1", "  return g(a)", "}"]
    got = scan.split_statements(lines[:-1], 2)
    assert got == [(2, 3, "const a = f({ b: ';' });"), (6, 6, "if (!a) return 1"), (7, 7, "return g(a)")]
    assert scan.block_end(["f() {", " x = '}';", " if (y) { z() }", "}"], 1) == 4


def test_chains_and_calls():
    text = "def load(x):\n    r = client.get()\n        .uri(\"/orders/{id}\")\n        .retrieve()\n    app.get('/mine')\n    requests.post('https://billing.example.com/pay?x=1', y)\n    httpx.delete(url)\n    axios('/p')\n    print('/no')\n"
    got = [(c["form"], c["verb"], c["target"], c["symbol"]) for c in calls.outbound_calls(text)]
    assert got == [("chain", "get", "/orders/{id}", "load"), ("call", "post", "https://billing.example.com/pay?x=1", "load"), ("method_only", "delete", None, "load"), ("path_only", None, "/p", "load")]


def test_symbols():
    text = "export default class A {\n  constructor() {\n  }\n  static async load(\n    id: string\n  ): Promise<X> {\n    if (id) {\n    }\n  }\n  save() { return 1 }\n}\nexport const f = async (a, b) => {\n}\nfunction g(x) {\n}\nexport { g as h }\n"
    got = [(s["qualified_name"], s["kind"], s["start_line"], s["end_line"], s["export_kind"]) for s in symbols.js_symbols(text)]
    assert got == [("A", "class", 1, 11, "default"), ("A.load", "class_method", 4, 9, "default"), ("A.save", "class_method", 10, 10, "default"), ("f", "function", 12, None, "named"), ("g", "function", 14, None, "named")]
    assert symbols.js_symbols(text)[1]["is_static"] and symbols.js_symbols(text)[1]["is_async"]
    assert symbols.body_statements("function g(x) {\n  a(x);\n  return b\n}\n", 1) == [(2, 2, "a(x);"), (3, 3, "return b")]


def test_python_steps():
    text = "def make(item: Item, db: Session = Depends(get_db)):\n    data = request.get_json()\n    if not data:\n        raise ValueError()\n    row = Item(**data)\n    db.add(row)\n    db.commit()\n    store[row.id] = row\n    requests.post(URL)\n    return jsonify(row)\n"
    got = [(s["kind"], s["name"]) for s in python_flow.handler_steps(text, "make", "POST")]
    assert got == [
        ("dependency", "Depends(get_db)"), ("input_model", "input model: Item"), ("input", "read JSON request body"), ("validation", "if not data"), ("error", "raise error"), ("transform", "create Item object"),
        ("db_write", "db.add"), ("db_write", "db.commit"), ("store_write", "assign store[row.id]"), ("external_api_call", "requests.post"), ("response", "return JSON response"),
    ]
    assert python_flow.handler_steps("def (", "make") == [] and python_flow.handler_steps(text, "none") == []
    assert python_flow.returning_fields("INSERT ... RETURNING id, t.name") == ["id", "name"]
    assert python_flow.body_fields("data['a']; data.get('b'); data.get('a')") == [("a", True), ("b", False)]


def repository(tmp_path):
    files = {
        "src/app.js": "import api from './routes/api'\nconst app = express()\napp.use('/api/v1', api)\napp.use('/gone', missing)\n",
        "src/routes/api.js": "import tasks from './tasks/index.js'\nconst api = Router()\napi.use('/tasks', tasks)\nexport default api\n",
        "src/routes/tasks/index.js": "import { save } from '../../ctl'\nconst tasksRouter = express.Router()\ntasksRouter.post('/', save)\ntasksRouter.get('/project/:id', wrap(show))\nexport default tasksRouter\n",
        "src/ctl.js": "export function save(req, res) {\n  db.query('INSERT INTO t');\n  return res.json(1)\n}\n",
        "__init__.py": "@app.get('/root')\ndef root():\n    pass\n",
        ".hidden/_x.py": "y = 1\n",
        "tests/test_a.py": "@app.get('/no')\ndef no():\n    pass\n",
        "node_modules/m.js": "app.get('/skip', x)\n",
    }
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "a.png").write_bytes(b"x")
    (tmp_path / "nul.txt").write_bytes(b"a\0b")
    return tmp_path


def test_repository_source_and_discovery(spark, tmp_path):
    root = repository(tmp_path)
    files = read_repositories(spark, [f"shop={root}"])
    paths = {r["path"] for r in files.collect()}
    assert paths == {"src/app.js", "src/routes/api.js", "src/routes/tasks/index.js", "src/ctl.js", "__init__.py", ".hidden/_x.py", "tests/test_a.py"}
    found = {(r["method"], r["path"], r["handler"], r["status"]) for r in discovery.discover(files).collect()}
    assert ("POST", "/api/v1/tasks", "save", "deterministic_composed") in found and ("GET", "/api/v1/tasks/project/{id}", "show", "deterministic_composed") in found
    assert ("GET", "/root", "root", "deterministic") in found and not any(p in ("/no", "/skip") for _, p, _, _ in found)
    _, mounts = discovery.router_graph(tables.route_facts(files))
    assert sorted(r["prefix"] for r in mounts.filter("child IS NULL").collect()) == ["/gone"]
    facts = tables.route_facts(files)
    endpoints = spark.createDataFrame([("shop", "src/routes/tasks/index.js", "save"), ("shop", "src/routes/tasks/index.js", "none")], "repo string, file string, handler string")
    got = {r["handler"]: (r["status"], r["target_file"], r["start_line"]) for r in discovery.resolve_handlers(endpoints, tables.js_symbols(files), facts.filter("kind = 'import'")).collect()}
    assert got == {"save": ("resolved", "src/ctl.js", 1), "none": ("unresolved", None, None)}


def test_discovery_does_not_depend_on_partitions(spark):
    rows = [("r", f"src/a{i}.py", f"@app.get('/x/{i % 7}')\ndef h{i}():\n    pass\n@bp.get('/y')\ndef g{i}():\n    pass\n") for i in range(40)]
    rows += [("r", f"src/b{i}.js", f"const b{i} = Router()\nb{i}.get('/y', h{i})\napp.use('/m', b{i})\nexport default b{i}\n") for i in range(9)]
    files = spark.createDataFrame(rows, "repo string, path string, text string")
    one, many = ([r for r in discovery.discover(files.repartition(n)).orderBy("method", "path").collect()] for n in (1, 50))
    assert one == many and len(one) == 9
    assert [r["handler"] for r in one if r["path"] == "/y"] == ["g0"]


def test_outbound_table(spark):
    files = spark.createDataFrame([("r", "a.py", "def f():\n    self.billing_client.post('/pay/')\n"), ("r", "b.py", None)], "repo string, path string, text string")
    got = [(r["method"], r["target_path"], r["service"], round(r["confidence"], 2), r["symbol"]) for r in tables.outbound_calls(files).collect()]
    assert got == []  # no client word of its own
    files = spark.createDataFrame([("r", "a.py", "def f():\n    client.orders.post('/pay/')\n")], "repo string, path string, text string")
    got = [(r["method"], r["target_path"], r["service"], round(r["confidence"], 2), r["symbol"]) for r in tables.outbound_calls(files).collect()]
    assert got == [("POST", "/pay", "orders", 0.9, "f")]


def test_handler_step_table(spark):
    rows = [("r", "a.py", "f", "GET", "def f():\n    return {'a': 1}\n"), ("r", "a.py", "g", None, None)]
    got = tables.handler_steps(spark.createDataFrame(rows, "repo string, file string, handler string, method string, text string")).collect()
    assert [(r["handler"], r["kind"], r["name"]) for r in got] == [("f", "response", "return response body")]


def test_parse_spec():
    assert parse_spec(" a = /x=y ") == ("a", "/x=y")
    for bad in ("a", "=x", "a="):
        try:
            parse_spec(bad)
        except ValueError:
            continue
        raise AssertionError(bad)


def test_artifacts(spark, tmp_path):
    root = str(tmp_path / "store")
    df = spark.createDataFrame([(1, None), (2, "x")], "a long, b string")
    for _ in range(2):  # a second time takes the place of the first
        artifacts.save_artifact(df, root, "w", "run1", "trace")
    path = artifacts.save_artifact(df, root, "w", "run2", "routes")
    assert spark.read.json(f"{root}/{path}").count() == 2
    assert [(r["run_id"], r["artifacts"]) for r in artifacts.runs(spark, root, "w").collect()] == [("run2", 1), ("run1", 1)]


def test_postman(spark):
    rows = [("b", "post", "x//y", {"q": "1"}, None, '{"a":1}', True, "s", 2), ("a", None, None, None, {"H": "v"}, None, False, None, 1)]
    df = spark.createDataFrame(rows, "name string, method string, path string, query map<string,string>, headers map<string,string>, body string, needs_auth boolean, summary string, ord long")
    got = json.loads(artifacts.postman_collection(df, "C").first()[0])
    first, second = got["item"]
    assert first["name"] == "a" and first["request"]["method"] == "GET" and first["request"]["url"]["raw"] == "{{baseUrl}}/"
    assert second["request"]["url"] == {"raw": "{{baseUrl}}/x/y?q=1", "host": ["{{baseUrl}}"], "path": ["x", "y"], "query": [{"key": "q", "value": "1"}]}
    assert {h["key"] for h in second["request"]["header"]} == {"Authorization", "Content-Type"}


def test_stream(spark, tmp_path):
    src = str(tmp_path / "events")
    rows = [(1, "2024-01-01 00:01:00", "view"), (1, "2024-01-01 00:20:00", "view"), (2, "2024-01-01 03:00:00", "click")]
    df = spark.createDataFrame(rows, "user_id long, t string, event_type string").selectExpr("user_id", "cast(t AS timestamp) AS ts", "event_type")
    df.write.parquet(src)
    q = flows.kind_counts(spark.readStream.schema(df.schema).parquet(src)).writeStream.outputMode("complete").format("memory").queryName("kinds").start()
    q.processAllAvailable()
    q.stop()
    assert {(r["event_type"], r["n"]) for r in spark.table("kinds").collect()} == {("view", 2), ("click", 1)}
    assert flows.sessions(df).count() == 2


def test_trace(spark):
    from routeloom.plans.trace import trace

    files = spark.createDataFrame(
        [
            ("shop", "src/api.py", "@app.post('/orders')\ndef create(order: Order, db: Session = Depends(get_db)):\n    row = Order(**order)\n    db.add(row)\n    db.commit()\n    requests.post('http://billing.local/charge')\n    return {'id': 1}\n"),
            ("shop", "src/r.js", "import { save } from './ctl'\nconst app = Router()\napp.put('/things/:id', save)\n"),
            ("shop", "src/ctl.js", "export function save(req, res) {\n  const b = req.body;\n  await db.query('UPDATE t');\n  return res.json(b);\n}\n"),
            ("billing", "app.py", "@app.post('/charge')\ndef charge():\n    return {}\n"),
        ],
        "repo string, path string, text string",
    )
    t = trace(files, "/orders", "post")
    got = t.summary.first()
    assert (got["handler"], got["sinks"], got["linked"]) == ("create", 1, 1) and 0.8 <= got["confidence"] <= 0.95
    assert [r["kind"] for r in t.steps.orderBy("ord").collect()] == ["dependency", "input_model", "transform", "db_write", "db_write", "external_api_call", "response"]
    assert [r["target_id"] for r in t.links.collect()] == ["billing:app.py:POST:/charge"]
    t = trace(files, "/things/{id}", "PUT")
    assert [r["kind"] for r in t.steps.orderBy("ord").collect()] == ["request_input", "database_write", "response"]
    assert t.summary.first()["sinks"] == 1
    files = spark.createDataFrame([
        ("shop", "src/r.js", "import { load } from './svc'\napp.get('/deep/:id', show)\nexport function show(req, res) {\n  const b = await load(req.params.id);\n  helper(b);\n  return res.json(b);\n}\nfunction helper(x) {\n  log(x);\n  return x\n}\n"),
        ("shop", "src/svc.js", "export function load(id) {\n  return db.query('SELECT a FROM t')\n}\n"),
    ], "repo string, path string, text string")
    t = trace(files, "/deep/{id}", "GET")
    assert {(r["call"], r["outcome"], r["target_file"]) for r in t.followed.collect()} == {("load", "followed", "src/svc.js"), ("helper", "followed", "src/r.js")}
    assert sorted((r["depth"], r["kind"]) for r in t.layers.collect()) == [
        (0, "endpoint"), (1, "handler"), (1, "request_params"), (1, "response"), (1, "transform"), (2, "response"), (2, "response"), (2, "service_call"), (2, "service_call"), (2, "transform"),
    ]
    assert t.layer_edges.count() == 9 and t.summary.first()["followed"] == 2
