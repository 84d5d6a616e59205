"""Queries on source text: files are written from the driver's tables, and the SQL says what is in them."""

from __future__ import annotations

from pyspark.sql import functions as F

from routeloom.extract import tables
from routeloom.operators import contracts
from routeloom.plans import derive, discovery
from routeloom.plans.queries import register

# {k}: the row's key; {3}: the key modulo 3, and so on
PYTHON = """from fastapi import Depends

class Item{k}(BaseModel):
    name: str
    amount{3}: Optional[int] = 0

@app.route('/s{5}/<int:id>/', methods=['GET', "put"])
@login_required
def show_{k}(id):
    data = request.get_json()
    if 'kind' not in data:
        abort(400)
    n = int(data.get('size{3}'))
    q = request.args.get('page', type=int)
    row = db.query(Item).first()
    db.add(row)
    requests.post(URL)
    return jsonify(row), 202

@bp.get('/t{7}')
async def load_{k}(q: str, db = Depends(get_db)):
    raise HTTPException(status_code=404)
    return [1]
"""
SCRIPT = """import { save, load as get{k} } from './ctl{3}'
import ctl from '../lib/ctl'
const r{k} = express.Router()
// r{k}.get('/no', x)
r{k}.get('/x/:id', auth, wrap(ctl.show{4}))
app.post(`/p{6}/`, (req, res) => 1)
app.use('/m{5}', guard, r{k})
export default r{k}
export function local{k}(a, b) {
  const x = await svc.load{3}(a);
  if (!x) return res.status(404).send({ e: 'gone; ok' })
  db.query('UPDATE t');
  return fmt(`${pick(b)}`)
}
class C{k} {
  static async run(
    id: string
  ): Promise<X> {
    go(id)
  }
}
"""
JAVA = """@RequestMapping("/db{3}")
public class C{k} {
  @GetMapping("/books/{id}")
  public List<B> getBooks() {
  @RequestMapping(value = "/x{4}", method = RequestMethod.PUT)
  private void put{k}() {
"""
CLIENT = """def call{k}(x):
    client.orders{3}.post('/pay/{4}/')
    r = client.get()
        .uri("/o/{5}")
        .retrieve()
    app.get('/mine')
    httpx.delete(url)
def other{k}():
    requests.put("https://billing{2}.example.com/pay?x={k}", y)
"""
TEST = """def test_{k}(client):
    client.post('/items/{3}', json={'a{2}': 1, 'b': 'x', 'c': [1]})
    client.get('/items')
    client.put(path, json={'d': 1})
"""


def _fill(text: str, k):
    out = F.lit(text)
    for mark, value in (("{k}", k), *((f"{{{n}}}", k % n) for n in (2, 3, 4, 5, 6, 7))):
        out = F.replace(out, F.lit(mark), value.cast("string")) if mark in text else out
    return out


def _files(spark, sf_dir, text: str, ending: str, table="supplier", key="s_suppkey", name="src/f"):
    """A few bytes of a row become a text, so rows are dealt out before: a table that is one split would be parsed by one task."""
    k = F.col(key)
    keys = derive.table(spark, sf_dir, table).select(key)
    dealt = keys.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), key)
    return dealt.select(k.alias("k"), F.concat(F.lit("r"), k % 3).alias("repo"), F.concat(F.lit(name), k, F.lit(ending)).alias("path"), _fill(text, k).alias("text"))


def _rows(*rows: str, table="supplier", key="s_suppkey", name="src/f", ending=".py") -> str:
    """SQL: for each key the rows, with k, repo and path before them."""
    head = f"{key} AS k, 'r' || ({key} % 3) AS repo, '{name}' || {key} || '{ending}' AS path"
    return " UNION ALL ".join(f"SELECT k, repo, path, {r} FROM (SELECT {head} FROM {table})" for r in rows)


_R = "{} AS framework, {} AS method, {} AS route, {} AS handler, {}::BIGINT AS line"
_DECLARED = " UNION ALL ".join([
    _rows(*[_R.format("'flask_fastapi'", m, "'/s' || (k % 5) || '/{id}'", "'show_' || k", 7) for m in ("'GET'", "'PUT'")], _R.format("'flask_fastapi'", "'GET'", "'/t' || (k % 7)", "'load_' || k", 20)),
    _rows(_R.format("'express'", "'POST'", "'/p' || (k % 6)", "'<inline>'", 6), table="part", key="p_partkey", ending=".ts"),
    _rows(_R.format("'spring'", "'GET'", "'/db' || (k % 3) || '/books/{id}'", "'getBooks'", 3), _R.format("'spring'", "'PUT'", "'/db' || (k % 3) || '/x' || (k % 4)", "'put' || k", 5), table="nation", key="n_nationkey", ending=".java"),
])


def _sources(spark, sf_dir):
    java = _files(spark, sf_dir, JAVA, ".java", "nation", "n_nationkey")
    return _files(spark, sf_dir, PYTHON, ".py").unionByName(_files(spark, sf_dir, SCRIPT, ".ts", "part", "p_partkey")).unionByName(java.withColumn("k", F.col("k").cast("long")))


@register("declared_routes", f"SELECT repo, path AS file, framework, method, route AS path, handler, line FROM ({_DECLARED})")
def declared_routes(spark, sf_dir):
    return tables.declared_routes(_sources(spark, sf_dir)).select("repo", "file", "framework", "method", "path", "handler", "line")


_F = "'{}' AS kind, {}::BIGINT AS line, {} AS receiver, {} AS method, {} AS route, {} AS name"
_FACTS = _rows(
    _F.format("import", 1, "NULL", "NULL", "'./ctl' || (k % 3)", "'save'"), _F.format("import", 1, "NULL", "NULL", "'./ctl' || (k % 3)", "'get' || k"), _F.format("import", 2, "NULL", "NULL", "'../lib/ctl'", "'ctl'"),
    _F.format("router", 3, "NULL", "NULL", "NULL", "'r' || k"), _F.format("route_call", 5, "'r' || k", "'get'", "'/x/:id'", "'ctl.show' || (k % 4)"), _F.format("literal", 5, "NULL", "NULL", "'/x/:id'", "NULL"),
    _F.format("mount_call", 7, "'app'", "NULL", "'/m' || (k % 5)", "'r' || k"), _F.format("literal", 7, "NULL", "NULL", "'/m' || (k % 5)", "NULL"), _F.format("export", 8, "NULL", "'default'", "NULL", "'r' || k"),
    table="part", key="p_partkey", ending=".ts",
)


@register("route_facts", f"SELECT repo, path AS file, kind, line, receiver, method, route AS path, name FROM ({_FACTS})")
def route_facts(spark, sf_dir):
    return tables.route_facts(_files(spark, sf_dir, SCRIPT, ".ts", "part", "p_partkey")).select("repo", "file", "kind", "line", "receiver", "method", "path", "name")


_S = "{} AS qualified_name, '{}' AS kind, {}::BIGINT AS start_line, {}::BIGINT AS end_line, {} AS export_kind, {} AS is_async, {} AS params"


@register(
    "js_symbols",
    "SELECT repo, path, qualified_name, kind, start_line, end_line, export_kind, is_async, params FROM ("
    + _rows(_S.format("'local' || k", "function", 9, "NULL", "'named'", "false", "'a, b'"), _S.format("'C' || k", "class", 15, 21, "NULL", "false", "''"), _S.format("'C' || k || '.run'", "class_method", 16, 20, "NULL", "true", "'id: string'"), table="part", key="p_partkey", ending=".ts")
    + ")",
)
def js_symbols(spark, sf_dir):
    return tables.js_symbols(_files(spark, sf_dir, SCRIPT, ".ts", "part", "p_partkey")).select("repo", "path", "qualified_name", "kind", "start_line", "end_line", "export_kind", "is_async", "params")


_B = "{}::BIGINT AS first, {}::BIGINT AS last, {} AS statement"


@register(
    "body_statements",
    "SELECT repo, path, first, last, statement FROM ("
    + _rows(
        _B.format(10, 10, "'const x = await svc.load' || (k % 3) || '(a);'"), _B.format(11, 11, "'if (!x) return res.status(404).send({ e: ''gone; ok'' })'"), _B.format(12, 12, "'db.query(''UPDATE t'');'"), _B.format(13, 13, "'return fmt(`${pick(b)}`)'"),
        table="part", key="p_partkey", ending=".ts",
    )
    + ")",
)
def body_statements(spark, sf_dir):
    files = _files(spark, sf_dir, SCRIPT, ".ts", "part", "p_partkey")
    spans = tables.js_symbols(files).filter("kind = 'function'").select("repo", "path", "name", "start_line", "end_line")
    return tables.body_statements(files.join(spans, ["repo", "path"])).select("repo", "path", "first", "last", "statement")


@register(
    "called_names",
    "SELECT repo, path, call, followable FROM ("
    + _rows(*[f"{c} AS call, {f} AS followable" for c, f in (("'svc.load' || (k % 3)", "true"), ("'res.status'", "false"), ("'send'", "false"), ("'db.query'", "false"), ("'fmt'", "true"), ("'pick'", "true"))], table="part", key="p_partkey", ending=".ts")
    + ")",
)
def called_names(spark, sf_dir):
    files = _files(spark, sf_dir, SCRIPT, ".ts", "part", "p_partkey")
    spans = tables.js_symbols(files).filter("kind = 'function'").select("repo", "path", "name", "start_line", "end_line")
    said = tables.body_statements(files.join(spans, ["repo", "path"])).withColumnRenamed("statement", "text")
    return tables.called_names(said).select("repo", "path", "call", "followable")


_C = "{}::BIGINT AS line, {} AS symbol, '{}' AS form, {} AS method, {} AS target_path, {} AS service, {}::DOUBLE AS confidence"


@register(
    "outbound_calls",
    "SELECT repo, path, line, symbol, form, method, target_path, service, confidence FROM ("
    + _rows(
        _C.format(2, "'call' || k", "call", "'POST'", "'/pay/' || (k % 4)", "'orders' || (k % 3)", 0.9), _C.format(3, "'call' || k", "chain", "'GET'", "'/o/' || (k % 5)", "NULL", 0.85),
        _C.format(7, "'call' || k", "method_only", "'DELETE'", "NULL", "NULL", 0.4), _C.format(9, "'other' || k", "call", "'PUT'", "'/pay'", "'billing' || (k % 2)", 0.9), name="app/c",
    )
    + ")",
)
def outbound_calls(spark, sf_dir):
    return tables.outbound_calls(_files(spark, sf_dir, CLIENT, ".py", name="app/c")).select("repo", "path", "line", "symbol", "form", "method", "target_path", "service", F.round("confidence", 6).alias("confidence"))


def _handlers(spark, sf_dir):
    files = _files(spark, sf_dir, PYTHON, ".py").withColumnRenamed("path", "file")
    named = F.explode(F.array(F.struct(F.concat(F.lit("show_"), "k").alias("handler"), F.lit("PUT").alias("method")), F.struct(F.concat(F.lit("load_"), "k").alias("handler"), F.lit("GET").alias("method"))))
    return files.select("repo", "file", "text", named.alias("h")).select("repo", "file", "h.handler", "h.method", "text")


_T = "{} AS handler, {}::BIGINT AS seq, '{}' AS kind, '{}' AS name"
_SHOW = (("input", "read JSON request body"), ("validation", "if ''kind'' not in data"), ("input", "read request args"), ("db_read", "db.query"), ("db_read", "db.first"), ("db_write", "db.add"), ("external_api_call", "requests.post"), ("response", "return JSON response"))
_LOAD = (("dependency", "Depends(get_db)"), ("error", "raise error"), ("response", "return response body"))


@register(
    "handler_steps",
    "SELECT repo, path AS file, handler, kind, name FROM (" + _rows(*[_T.format("'show_' || k", i, *s) for i, s in enumerate(_SHOW)], *[_T.format("'load_' || k", i, *s) for i, s in enumerate(_LOAD)]) + ")",
)
def handler_steps(spark, sf_dir):
    return tables.handler_steps(_handlers(spark, sf_dir)).filter("kind <> 'input_model'").select("repo", "file", "handler", "kind", "name")


@register(
    "request_fields",
    "SELECT repo, path AS file, handler, place, name, type, required FROM ("
    + _rows(*[f"'show_' || k AS handler, '{p}' AS place, {n} AS name, '{t}' AS type, {r} AS required" for p, n, t, r in (("body", "'kind'", "string", "true"), ("body", "'size' || (k % 3)", "integer", "false"), ("query", "'page'", "integer", "false"), ("auth", "'Authorization'", "string", "true"))])
    + ")",
)
def request_fields(spark, sf_dir):
    return tables.request_fields(_handlers(spark, sf_dir)).select("repo", "file", "handler", "place", "name", "type", "required")


@register(
    "python_responses",
    "SELECT repo, path AS file, handler, status, shape FROM ("
    + _rows(*[f"'{h}_' || k AS handler, '{s}' AS status, '{t}' AS shape" for h, s, t in (("show", "202", "unknown"), ("show", "400", "unknown"), ("load", "404", "unknown"), ("load", "200", "array"))]) + ")",
)
def python_responses(spark, sf_dir):
    return tables.responses(_handlers(spark, sf_dir)).select("repo", "file", "handler", "status", "shape")


@register("model_fields", "SELECT repo, path, model, field, type FROM (" + _rows("'Item' || k AS model, 'name' AS field, 'string' AS type", "'Item' || k AS model, 'amount' || (k % 3) AS field, 'number' AS type") + ")")
def model_fields(spark, sf_dir):
    return tables.model_fields(_files(spark, sf_dir, PYTHON, ".py")).select("repo", "path", "model", "field", "type")


@register(
    "test_payloads",
    "SELECT repo, path, method, route, field, type FROM (" + _rows(*[f"'POST' AS method, '/items/' || (k % 3) AS route, {f} AS field, '{t}' AS type" for f, t in (("'a' || (k % 2)", "number"), ("'b'", "string"), ("'c'", "array"))], name="tests/test_") + ")",
)
def test_payloads(spark, sf_dir):
    return tables.test_payloads(_files(spark, sf_dir, TEST, ".py", name="tests/test_")).select("repo", "path", "method", "route", "field", "type")


_ENDS = ("'.ts'", "'.tsx'", "'.js'", "'.jsx'", "'/index.ts'", "'/index.tsx'", "'/index.js'", "'/index.jsx'")


@register(
    "import_targets",
    "SELECT repo, path AS file, name, target, priority FROM ("
    + _rows(*[f"{n} AS name, {t} || {e} AS target, {i} AS priority" for i, e in enumerate(_ENDS) for n, t in (("'save'", "'src/ctl' || (k % 3)"), ("'get' || k", "'src/ctl' || (k % 3)"), ("'ctl'", "'lib/ctl'"))], table="part", key="p_partkey", ending=".ts") + ")",
)
def import_targets(spark, sf_dir):
    facts = tables.route_facts(_files(spark, sf_dir, SCRIPT, ".ts", "part", "p_partkey"))
    return discovery.import_targets(facts.filter("kind = 'import'")).select("repo", "file", "name", "target", "priority")


@register(
    "resolve_handlers",
    "SELECT repo, path AS file, handler, CASE WHEN handler LIKE 'local%' THEN 'resolved' ELSE 'unresolved' END AS status, CASE WHEN handler LIKE 'local%' THEN path END AS target_file, CASE WHEN handler LIKE 'local%' THEN 9::BIGINT END AS start_line FROM ("
    + _rows("'local' || k AS handler", "'ctl.show' || (k % 4) AS handler", table="part", key="p_partkey", ending=".ts") + ")",
)
def resolve_handlers(spark, sf_dir):
    files = _files(spark, sf_dir, SCRIPT, ".ts", "part", "p_partkey")
    asked = files.select("repo", F.col("path").alias("file"), F.explode(F.array(F.concat(F.lit("local"), "k"), F.concat(F.lit("ctl.show"), F.col("k") % 4))).alias("handler"))
    found = discovery.resolve_handlers(asked, tables.js_symbols(files), tables.imports(files))
    return found.select("repo", "file", "handler", "status", "target_file", "start_line")


@register(
    "discovered_routes",
    f"""WITH d AS (SELECT repo, path AS file, method, route AS path, handler, row_number() OVER () AS n FROM ({_DECLARED})),
    c AS (SELECT repo, file, 'GET' AS method, '/m' || (k % 5) || '/x/{{id}}' AS path, 'ctl.show' || (k % 4) AS handler FROM (SELECT p_partkey AS k, 'r' || (p_partkey % 3) AS repo, 'src/f' || p_partkey || '.ts' AS file FROM part)),
    e AS (SELECT repo, file, method, path, handler, 0 AS s FROM d UNION ALL SELECT repo, file, method, path, handler, 1 FROM c)
    SELECT repo, method, path, arg_min(handler, (s, file)) AS handler, arg_min(file, (s, file)) AS file FROM e GROUP BY ALL""",
)
def discovered_routes(spark, sf_dir):
    return discovery.discover(_sources(spark, sf_dir).select("repo", "path", "text")).select("repo", "method", "path", "handler", "file")


@register(
    "contracts_from_source",
    "SELECT repo, path AS file, handler, body, query, header, statuses FROM ("
    + _rows(
        "'show_' || k AS handler, 'kind:true,size' || (k % 3) || ':false' AS body, 'page' AS query, 'Authorization' AS header, '202,400' AS statuses",
        "'load_' || k AS handler, '' AS body, '' AS query, '' AS header, '200,404' AS statuses",
    ) + ")",
)
def contracts_from_source(spark, sf_dir):
    handlers = _handlers(spark, sf_dir).withColumn("endpoint_id", F.concat_ws("|", "repo", "file", "handler")).withColumn("path", F.lit("/x"))
    ids = handlers.select("endpoint_id", "repo", "file", "handler")
    keyed = lambda df: df.join(ids, ["repo", "file", "handler"])
    made = contracts.from_source(contracts.scaffold(handlers.drop("text")), keyed(tables.request_fields(handlers.drop("path"))), keyed(tables.responses(handlers.drop("path"))))
    names = lambda c: F.array_join(F.transform(c, lambda f: f["name"]), ",")
    body = F.coalesce(F.array_join(F.transform("body", lambda f: F.concat_ws(":", f["name"], f["required"].cast("string"))), ","), F.lit(""))
    return made.select("repo", "file", "handler", body.alias("body"), names("query_params").alias("query"), names("headers").alias("header"), F.array_join("statuses", ",").alias("statuses"))


_TIED = "export function once(a) {\n  return a\n}\nfunction twice(b) {\n  return b\n}\nfunction uploadAll(c) {\n  return c\n}\n"


@register(
    "resolve_calls",
    """SELECT 'r' AS repo, 'src/x.ts' AS file, handler, status, target FROM (VALUES ('once', 'resolved', 'src/a.ts'), ('twice', 'ambiguous', 'src/a.ts'), ('uploadAll', 'resolved', 'src/a.ts'), ('tested', 'resolved', 'src/c.ts'), ('none', 'unresolved', NULL)) t(handler, status, target)""",
)
def resolve_calls(spark, sf_dir):
    plain = _TIED.replace("export ", "")
    files = [("r", "src/a.ts", _TIED), ("r", "src/b.ts", plain), ("r", "src/c.ts", "function tested() {\n}\n"), ("r", "src/tests/d.ts", "function tested() {\n}\n")]
    declared = tables.js_symbols(spark.createDataFrame(files, "repo string, path string, text string"))
    asked = spark.createDataFrame([("r", "src/x.ts", h) for h in ("once", "twice", "uploadAll", "tested", "none")], "repo string, file string, handler string")
    none = spark.createDataFrame([], "repo string, file string, name string, path string")
    return discovery.resolve_handlers(asked, declared, none, break_ties=True).select("repo", "file", "handler", "status", F.col("target_file").alias("target"))
