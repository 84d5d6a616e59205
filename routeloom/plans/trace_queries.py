"""Queries on traces: their graphs, what they show, what a model tells of them, and views of contracts. Events are the nodes of traces, users the traces."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from routeloom.functions import routes
from routeloom.operators import contract_view, evidence_packet, grounding, related, relational, suggestions, told
from routeloom.operators import trace_graph as tg
from routeloom.functions import evidence as ev
from routeloom.plans import derive, sql
from routeloom.plans.queries import register
from routeloom.plans.trace import derive_sinks

_TYPES = {"signup": "api_endpoint", "click": "external_api", "error": "database", "view": "internal_step", "purchase": "queue"}
_NAMES = ("validate token", "return order", "db.add(order)", "find_by_id", "call service", "commit(tx)", "email check", "load", "insert row")
_LABELS = ("deterministic:db_read:db.query(Order)", "chain_extraction:GET:/x", "seen", "client.get", "data['qty']", "")
_VERBS = ("GET", "POST", "PUT")


def _pick(values, key):
    return F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int"))


def _pick_sql(values, key):
    listed = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"[{listed}][({key} % {len(values)} + 1)::INT]"


def trace_nodes(spark, sf_dir):
    k = F.col("event_id")
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in _TYPES.items() for x in kv]), F.col("event_type"))
    action = F.when(k % 3 == 0, "write").when(k % 3 == 1, "read")
    step = F.when(k % 10 == 0, "input_model").when(k % 10 == 1, "unknown")
    metadata = F.map_filter(F.create_map(F.lit("action"), action, F.lit("step_kind"), step), lambda _, v: v.isNotNull())
    piece = F.struct(F.lit("e.py").alias("file"), F.lit(None).cast("string").alias("symbol"), _pick(_LABELS, k).alias("label"), F.when(k % 4 == 0, "data.get('note')").alias("snippet"))
    return derive.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("trace_id"), k.alias("ord"), F.concat(F.lit("n"), k).alias("node_id"), kind.alias("type"), _pick(_NAMES, k).alias("name"), F.concat(F.lit("repo"), k % 3).alias("repo"),
        F.lit(None).cast("string").alias("service"), F.concat(F.lit("src/f"), k % 5, F.lit(".py")).alias("file"), F.when(k % 7 != 0, F.concat(F.lit("s"), k % 4)).alias("symbol"),
        _pick(_VERBS, k).alias("method"), F.concat(F.lit("/orders/"), k % 6, F.lit("/{id}")).alias("path"), ((k % 100) / 100.0).alias("confidence"), F.lit("inferred").alias("status"), metadata.alias("metadata"), F.array(piece).cast(ev.EVIDENCE).alias("evidence"),
    )


_NODES = f"""nodes AS (SELECT user_id AS trace_id, event_id AS ord, 'n' || event_id AS node_id,
  CASE event_type {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in _TYPES.items())} END AS type, {_pick_sql(_NAMES, 'event_id')} AS name, 'repo' || (event_id % 3) AS repo,
  'src/f' || (event_id % 5) || '.py' AS file, CASE WHEN event_id % 7 <> 0 THEN 's' || (event_id % 4) END AS symbol, {_pick_sql(_VERBS, 'event_id')} AS method, '/orders/' || (event_id % 6) || '/{{id}}' AS path,
  (event_id % 100) / 100.0::DOUBLE AS confidence, CASE event_id % 3 WHEN 0 THEN 'write' WHEN 1 THEN 'read' END AS action, CASE event_id % 10 WHEN 0 THEN 'input_model' WHEN 1 THEN 'unknown' END AS step_kind,
  {_pick_sql(_LABELS, 'event_id')} AS label, CASE WHEN event_id % 4 = 0 THEN 'data.get(''note'')' END AS snippet FROM events)"""


def trace_edges(spark, sf_dir):
    k = F.col("event_id")
    before = F.lag("event_id").over(Window.partitionBy("user_id").orderBy("event_id"))
    rows = derive.table(spark, sf_dir, "events").select("user_id", "event_id").withColumn("_before", before).filter("_before IS NOT NULL")
    return rows.select(
        F.col("user_id").alias("trace_id"), k.alias("ord"), F.concat(F.lit("e"), k).alias("edge_id"), F.concat(F.lit("n"), "_before").alias("source"), F.concat(F.lit("n"), k).alias("target"),
        _pick(("CALLS_API", "CALLS_EXTERNAL", "NEXT_STEP", "READS_DB"), k).alias("type"), F.lit(None).cast("string").alias("repo"), F.lit(None).cast("string").alias("service"), F.lit(0.5).alias("confidence"),
        F.lit("inferred").alias("status"), F.array().cast(ev.EVIDENCE).alias("evidence"),
    )


_EDGES = f"""edges AS (SELECT user_id AS trace_id, event_id AS ord, 'e' || event_id AS edge_id, 'n' || lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS source, 'n' || event_id AS target,
  {_pick_sql(('CALLS_API', 'CALLS_EXTERNAL', 'NEXT_STEP', 'READS_DB'), 'event_id')} AS type FROM events QUALIFY source IS NOT NULL)"""


def trace_flows(spark, sf_dir):
    """Each trace has two flows, of its even and of its odd events; every third trace names the second as its key."""
    w = Window.partitionBy("user_id", "f").orderBy("event_id")
    rows = derive.table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") % 2).alias("f"))
    return rows.groupBy(F.col("user_id").alias("trace_id"), F.col("f").alias("ord")).agg(
        F.max((F.col("user_id") % 3 == 0) & (F.col("f") == 1)).alias("is_key"), F.transform(F.array_sort(F.collect_list("event_id")), lambda x: F.concat(F.lit("n"), x)).alias("node_ids")
    )


_FLOW = """flow AS (SELECT user_id AS trace_id, 'n' || event_id AS node_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1)::INT AS pos
  FROM (SELECT *, count(*) FILTER (event_id % 2 = 1) OVER (PARTITION BY user_id) AS odd, count(*) FILTER (event_id % 2 = 0) OVER (PARTITION BY user_id) AS even FROM events)
  WHERE event_id % 2 = CASE WHEN even = 0 OR (user_id % 3 = 0 AND odd > 0) THEN 1 ELSE 0 END),
seen AS (SELECT n.*, pos FROM flow JOIN nodes n USING (trace_id, node_id))"""


def trace_targets(spark, sf_dir):
    k = F.col("user_id")
    return derive.table(spark, sf_dir, "events").select("user_id").distinct().select(k.alias("trace_id"), _pick(("post", "GET", "put"), k).alias("method"), F.concat(F.lit("/orders/"), k % 6).alias("path"))


_TARGETS = f"targets AS (SELECT DISTINCT user_id AS trace_id, {_pick_sql(('post', 'GET', 'put'), 'user_id')} AS method, '/orders/' || (user_id % 6) AS path FROM events)"


@register("selected_flow_nodes", f"WITH {_NODES}, {_FLOW} SELECT trace_id, pos, node_id, name FROM seen")
def selected_flow_nodes(spark, sf_dir):
    return tg.selected_nodes(tg.key_flow(trace_flows(spark, sf_dir)), trace_nodes(spark, sf_dir)).select("trace_id", "pos", "node_id", "name")


@register(
    "cross_repo_traces",
    f"WITH {_NODES}, {_EDGES} SELECT DISTINCT e.trace_id FROM edges e JOIN nodes a ON a.trace_id = e.trace_id AND a.node_id = e.source JOIN nodes b ON b.trace_id = e.trace_id AND b.node_id = e.target WHERE e.type = 'CALLS_API' AND a.repo <> b.repo",
)
def cross_repo_traces(spark, sf_dir):
    return tg.crosses_repositories(trace_nodes(spark, sf_dir), trace_edges(spark, sf_dir))


_FACTS = f"""{_NODES}, {_EDGES}, {_FLOW}, {_TARGETS},
whole AS (SELECT t.trace_id, coalesce(bool_or(type = 'database' AND action = 'write'), false) AS db_write, coalesce(bool_or(type = 'database' AND action = 'read'), false) AS db_read, bool_or(type = 'external_api') AS external,
  bool_or(type = 'queue') AS queue, bool_or(type IN ('database', 'external_api', 'queue')) AS sinks_seen, bool_or(type = 'api_endpoint' AND n.method = 'GET' AND starts_with(replace(n.path, '/{{id}}', ''), t.path)) AS explicit_get
  FROM targets t JOIN nodes n USING (trace_id) GROUP BY 1),
along AS (SELECT trace_id, bool_or(type = 'internal_step' AND regexp_matches(name, 'token')) AS auth, bool_or(type = 'internal_step' AND regexp_matches(name, 'validate')) AS validated,
  bool_or(type = 'internal_step' AND name LIKE 'return %') AS returns, bool_or(type = 'internal_step') AS has_steps, bool_or(name = 'find_by_id' OR label LIKE '%query(%') AS lookup,
  bool_or(name IN ('db.add(order)', 'insert row')) AS db_add, bool_or(name = 'commit(tx)') AS db_commit, bool_or(name = 'email check') AS "unique" FROM seen GROUP BY 1),
crossing AS (SELECT DISTINCT e.trace_id, true AS cross_repo FROM edges e JOIN nodes a ON a.trace_id = e.trace_id AND a.node_id = e.source JOIN nodes b ON b.trace_id = e.trace_id AND b.node_id = e.target WHERE e.type = 'CALLS_API' AND a.repo <> b.repo),
facts AS (SELECT t.*, db_write, db_read, external, queue, sinks_seen, explicit_get, coalesce(auth, false) AS auth, coalesce(validated, false) AS validated, coalesce(returns, false) AS returns, coalesce(has_steps, false) AS has_steps,
  coalesce(lookup, false) AS lookup, coalesce(db_add, false) AS db_add, coalesce(db_commit, false) AS db_commit, coalesce("unique", false) AS "unique", coalesce(cross_repo, false) AS cross_repo
  FROM targets t LEFT JOIN whole USING (trace_id) LEFT JOIN along USING (trace_id) LEFT JOIN crossing USING (trace_id))"""


def _facts(spark, sf_dir):
    return tg.trace_facts(trace_targets(spark, sf_dir), trace_nodes(spark, sf_dir), tg.key_flow(trace_flows(spark, sf_dir)), trace_edges(spark, sf_dir))


@register("trace_facts", f"WITH {_FACTS} SELECT * FROM facts")
def trace_facts(spark, sf_dir):
    return _facts(spark, sf_dir)


_PLAIN = "validate primary route behavior from inferred flow and sink evidence"


@register(
    "suggest_tests",
    f"""WITH {_FACTS}, s AS (SELECT *, upper(method) AS m, lower(method) || '_orders_' || (trace_id % 6) || '_' AS stem, (trace_id % 6)::VARCHAR AS e FROM facts),
    made AS (
      SELECT trace_id, 0 AS n, stem || CASE WHEN m = 'POST' AND db_write THEN 'creates_record' WHEN m = 'GET' AND db_read THEN 'returns_retrieved_data' WHEN db_write THEN 'writes_to_database' WHEN db_read THEN 'reads_from_database' ELSE 'returns_success' END AS name,
        CASE WHEN m = 'POST' AND db_write THEN 'verifies POST ' || path || ' persists a new ' || e || ' record' WHEN m = 'GET' AND db_read THEN 'verifies GET ' || path || ' returns retrieved ' || e || ' data' ELSE '{_PLAIN}' END AS summary,
        1 + (db_write OR db_read)::INT + returns::INT + queue::INT + external::INT AS expected FROM s
      UNION ALL SELECT trace_id, 1, stem || CASE WHEN m = 'POST' THEN 'returns_created_entity' ELSE 'returns_response_payload' END,
        CASE WHEN m = 'POST' THEN 'verifies the response returns created ' || e || ' data' ELSE 'validate response body shape from return-like flow steps' END, 1 FROM s WHERE returns
      UNION ALL SELECT trace_id, 2, stem || CASE WHEN db_write THEN 'writes_to_database' ELSE 'verifies_side_effects' END, 'validate major side effects inferred from sink semantics', 1 + queue::INT + external::INT FROM s WHERE db_write OR queue OR external),
    once AS (SELECT * FROM made QUALIFY row_number() OVER (PARTITION BY trace_id, name ORDER BY n) = 1)
    SELECT trace_id, (row_number() OVER (PARTITION BY trace_id ORDER BY n) - 1)::INT AS pos, name, summary, expected FROM once""",
)
def suggest_tests(spark, sf_dir):
    return suggestions.suggest_tests(_facts(spark, sf_dir)).select("trace_id", "pos", "name", "summary", F.size("expectations").alias("expected"))


def _payloads(spark, sf_dir):
    k = F.col("p_partkey")
    return derive.table(spark, sf_dir, "part").select(
        _pick(("POST", "PUT"), k).alias("method"), F.concat(F.lit("/orders/"), k % 6, F.lit("/")).alias("path"), F.concat(F.lit("f"), k % 4).alias("field"), F.lit("string").alias("type")
    ).unionByName(spark.range(1).select(F.lit("POST").alias("method"), F.lit("/orders/0").alias("path"), F.lit("note").alias("field"), F.lit("number").alias("type")))


@register(
    "body_signals",
    f"""WITH {_NODES}, {_FLOW}, {_TARGETS},
    payload AS (SELECT DISTINCT ['POST', 'PUT'][(p_partkey % 2 + 1)::INT] AS m, '/orders/' || (p_partkey % 6) AS path, 'f' || (p_partkey % 4) AS name, 'string' AS type FROM part UNION ALL SELECT 'POST', '/orders/0', 'note', 'number'),
    found AS (
      SELECT trace_id, 0 AS rank, 'total' AS name, 'number' AS type, true AS required FROM (SELECT trace_id, arg_min(name, pos) AS model FROM seen WHERE type = 'internal_step' AND step_kind = 'input_model' GROUP BY 1) WHERE model = 'load'
      UNION ALL SELECT trace_id, 1, 'qty', 'string', true FROM seen WHERE label LIKE 'data%' AND snippet IS NULL UNION ALL SELECT trace_id, 1, 'note', 'unknown', false FROM seen WHERE snippet IS NOT NULL
      UNION ALL SELECT trace_id, 2, name, type, false FROM targets JOIN payload p ON p.m = upper(method) AND p.path = targets.path),
    best AS (SELECT trace_id, name, arg_min(type, (CASE WHEN type = 'unknown' THEN 10 ELSE 0 END) + rank) AS type, bool_or(required) AS required FROM found GROUP BY 1, 2),
    fields AS (SELECT trace_id, string_agg(name || ':' || type || ':' || required, ',' ORDER BY name) AS fields FROM best GROUP BY 1),
    consumed AS (SELECT trace_id, bool_or(coalesce(step_kind = 'input_model', false)) AS c FROM seen GROUP BY 1)
    SELECT trace_id, coalesce(c, false) OR fields IS NOT NULL AS consumed, coalesce(fields, '') AS fields FROM targets LEFT JOIN fields USING (trace_id) LEFT JOIN consumed USING (trace_id)""",
)
def body_signals(spark, sf_dir):
    models = spark.range(1).select(F.lit("load").alias("model"), F.lit("total").alias("field"), F.lit("number").alias("type"))
    got = suggestions.body_signals(trace_targets(spark, sf_dir), trace_nodes(spark, sf_dir), tg.key_flow(trace_flows(spark, sf_dir)), models, _payloads(spark, sf_dir))
    return got.withColumn("fields", F.array_join(F.transform("fields", lambda f: F.concat_ws(":", f["name"], f["type"], f["required"].cast("string"))), ","))


# --- calls and their sources ----------------------------------------------------------------------------


def _calls(spark, sf_dir):
    k = F.col("event_id")
    piece = F.struct(F.lit("c.py").alias("file"), F.lit(None).cast("string").alias("symbol"), _pick(("chain_extraction:GET:/x", "seen", "route_declaration"), k).alias("label"), F.lit(None).cast("string").alias("snippet"))
    return derive.table(spark, sf_dir, "events").filter("event_id % 5 = 0").select(
        F.col("user_id").alias("trace_id"), k.alias("ord"), F.when(k % 4 != 0, F.concat(F.lit("repo"), k % 4)).alias("repo"), F.when(k % 3 != 0, F.concat(F.lit("src/f"), k % 7, F.lit(".py"))).alias("file"),
        F.when(k % 2 == 0, F.concat(F.lit("s"), k % 4)).alias("symbol"), F.when(k % 3 == 0, "GET").alias("method"), F.when(k % 6 == 0, "things").alias("path"),
        _pick(("client.post().uri('/pay')", "requests.get('https://h.example/a/b?x=1')", "go()"), k % 11).alias("raw"), F.array(piece).cast(ev.EVIDENCE).alias("evidence"),
    )


_CALLS = f"""calls AS (SELECT user_id AS trace_id, event_id AS ord, CASE WHEN event_id % 4 <> 0 THEN 'repo' || (event_id % 4) END AS repo, CASE WHEN event_id % 3 <> 0 THEN 'src/f' || (event_id % 7) || '.py' END AS file,
  CASE WHEN event_id % 2 = 0 THEN 's' || (event_id % 4) END AS symbol, CASE WHEN event_id % 3 = 0 THEN 'GET' END AS method, CASE WHEN event_id % 6 = 0 THEN 'things' END AS path,
  {_pick_sql(("client.post().uri('/pay')", "requests.get('https://h.example/a/b?x=1')", "go()"), '(event_id % 11)')} AS raw, {_pick_sql(('chain_extraction:GET:/x', 'seen', 'route_declaration'), 'event_id')} AS label FROM events WHERE event_id % 5 = 0),
tiered AS (SELECT c.*, n.node_id, n.type, n.ord AS node_ord, CASE WHEN n.type = 'internal_step' AND n.repo = c.repo AND n.file = c.file AND n.symbol = c.symbol THEN 1 WHEN n.type = 'internal_step' AND n.repo = c.repo AND n.file = c.file THEN 2
    WHEN n.type = 'api_endpoint' AND n.repo = c.repo AND n.file = c.file THEN 3 WHEN n.type = 'api_endpoint' AND n.repo = c.repo THEN 4 WHEN n.type = 'api_endpoint' THEN 5 END AS tier
  FROM calls c JOIN nodes n USING (trace_id)),
sourced AS (SELECT c.*, t.node_id AS source, t.type AS source_type FROM calls c LEFT JOIN (SELECT * FROM tiered WHERE tier IS NOT NULL QUALIFY row_number() OVER (PARTITION BY trace_id, ord ORDER BY tier, node_ord) = 1) t USING (trace_id, ord)),
detailed AS (SELECT *, coalesce(method, CASE WHEN raw LIKE 'client%' THEN 'POST' WHEN raw LIKE 'requests%' THEN 'GET' END) AS m, coalesce('/' || path, CASE WHEN raw LIKE 'client%' THEN '/pay' WHEN raw LIKE 'requests%' THEN '/a/b' END) AS p,
  CASE WHEN raw LIKE 'requests%' THEN 'https://h.example/a/b?x=1' END AS u FROM sourced)"""


@register("call_sources", f"WITH {_NODES}, {_CALLS} SELECT trace_id, ord, source, source_type FROM sourced")
def call_sources(spark, sf_dir):
    return tg.call_sources(_calls(spark, sf_dir), trace_nodes(spark, sf_dir)).select("trace_id", "ord", "source", "source_type")


@register("http_details", f"WITH {_NODES}, {_CALLS} SELECT trace_id, ord, m AS method, p AS path, u AS url, label <> 'route_declaration' AND (label LIKE 'chain%' OR raw <> 'go()') AS outbound FROM detailed")
def http_details(spark, sf_dir):
    c = _calls(spark, sf_dir)
    return c.select("trace_id", "ord", tg.http_details(F.col("method"), F.col("path"), F.col("raw")).alias("d"), tg.has_outbound_evidence(F.col("raw"), F.col("evidence")).alias("outbound")).select("trace_id", "ord", "d.*", "outbound")


@register(
    "enrich_graph",
    f"""WITH {_NODES}, {_EDGES}, {_CALLS},
    said AS (SELECT *, CASE WHEN m IS NOT NULL AND p IS NOT NULL THEN 'WebClient ' || m || ' ' || p WHEN m IS NOT NULL THEN 'WebClient ' || m WHEN p IS NOT NULL THEN 'WebClient call ' || p END AS o FROM detailed),
    met AS (SELECT trace_id, source AS node_id, 'step' AS role, ord, m, p, o FROM said WHERE source_type = 'internal_step'
      UNION ALL SELECT trace_id, e.target, 'sink', s.ord, m, p, o FROM said s JOIN (SELECT DISTINCT trace_id, source, target FROM edges WHERE type = 'CALLS_EXTERNAL') e USING (trace_id, source)),
    got AS (SELECT trace_id, node_id, role, arg_min(m, ord) FILTER (m IS NOT NULL) AS m, arg_min(p, ord) FILTER (p IS NOT NULL) AS p, arg_min(o, ord) FILTER (o IS NOT NULL) AS o, arg_max(p, ord) FILTER (p IS NOT NULL) AS last, count(*) AS n FROM met GROUP BY ALL)
    SELECT n.trace_id, n.node_id, CASE WHEN g.role = 'sink' THEN coalesce(g.last, n.name) ELSE n.name END AS name, CASE WHEN g.role = 'step' THEN coalesce(nullif(step_kind, 'unknown'), 'external_api_call') ELSE step_kind END AS step_kind,
      coalesce(action, CASE WHEN g.role = 'sink' THEN 'read' END) AS action, g.m AS http_method, g.p AS target_path, g.o AS operation, g.role IS NOT NULL AS grown
    FROM nodes n LEFT JOIN got g ON g.trace_id = n.trace_id AND g.node_id = n.node_id AND ((g.role = 'step' AND n.type = 'internal_step') OR (g.role = 'sink' AND n.type = 'external_api'))""",
)
def enrich_graph(spark, sf_dir):
    nodes, _ = tg.enrich(trace_nodes(spark, sf_dir), trace_edges(spark, sf_dir), _calls(spark, sf_dir))
    return nodes.select("trace_id", "node_id", "name", *[F.col("metadata")[k].alias(k) for k in ("step_kind", "action", "http_method", "target_path", "operation")], (F.size("evidence") > 1).alias("grown"))


def _links(spark, sf_dir):
    k = F.col("ord")
    target = F.struct(
        F.concat(F.lit("repo"), k % 3).alias("repo"), F.concat(F.lit("t"), k % 4, F.lit(".py")).alias("file"), F.lit("GET").alias("method"), F.concat(F.lit("/x/"), k % 4).alias("path"), F.lit("h").alias("handler"),
        F.lit(None).cast("string").alias("service"), F.lit(0.7).alias("confidence"), F.lit("llm").alias("status"), F.array().cast(ev.EVIDENCE).alias("evidence"),
    )
    return _calls(spark, sf_dir).select("trace_id", "ord", "repo", "file", "symbol", "raw", "evidence", target.alias("target"), F.lit("path_only").alias("link_type"), F.lit(0.8).alias("confidence"))


_LINKED = """good AS (SELECT trace_id, ord, source, 'endpoint:repo' || (ord % 3) || ':t' || (ord % 4) || '.py:_x_' || (ord % 4) || ':get' AS target, 'repo' || (ord % 3) AS target_repo FROM detailed
  WHERE source IS NOT NULL AND (repo IS NULL OR repo <> 'repo' || (ord % 3) OR (label <> 'route_declaration' AND (label LIKE 'chain%' OR raw <> 'go()'))))"""


@register("linked_edges", f"WITH {_NODES}, {_EDGES}, {_CALLS}, {_LINKED} SELECT trace_id, edge_id FROM edges UNION ALL SELECT DISTINCT trace_id, 'edge:cross_repo:' || source || ':' || replace(target, ':', '_') FROM good")
def linked_edges(spark, sf_dir):
    return tg.add_links(trace_nodes(spark, sf_dir), trace_edges(spark, sf_dir), _links(spark, sf_dir))[1].select("trace_id", "edge_id")


@register("linked_nodes", f"WITH {_NODES}, {_EDGES}, {_CALLS}, {_LINKED} SELECT trace_id, node_id, repo, type FROM nodes UNION ALL SELECT DISTINCT trace_id, target, target_repo, 'api_endpoint' FROM good")
def linked_nodes(spark, sf_dir):
    return tg.add_links(trace_nodes(spark, sf_dir), trace_edges(spark, sf_dir), _links(spark, sf_dir))[0].select("trace_id", "node_id", "repo", "type")


@register(
    "node_expressions",
    f"""WITH {_NODES} SELECT node_id, CASE WHEN label LIKE 'deterministic%' THEN 'db.query(Order)' END AS expression, CASE WHEN label LIKE 'deterministic%' THEN 'db.query(Order)' WHEN contains(name, '.') OR contains(name, '(') THEN name END AS operation,
        CASE WHEN label LIKE 'deterministic%' THEN 'Order' END AS entity FROM nodes""",
)
def node_expressions(spark, sf_dir):
    e = tg.expression(F.col("evidence"))
    return trace_nodes(spark, sf_dir).select("node_id", e.alias("expression"), tg.operation(F.col("name"), F.col("evidence")).alias("operation"), tg.queried_entity(e).alias("entity"))


# --- packets ----------------------------------------------------------------------------------------------

_KIND = "coalesce(step_kind, action, type)"
_SHOWN = "coalesce(snippet, nullif(label, ''))"


@register("packet_nodes", f"WITH {_NODES} SELECT trace_id, row_number() OVER (PARTITION BY trace_id ORDER BY ord)::INT AS rank, node_id, {_KIND} AS kind, {_SHOWN} AS snippet FROM nodes QUALIFY rank <= 40")
def packet_nodes(spark, sf_dir):
    return evidence_packet.packet_nodes(trace_nodes(spark, sf_dir)).select("trace_id", "rank", "node_id", "kind", "snippet")


@register("packet_edges", f"WITH {_EDGES} SELECT trace_id, row_number() OVER (PARTITION BY trace_id ORDER BY ord)::INT AS rank, edge_id, type FROM edges QUALIFY rank <= 60")
def packet_edges(spark, sf_dir):
    return evidence_packet.packet_edges(trace_edges(spark, sf_dir)).select("trace_id", "rank", "edge_id", "type")


@register(
    "packet_sinks",
    f"WITH {_NODES} SELECT trace_id, name, {_KIND} AS kind, file, arg_min({_SHOWN}, ord) FILTER (true) AS snippet FROM (SELECT * FROM nodes WHERE type IN ('database', 'external_api', 'queue') QUALIFY row_number() OVER (PARTITION BY trace_id, name, {_KIND}, file ORDER BY ord) = 1) GROUP BY ALL",
)
def packet_sinks(spark, sf_dir):
    none = spark.createDataFrame([], "trace_id long, ord long, name string, kind string, repo string, file string, symbol string, snippet string, confidence double")
    return evidence_packet.packet_sinks(none, trace_nodes(spark, sf_dir)).select("trace_id", "name", "kind", "file", "snippet")


@register(
    "packet_notes",
    f"WITH {_NODES}, {_EDGES} SELECT trace_id, 'Trace nodes truncated: kept 40 of ' || count(*) || '.' AS note FROM nodes GROUP BY 1 HAVING count(*) > 40 UNION ALL SELECT trace_id, 'Trace edges truncated: kept 60 of ' || count(*) || '.' FROM edges GROUP BY 1 HAVING count(*) > 60",
)
def packet_notes(spark, sf_dir):
    return evidence_packet.packet_notes(trace_nodes(spark, sf_dir), trace_edges(spark, sf_dir))


@register(
    "source_windows",
    """WITH p AS (SELECT source AS trace_id, doc_id AS ord, lang AS repo, 'f' || (doc_id % 50) AS file, text FROM documents WHERE text <> '' AND source IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source, lang, doc_id % 50 ORDER BY doc_id) = 1),
    w AS (SELECT *, 8000 - coalesce(sum(length(text)) OVER (PARTITION BY trace_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM p)
    SELECT trace_id, ord, file, least(room, length(text))::BIGINT AS n FROM w WHERE room > 0""",
)
def source_windows(spark, sf_dir):
    d = derive.table(spark, sf_dir, "documents").filter("source IS NOT NULL")
    places = d.select(F.col("source").alias("trace_id"), F.col("doc_id").alias("ord"), F.col("lang").alias("repo"), F.concat(F.lit("f"), F.col("doc_id") % 50).alias("file"), F.lit(1).alias("start_line"), "text")
    return evidence_packet.source_windows(places).select("trace_id", "ord", "file", F.length("text").cast("long").alias("n"))


@register(
    "matrix_summary",
    f"WITH {_NODES} SELECT trace_id, count(DISTINCT ord % 4) AS groups, count(*) AS scenarios, list_aggregate(list(name ORDER BY ord % 4, ord)[1:12], 'string_agg', '|') AS first FROM nodes GROUP BY 1",
)
def matrix_summary(spark, sf_dir):
    n = trace_nodes(spark, sf_dir)
    tests = n.select("trace_id", (F.col("ord") % 4).alias("group_ord"), "ord", F.lit("g").alias("group_category"), "name", F.lit(None).cast("string").alias("category"), F.lit("high").alias("priority"), "status", F.array().cast("array<string>").alias("contract_refs"))
    return evidence_packet.matrix_summary(tests).withColumn("first", F.array_join(F.transform("first", lambda x: x["name"]), "|"))


# --- what a model tells -------------------------------------------------------------------------------------

_TOLD = ("call service", "Process  Request ", "db.add(order)", " ", "load_order;")
_TOLD_KINDS = ("db write", "HTTP", "queue-consume", "handler x", "zz")


def _answers(spark, sf_dir):
    k = F.col("event_id")
    step = F.struct(_pick(_TOLD, k).alias("name"), _pick(_TOLD_KINDS, k % 7).alias("kind"), F.when(k % 3 == 0, "a\\b.py").alias("file"), ((k % 5) / 2.0).alias("confidence"), F.when(k % 4 == 0, " DONE ").alias("status"))
    sink = F.struct(F.lit("orders table").alias("name"), _pick(("database", "x"), k).alias("kind"), F.lit("insert").alias("action"))
    body = F.to_json(F.struct(F.array(step).alias("steps"), F.array(sink).alias("sinks"), F.when(k % 6 == 0, 0.9).alias("confidence")))
    answer = F.when(k % 2 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    return derive.table(spark, sf_dir, "events").select(k.alias("flow_id"), F.lit("r").alias("repo"), F.when(k % 10 == 0, "def call_service(): pass").alias("code"), answer.alias("answer"))


@register(
    "told_steps",
    f"""SELECT event_id AS flow_id, nullif(trim(regexp_replace({_pick_sql(_TOLD, 'event_id')}, '\\s+', ' ', 'g'), ' ;'), '') AS name, ['db_write', 'external_api_call', 'queue_consume', 'handler', 'unknown'][(event_id % 7 % 5 + 1)::INT] AS kind,
        CASE WHEN event_id % 3 = 0 THEN 'a/b.py' END AS file, least((event_id % 5) / 2.0::DOUBLE, 1.0::DOUBLE) AS confidence, CASE WHEN event_id % 4 = 0 THEN 'done' ELSE 'inferred' END AS status, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS evidence,
        CASE WHEN event_id % 5 = 3 THEN 'missing meaningful content' WHEN event_id % 5 = 1 OR (event_id % 5 = 0 AND event_id % 10 <> 0) THEN 'suspicious abstract step' END AS dropped FROM events""",
)
def told_steps(spark, sf_dir):
    return grounding.told_steps(_answers(spark, sf_dir)).select("flow_id", "name", "kind", "file", "confidence", "status", F.size("evidence").alias("evidence"), "dropped")


@register("told_sinks", "SELECT event_id AS flow_id, 'orders table' AS name, 'database' AS kind, 'write' AS action, CAST(NULL AS VARCHAR) AS dropped FROM events")
def told_sinks(spark, sf_dir):
    return grounding.told_sinks(_answers(spark, sf_dir)).select("flow_id", "name", "kind", "action", "dropped")


@register(
    "flow_confidence",
    "SELECT event_id AS flow_id, CASE WHEN event_id % 6 = 0 THEN 0.9 WHEN event_id % 5 IN (1, 3) OR (event_id % 5 = 0 AND event_id % 10 <> 0) THEN NULL ELSE least((event_id % 5) / 2.0::DOUBLE, 1.0::DOUBLE) END::DOUBLE AS confidence FROM events",
)
def flow_confidence(spark, sf_dir):
    a = _answers(spark, sf_dir)
    return grounding.flow_confidence(a, grounding.told_steps(a), grounding.told_sinks(a))


@register(
    "step_grounding",
    f"WITH {_NODES} SELECT node_id, name = 'call service' AS abstract, name IN ('validate token', 'return order', 'db.add(order)', 'commit(tx)', 'insert row') AS concrete, symbol IS NOT NULL OR label <> '' AS strong FROM nodes",
)
def step_grounding(spark, sf_dir):
    n = F.col("name")
    return trace_nodes(spark, sf_dir).select("node_id", grounding.is_abstract(n).alias("abstract"), grounding.is_concrete(n).alias("concrete"), grounding.has_strong_evidence(F.col("symbol"), F.col("evidence")).alias("strong"))


@register(
    "anchor_sufficient",
    """SELECT doc_id, coalesce((regexp_matches(t, 'router\\.|@app\\.|route\\(|post\\(|get\\(|put\\(|delete\\(')::INT + regexp_matches(t, 'db\\.|\\.commit\\(|\\.add\\(|\\.save\\(|insert|update|delete')::INT
        + regexp_matches(t, 'client\\.|requests\\.|httpx\\.|fetch\\(|queue|publish|enqueue')::INT) >= 2, false) AS sufficient FROM (SELECT doc_id, lower(text) || CASE WHEN doc_id % 3 = 0 THEN ' db.add(x) requests.get(y)' ELSE '' END AS t FROM documents)""",
)
def anchor_sufficient(spark, sf_dir):
    d = derive.table(spark, sf_dir, "documents")
    code = F.concat("text", F.when(F.col("doc_id") % 3 == 0, " db.add(x) requests.get(y)").otherwise(""))
    return d.select("doc_id", grounding.anchor_sufficient(code, F.lit(False)).alias("sufficient"))


# --- files near an endpoint ------------------------------------------------------------------------------------


def _anchors(spark, sf_dir):
    k = F.col("s_suppkey")
    return derive.table(spark, sf_dir, "supplier").select(
        k.alias("endpoint_id"), F.concat(F.lit("Brand#"), k % 5 + 1, k % 5 + 1).alias("repo"), F.concat(F.lit("src/routes/user_"), k % 9, F.lit(".py")).alias("file"), F.lit("user.load").alias("handler"), F.array().cast(ev.EVIDENCE).alias("evidence")
    )


_RELATED = f"""WITH {sql.FILES}, near AS (
  SELECT s_suppkey AS endpoint_id, f.repo, f.path, lower(f.path) AS p, regexp_extract(lower(f.path), '[^/]*$') AS name, 'src/routes/user_' || (s_suppkey % 9) || '.py' AS anchor, 'user_' || (s_suppkey % 9) AS stem
  FROM supplier JOIN (SELECT DISTINCT repo, path FROM files) f ON f.repo = 'Brand#' || (s_suppkey % 5 + 1) || (s_suppkey % 5 + 1) WHERE f.path <> anchor),
hits AS (SELECT *, list_sum(list_transform({list(related.KEYWORDS)}, lambda w: (list_contains(string_split(p, '/'), w) OR contains(name, w))::INT)) AS k, contains(name, 'user')::INT + contains(name, 'load')::INT AS w FROM near),
scored AS (SELECT endpoint_id, repo, path, k, w, round((CASE WHEN regexp_replace(p, '/?[^/]*$', '') = 'src/routes' THEN 3.0 ELSE 0 END + CASE WHEN name LIKE '%_.py' THEN 0.7 ELSE 0 END + CASE WHEN p LIKE 'src/%' THEN 0.6 ELSE 0 END
  + CASE WHEN k > 0 THEN least(2.0, 0.9 + 0.3 * k) ELSE 0 END + CASE WHEN contains(name, stem) AND regexp_replace(name, '\\.[^.]*$', '') <> stem THEN 0.7 ELSE 0 END + CASE WHEN w > 0 THEN least(2.4, 1.0 + 0.4 * w) ELSE 0 END)::DOUBLE, 6) AS score FROM hits),
chosen AS (SELECT endpoint_id, repo, path, score, row_number() OVER (PARTITION BY endpoint_id ORDER BY score DESC, path)::INT AS rank FROM scored WHERE score >= 2.0 AND (k > 0 OR w > 0) QUALIFY rank <= 2)"""


@register("related_files", f"{_RELATED} SELECT * FROM chosen WHERE score >= 4.2")
def related_files(spark, sf_dir):
    files = derive.files(spark, sf_dir).select("repo", "path").distinct()
    return related.related_files(_anchors(spark, sf_dir), files, 2).select("endpoint_id", "repo", "path", "score", "rank")


@register(
    "shown_files",
    f"WITH {sql.FILES}, r AS (SELECT repo, path, ord, CASE {sql.role('path')} WHEN 'source_route_candidate' THEN 0 WHEN 'unknown' THEN 1 END AS role FROM files) SELECT repo, path, ord, row_number() OVER (PARTITION BY repo ORDER BY role, ord)::INT AS rank FROM r WHERE role IS NOT NULL QUALIFY rank <= 5",
)
def shown_files(spark, sf_dir):
    return related.shown_files(derive.files(spark, sf_dir).withColumn("text", F.lit("x"))).select("repo", "path", "ord", "rank")


# --- contract views ---------------------------------------------------------------------------------------------

_SINK_SAYS = ("INSERT INTO orders (a)", "update `users` set x", "SELECT a FROM items", "database save", "send mail", "delete from logs")


def _view_sinks(spark, sf_dir):
    k = F.col("p_partkey")
    return derive.table(spark, sf_dir, "part").select((k % 40).alias("route_id"), k.alias("ord"), F.lit("sink").alias("kind"), _pick(_SINK_SAYS, k % 13).alias("operation"), F.lit("s").alias("name"))


_SIDE = f"""x AS (SELECT p_partkey % 40 AS route_id, p_partkey AS ord, (p_partkey % 13) % 6 AS s FROM part),
side AS (SELECT route_id, ['database_write', 'database_write', 'database_read', 'database_write', 'side_effect', 'database_write'][s + 1] AS kind, ['INSERT', 'UPDATE', 'SELECT', NULL, NULL, 'DELETE'][s + 1] AS operation,
  ['orders', 'users', 'items', NULL, NULL, 'logs'][s + 1] AS target, ['Database write orders', 'Database write users', 'Database read items', 'S', 'S', 'Database write logs'][s + 1] AS label, ['high', 'high', 'high', 'high', 'medium', 'high'][s + 1] AS confidence,
  min(ord) AS ord FROM (SELECT *, s::INT AS i FROM x) GROUP BY ALL)"""


@register("side_effects", f"WITH {_SIDE} SELECT * FROM side")
def side_effects(spark, sf_dir):
    return contract_view.side_effects(_view_sinks(spark, sf_dir))


def _view_fields(spark, sf_dir):
    k = F.col("p_partkey")
    return derive.table(spark, sf_dir, "part").select(
        (k % 40).alias("route_id"), _pick(("body", "query"), k % 3).alias("place"), F.concat(F.lit("f"), F.col("p_size") % 6).alias("field"), F.when(k % 4 == 0, "string").otherwise("unknown").alias("type"), (k % 5 == 0).alias("required"),
        _pick(contract_view.ARTIFACTS, k % 7).alias("artifact"), _pick(("grounded", "inferred", "scaffold"), k % 11).alias("grounding"), F.array(F.concat(F.lit("body.f"), F.col("p_size") % 6)).alias("exprs"),
    )


def _view_evidence(spark, sf_dir):
    k = F.col("p_partkey")
    return derive.table(spark, sf_dir, "part").filter("p_partkey % 3 = 0").select((k % 40).alias("route_id"), k.alias("ord"), F.concat(F.lit("e"), k % 2).alias("file"), (k % 3).alias("line"), F.concat(F.lit("x = body.f"), k % 7).alias("snippet"))


_FIELDS = f"""f AS (SELECT p_partkey % 40 AS route_id, {_pick_sql(('body', 'query'), '(p_partkey % 3)')} AS place, 'f' || (p_size % 6) AS field, CASE WHEN p_partkey % 4 = 0 THEN 'string' ELSE 'unknown' END AS type, p_partkey % 5 = 0 AS required,
  (p_partkey % 7) % 5 AS art, (p_partkey % 11) % 3 AS g FROM part),
e AS (SELECT DISTINCT p_partkey % 40 AS route_id, 'e' || (p_partkey % 2) AS file, p_partkey % 3 AS line, 'x = body.f' || (p_partkey % 7) AS snippet FROM part WHERE p_partkey % 3 = 0),
shown AS (SELECT f.route_id, f.place, f.field, count(e.file) AS n FROM (SELECT DISTINCT route_id, place, field FROM f) f LEFT JOIN e ON e.route_id = f.route_id AND contains(e.snippet, 'body.' || f.field) GROUP BY ALL)"""


@register("attach_evidence", f"WITH {_FIELDS} SELECT route_id, place AS kind, field, n::INT AS n FROM shown")
def attach_evidence(spark, sf_dir):
    fields = _view_fields(spark, sf_dir).select("route_id", "field", F.col("place").alias("kind"), "exprs").distinct()
    return contract_view.attach_evidence(fields, _view_evidence(spark, sf_dir)).select("route_id", "kind", "field", F.size("evidence").alias("n"))


@register(
    "contract_view",
    f"""WITH {_FIELDS}, {_SIDE},
    m AS (SELECT route_id, place, field, ['grounded', 'inferred', 'scaffold'][min(g) + 1] AS grounding, CASE WHEN bool_or(type = 'string') THEN 'string' ELSE 'unknown' END AS type FROM f GROUP BY ALL),
    req AS (SELECT route_id, string_agg(place || '.' || field || ':' || type || ':' || grounding || ':' || n, ',' ORDER BY place, field) AS request, count(*) FILTER (grounding = 'grounded') AS grounded, count(*) FILTER (grounding = 'inferred') AS inferred, count(*) FILTER (grounding = 'scaffold') AS scaffold
      FROM m JOIN shown USING (route_id, place, field) GROUP BY 1),
    eff AS (SELECT route_id, count(*) AS n FROM side GROUP BY 1), t AS (SELECT DISTINCT p_partkey % 40 AS route_id FROM part),
    c AS (SELECT route_id, request, (req.grounded + eff.n + 1)::BIGINT AS grounded, (req.inferred + 1)::BIGINT AS inferred, (req.scaffold + 1)::BIGINT AS scaffold FROM t JOIN req USING (route_id) JOIN eff USING (route_id))
    SELECT *, CASE WHEN grounded >= greatest(2, inferred + scaffold) THEN 'high' ELSE 'medium' END AS confidence, '200:inferred,404:scaffold' AS responses FROM c""",
)
def contract_view_query(spark, sf_dir):
    targets = _view_sinks(spark, sf_dir).select("route_id").distinct().withColumns({"method": F.lit("GET"), "path": F.lit("/x")})
    said = [("200", "ok", "trace_result"), ("200", "Default response", "llm_contract_refinement"), ("404", "Default response", "api_contract")]
    replies = targets.select("route_id", F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("status", "description", "artifact"), r, strict=True)]) for r in said])).alias("r")).select("route_id", "r.*")
    view = contract_view.contract_view(targets, _view_fields(spark, sf_dir), replies, _view_sinks(spark, sf_dir), _view_evidence(spark, sf_dir))
    field = lambda f: F.concat(f["place"], F.lit("."), f["field"], F.lit(":"), f["type"], F.lit(":"), f["grounding"], F.lit(":"), f["evidence"].cast("string"))
    return view.select(
        "route_id", F.array_join(F.transform("request", field), ",").alias("request"), F.array_join(F.transform("responses", lambda r: F.concat_ws(":", r["status"], r["grounding"])), ",").alias("responses"),
        "grounded", "inferred", "scaffold", "confidence",
    )


# --- tests, summaries and contracts that a model tells -------------------------------------------------------


def _told_tests(spark, sf_dir):
    k = F.col("p_partkey")
    test = F.struct(
        F.when(k % 7 != 0, F.concat(F.lit("t"), k)).alias("name"), _pick(("positive", "validation"), k).alias("category"), F.lit("says").alias("summary"), F.when(k % 5 == 0, "get").alias("method"), F.when(k % 11 == 0, "/other").alias("route"),
        F.struct(_pick(("200", "4xx", "404"), k % 13).alias("status")).alias("expected"), F.when(k % 3 == 0, F.array(F.lit("request.body.a"))).alias("contract_refs"),
    )
    answer = F.to_json(F.struct(F.array(F.struct(F.lit("g").alias("category"), F.array(test).alias("tests"))).alias("groups")))
    return derive.table(spark, sf_dir, "part").select(k.alias("trace_id"), F.lit("POST").alias("method"), F.lit("/orders/").alias("path"), (k % 4 == 0).alias("has_contract"), answer.alias("answer"))


_TOLD_TESTS = """x AS (SELECT p_partkey AS trace_id, CASE WHEN p_partkey % 7 = 0 THEN 'missing fields' WHEN p_partkey % 5 = 0 OR p_partkey % 11 = 0 THEN 'endpoint mismatch' WHEN (p_partkey % 13) % 3 = 1 THEN 'status is no number'
  WHEN p_partkey % 3 <> 0 AND NOT (p_partkey % 4 = 0 AND p_partkey % 2 = 0) THEN 'not grounded' END AS dropped, CASE WHEN p_partkey % 7 <> 0 THEN 't' || p_partkey END AS name FROM part)"""


@register("told_tests", f"WITH {_TOLD_TESTS} SELECT trace_id, name, dropped FROM x")
def told_tests(spark, sf_dir):
    return told.told_tests(_told_tests(spark, sf_dir)).select("trace_id", "name", "dropped")


@register("merge_matrices", f"WITH {_TOLD_TESTS} SELECT trace_id, name, 1 AS group_ord FROM x WHERE dropped IS NULL UNION ALL SELECT trace_id, 'own', 0 FROM x")
def merge_matrices(spark, sf_dir):
    found = told.told_tests(_told_tests(spark, sf_dir))
    own = found.select("trace_id", F.lit("own").alias("name"), F.lit(0).alias("group_ord"))
    return told.merge_matrices(own, found)


@register(
    "told_summaries",
    "SELECT event_id AS trace_id, 'n' AS name, CASE event_id % 4 WHEN 0 THEN 'no source steps' WHEN 1 THEN 'unknown source steps' WHEN 2 THEN 'no evidence' END AS dropped FROM events",
)
def told_summaries(spark, sf_dir):
    k = F.col("event_id")
    ids = F.when(k % 4 == 0, F.array().cast("array<string>")).when(k % 4 == 1, F.array(F.lit("zz"))).otherwise(F.array(F.lit("s1"), F.lit("s2")))
    item = F.struct(ids.alias("source_step_ids"), F.when(k % 4 != 2, F.array(F.lit("s1"))).alias("evidence_refs"), F.lit(" n ").alias("name"))
    answers = derive.table(spark, sf_dir, "events").select(k.alias("trace_id"), F.to_json(F.struct(F.array(item).alias("step_summaries"))).alias("answer"), F.array(F.lit("s1"), F.lit("s2")).alias("step_ids"))
    return told.told_summaries(answers).select("trace_id", "name", "dropped")


@register("told_calls", "SELECT event_id AS trace_id, 'c' || (event_id % 3) AS call, CASE WHEN event_id % 2 = 0 THEN 'high' ELSE 'low' END AS priority FROM events WHERE event_id % 3 <> 2")
def told_calls(spark, sf_dir):
    k = F.col("event_id")
    item = F.struct(F.concat(F.lit("c"), k % 3).alias("call"), _pick(("HIGH", "soon"), k).alias("priority"))
    answers = derive.table(spark, sf_dir, "events").select(k.alias("trace_id"), F.to_json(F.struct(F.array(item).alias("ranked_follow_calls"))).alias("answer"), F.array(F.lit("c0"), F.lit("c1")).alias("calls"))
    return told.told_calls(answers).select("trace_id", "call", "priority")


@register(
    "refined_contracts",
    "SELECT p_partkey AS route_id, CASE WHEN p_partkey % 5 = 0 THEN 'high' ELSE 'medium' END AS confidence, CASE p_partkey % 3 WHEN 1 THEN 'endpoint_mismatch' WHEN 2 THEN 'not an object' END AS dropped FROM part WHERE p_partkey % 3 <> 2 UNION ALL SELECT p_partkey, 'medium', 'not an object' FROM part WHERE p_partkey % 3 = 2",
)
def refined_contracts(spark, sf_dir):
    k = F.col("p_partkey")
    body = F.to_json(F.struct(_pick(("get", "POST"), k % 3).alias("method"), F.lit("/a/").alias("path"), F.when(k % 5 == 0, "high").alias("confidence")))
    answers = derive.table(spark, sf_dir, "part").select(k.alias("route_id"), F.lit("GET").alias("method"), F.lit("/a").alias("path"), F.when(k % 3 == 2, "[1]").otherwise(body).alias("answer"))
    return told.refined_contracts(answers).select("route_id", "confidence", "dropped")


@register(
    "expand_flows",
    f"""WITH s AS (SELECT event_id AS flow_id, {_pick_sql(_TOLD, 'event_id')} AS raw, event_id % 5 AS w FROM events),
    told AS (SELECT flow_id, trim(raw, ' ;') AS name FROM s WHERE w IN (2, 4) OR (w = 0 AND flow_id % 10 = 0)),
    own AS (SELECT event_id AS flow_id, 'db.add(order)' AS name FROM events WHERE event_id % 2 = 0)
    SELECT flow_id, name, count(*) AS n FROM (SELECT * FROM told UNION ALL SELECT * FROM own) GROUP BY ALL""",
)
def expand_flows(spark, sf_dir):
    k = F.col("event_id")
    own = derive.table(spark, sf_dir, "events").filter(k % 2 == 0).select(
        k.alias("flow_id"), F.lit(1).cast("long").alias("ord"), F.lit("own").alias("kind"), F.lit("db.add(order)").alias("name"), F.lit(None).cast("string").alias("symbol"), F.lit("x.py").alias("file"), F.lit("r").alias("repo")
    )
    steps, _ = told.expand_flows(own, _answers(spark, sf_dir), derive_sinks)
    return steps.groupBy("flow_id", "name").agg(F.count(F.lit(1)).alias("n"))


@register(
    "expanded_sinks",
    """SELECT event_id AS flow_id, 1 AS n FROM events""",
)
def expanded_sinks(spark, sf_dir):
    none = spark.createDataFrame([], "flow_id long, ord long, kind string, name string, symbol string, file string, repo string")
    _, sinks = told.expand_flows(none, _answers(spark, sf_dir), derive_sinks)
    return sinks.filter("action = 'write' AND name = 'orders table'").groupBy("flow_id").agg(F.count(F.lit(1)).cast("int").alias("n"))


@register(
    "evidence_packets",
    f"""WITH {_NODES}, {_EDGES}, {_TARGETS}, sinks AS (SELECT trace_id, count(DISTINCT (name, {_KIND}, file)) AS n FROM nodes WHERE type IN ('database', 'external_api', 'queue') GROUP BY 1),
    n AS (SELECT trace_id, count(*) AS n FROM nodes GROUP BY 1), e AS (SELECT trace_id, count(*) AS n FROM edges GROUP BY 1)
    SELECT trace_id, least(n.n, 40)::INT AS nodes, coalesce(least(e.n, 60), 0)::INT AS edges, coalesce(least(sinks.n, 40), 0)::INT AS sinks, ((n.n > 40)::INT + coalesce((e.n > 60)::INT, 0))::INT AS notes, n.n AS scenarios
    FROM targets JOIN n USING (trace_id) LEFT JOIN e USING (trace_id) LEFT JOIN sinks USING (trace_id)""",
)
def evidence_packets(spark, sf_dir):
    nodes, edges = trace_nodes(spark, sf_dir), trace_edges(spark, sf_dir)
    no_sinks = spark.createDataFrame([], "trace_id long, ord long, name string, kind string, repo string, file string, symbol string, snippet string, confidence double")
    places = nodes.select("trace_id", "ord", "repo", "file", F.lit(1).alias("start_line"), F.col("name").alias("text"))
    tests = nodes.select("trace_id", F.lit(0).alias("group_ord"), "ord", F.lit("g").alias("group_category"), "name", F.lit(None).cast("string").alias("category"), F.lit("high").alias("priority"), "status", F.array().cast("array<string>").alias("contract_refs"))
    packet = evidence_packet.packets(trace_targets(spark, sf_dir), nodes, edges, no_sinks, places, tests)
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    return packet.select("trace_id", size("trace_nodes").alias("nodes"), F.greatest(size("trace_edges"), F.lit(0)).alias("edges"), F.greatest(size("sinks"), F.lit(0)).alias("sinks"), F.greatest(size("notes"), F.lit(0)).alias("notes"), F.col("tests.scenarios").alias("scenarios"))


@register(
    "merge_planned",
    f"""WITH {sql.ENDPOINTS}, r AS (SELECT *, CASE WHEN ord % 9 = 0 THEN 'deterministic_plan' ELSE status END AS st FROM endpoints)
    SELECT repo, upper(method) AS method, {sql.identity('path')} AS path, coalesce(arg_min(ord, ord) FILTER (st = 'deterministic_plan'), arg_min(ord, ord) FILTER (handler IS NOT NULL), min(ord)) AS ord FROM r GROUP BY 1, 2, 3""",
)
def merge_planned(spark, sf_dir):
    rows = derive.endpoints(spark, sf_dir).withColumn("status", F.when(F.col("ord") % 9 == 0, "deterministic_plan").otherwise(F.col("status")))
    return relational.merge_planned(rows).select("repo", routes.method(F.col("method")).alias("method"), routes.path_identity(F.col("path")).alias("path"), "ord")
