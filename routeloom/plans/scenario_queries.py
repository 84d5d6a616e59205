"""Queries on scenarios and contracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from routeloom.functions import kinds, routes
from routeloom.operators import contracts, files, relational, scenarios
from routeloom.plans import derive, sql
from routeloom.plans.queries import register

_METHODS = ("GET", "POST", "PUT", "DELETE", "patch", "HEAD")
_PATHS = ("/v1/categories", "/orders/{id}", "/user-items", "/users/<int:id>", "/", "/status/:code")


def _pick(values, key):
    return F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int"))


def _facts(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size")
    flags = {f: (k * (i + 3) + s) % (i + 2) == 0 for i, f in enumerate(scenarios.FACTS)}
    return derive.table(spark, sf_dir, "part").select(k.alias("endpoint_id"), _pick(_METHODS, k).alias("method"), _pick(_PATHS, s).alias("path"), *[c.alias(f) for f, c in flags.items()])


_FACT_SQL = f"""facts AS (SELECT *, upper(method) AS m, upper(method) = 'POST' AS post, upper(method) = 'GET' AS get, upper(method) IN ('PUT', 'PATCH') AS "update", upper(method) = 'DELETE' AS "delete",
  contains(path, '{{') OR contains(path, ':') AS id_param, explicit_get OR (db_write AND upper(method) IN ('POST', 'PUT', 'PATCH')) AS fetchable,
  CASE path WHEN '/v1/categories' THEN 'category' WHEN '/orders/{{id}}' THEN 'order' WHEN '/user-items' THEN 'user item' WHEN '/users/<int:id>' THEN '<int:id>' WHEN '/' THEN 'record' ELSE 'statu' END AS e,
  CASE path WHEN '/v1/categories' THEN 'categories' WHEN '/orders/{{id}}' THEN 'orders' WHEN '/user-items' THEN 'user items' WHEN '/users/<int:id>' THEN 'users' WHEN '/' THEN 'data' ELSE 'status' END AS w,
  lower(method) || '_' || CASE path WHEN '/v1/categories' THEN 'v1_categories' WHEN '/orders/{{id}}' THEN 'orders_id' WHEN '/user-items' THEN 'user_items' WHEN '/users/<int:id>' THEN 'users_int_id' WHEN '/' THEN 'root' ELSE 'status_code' END || '_' AS stem
  FROM (SELECT p_partkey AS endpoint_id, {list(_METHODS)}[(p_partkey % {len(_METHODS)} + 1)::INT] AS method, {list(_PATHS)}[(p_size % {len(_PATHS)} + 1)::INT] AS path,
    {", ".join(f"(p_partkey * {i + 3} + p_size) % {i + 2} = 0 AS \"{f}\"" for i, f in enumerate(scenarios.FACTS))} FROM part))"""


def _rule_sql(i, rule):
    category, cond, name, summary, _, _, _ = rule
    cond = cond.replace("update", '"update"').replace("delete", '"delete"').replace("unique", '"unique"')
    fill = lambda t: "'" + t.replace("{m}", "' || m || '").replace("{r}", "' || path || '").replace("{e}", "' || e || '").replace("{w}", "' || w || '").replace("{u}", "unique_field").replace("{v}", "unique field") + "'"
    return f"SELECT endpoint_id, {scenarios.CATEGORY_ORDER.index(category)} AS rank, {i} AS rule, stem || {fill(name)} AS name, {fill(summary)} AS summary FROM facts WHERE {cond}"


@register(
    "generate_scenarios",
    f"WITH {_FACT_SQL}, made AS ({' UNION ALL '.join(_rule_sql(i, r) for i, r in enumerate(scenarios.RULES))}) "
    "SELECT endpoint_id, (row_number() OVER (PARTITION BY endpoint_id ORDER BY rank, rule) - 1)::INT AS pos, name, summary FROM made QUALIFY pos < 7",
)
def generate_scenarios(spark, sf_dir):
    return scenarios.generate_scenarios(_facts(spark, sf_dir)).select("endpoint_id", "pos", "name", "summary")


@register(
    "scenario_caps",
    f"WITH {_FACT_SQL} SELECT endpoint_id, CASE WHEN contains(path, '/status') THEN 2 WHEN m IN ('POST', 'PUT', 'PATCH', 'DELETE') THEN 12 ELSE 8 END AS cap, "
    "CASE WHEN m = 'POST' THEN '201' WHEN m = 'DELETE' THEN '204' ELSE '200' END AS status, m = 'POST' OR \"update\" AS has_body FROM facts",
)
def scenario_caps(spark, sf_dir):
    c = contracts.scaffold(_facts(spark, sf_dir))
    return c.select("endpoint_id", scenarios.scenario_cap(F.col("method"), F.col("path")).alias("cap"), F.element_at("statuses", 1).alias("status"), F.col("body").isNotNull().alias("has_body"))


@register(
    "success_statuses",
    f"WITH {_FACT_SQL}, s AS (SELECT endpoint_id, m, endpoint_id % 3 AS k FROM facts) SELECT endpoint_id, CASE m WHEN 'POST' THEN CASE WHEN k = 0 THEN '201' ELSE '200' END WHEN 'GET' THEN '200' "
    "WHEN 'DELETE' THEN CASE WHEN k = 1 THEN '204' ELSE '200' END WHEN 'HEAD' THEN CASE k WHEN 0 THEN '201' WHEN 1 THEN '204' ELSE '202' END ELSE '204' END AS status FROM s",
)
def success_statuses(spark, sf_dir):
    k = F.col("endpoint_id") % 3
    has = F.when(k == 0, F.array(F.lit("404"), F.lit("201"))).when(k == 1, F.array(F.lit("204"))).otherwise(F.array(F.lit("202")))
    return _facts(spark, sf_dir).select("endpoint_id", kinds.success_status(F.col("method"), has).alias("status"))


@register(
    "match_contracts",
    f"""WITH {sql.ENDPOINTS}, c AS (SELECT s_suppkey AS contract_ord, ['GET', 'POST'][(s_suppkey % 2 + 1)::INT] AS m, '/customers/{{id}}/' || (s_suppkey % 50) AS p FROM supplier),
        j AS (SELECT e.ord, upper(e.method) = c.m AS exact, c.contract_ord FROM endpoints e LEFT JOIN c ON {sql.identity('e.path')} = c.p)
        SELECT ord AS route_id, coalesce(min(contract_ord) FILTER (exact), min(contract_ord), -1) AS contract_ord, coalesce(CASE WHEN bool_or(exact) THEN 'exact' WHEN count(contract_ord) > 0 THEN 'path_only' END, '') AS match FROM j GROUP BY ord""",
)
def match_contracts(spark, sf_dir):
    k = F.col("s_suppkey")
    c = derive.table(spark, sf_dir, "supplier").select(k.alias("contract_ord"), _pick(("GET", "POST"), k).alias("method"), F.concat(F.lit("/customers/:id/"), (k % 50).cast("string")).alias("path"))
    r = derive.endpoints(spark, sf_dir).select(F.col("ord").alias("route_id"), "method", "path")
    return contracts.match_contract(r, c).select("route_id", F.coalesce("contract_ord", F.lit(-1)).alias("contract_ord"), F.coalesce("match", F.lit("")).alias("match"))


@register(
    "uncovered_statuses",
    "SELECT DISTINCT l_orderkey AS endpoint_id, ['200', '404', '500'][(l_partkey % 3 + 1)::INT] AS status FROM lineitem WHERE NOT (l_partkey % 3 = 0) AND NOT (l_partkey % 3 = 1 AND l_orderkey % 2 = 0)",
)
def uncovered_statuses(spark, sf_dir):
    line = derive.table(spark, sf_dir, "lineitem")
    has = line.select(F.col("l_orderkey").alias("endpoint_id")).distinct().withColumn("statuses", F.when(F.col("endpoint_id") % 2 == 0, F.array(F.lit("200"), F.lit("404"))).otherwise(F.array(F.lit("200"))))
    return contracts.uncovered_statuses(has, line.select(F.col("l_orderkey").alias("endpoint_id"), _pick(("200", "404", "500"), F.col("l_partkey")).alias("status")))


@register(
    "path_labels",
    f"WITH {_FACT_SQL} SELECT endpoint_id, e AS entity, w AS words, stem AS stem FROM facts",
)
def path_labels(spark, sf_dir):
    p = F.col("path")
    return _facts(spark, sf_dir).select("endpoint_id", routes.entity_label(p).alias("entity"), scenarios.resource_words(p).alias("words"), F.concat(F.lower("method"), F.lit("_"), routes.route_token(p), F.lit("_")).alias("stem"))


@register(
    "top_scenarios",
    "SELECT l_orderkey AS endpoint, l_partkey * 100000 + l_suppkey * 10 + l_linenumber AS ord, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_partkey * 100000 + l_suppkey * 10 + l_linenumber)::INT AS rank FROM lineitem QUALIFY rank <= 2",
)
def top_scenarios(spark, sf_dir):
    t = derive.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("endpoint"), (F.col("l_partkey") * 100000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("ord"), "l_quantity")
    return relational.top_k(t, ["endpoint"], [F.col("l_quantity").desc(), F.col("ord")], 2).select("endpoint", "ord", "rank")


@register(
    "repository_map",
    f"""WITH {sql.FILES} SELECT repo, count(*) AS total_files, count(*) FILTER (NOT path LIKE '%.zzz') AS included, 0::BIGINT AS skipped,
        coalesce(string_agg(DISTINCT path, ',' ORDER BY path) FILTER (regexp_matches(path, '(^|/)(main\\.py|main\\.go|server\\.ts|server\\.js)$')), '') AS entry_points FROM files GROUP BY repo""",
)
def repository_map(spark, sf_dir):
    m = files.repository_map(derive.files(spark, sf_dir))
    return m.select("repo", "total_files", "included", "skipped", F.array_join("entry_points", ",").alias("entry_points"))


@register(
    "folder_map",
    f"""WITH {sql.FILES}, f AS (SELECT repo, CASE WHEN contains(path, '/') THEN regexp_extract(path, '^(.*)/[^/]*$', 1) ELSE '.' END AS folder, count(*) AS files FROM files GROUP BY 1, 2)
        SELECT repo, folder, files, CASE folder WHEN 'src/routes' THEN 'path:routes,path:src' WHEN 'app' THEN 'path:app' WHEN 'tests' THEN 'path:tests' WHEN 'docs' THEN 'path:docs' WHEN 'api/controllers' THEN 'path:api,path:controllers' ELSE '' END AS signals,
          folder IN ('src/routes', 'api/controllers') AS is_route FROM f""",
)
def folder_map(spark, sf_dir):
    m = files.folder_map(derive.files(spark, sf_dir))
    return m.select("repo", "folder", "files", F.array_join("signals", ",").alias("signals"), "is_route")


@register(
    "contract_scenarios",
    f"""WITH {_FACT_SQL}, k AS (SELECT endpoint_id, m, path, stem, CASE WHEN m = 'POST' THEN '201' WHEN m = 'DELETE' THEN '204' ELSE '200' END AS ok, endpoint_id % 2 = 0 AS auth, endpoint_id % 3 = 0 AS db,
          CASE WHEN id_param THEN CASE WHEN path LIKE '%code%' THEN 'code' ELSE 'id' END END AS p, path LIKE '%<int%' AS num FROM facts),
        r AS (SELECT endpoint_id, 1 AS o, stem || 'contract_happy_path' AS name, ok AS status FROM k
          UNION ALL SELECT endpoint_id, 2, stem || 'invalid_path_param_' || p, '400' FROM k WHERE num UNION ALL SELECT endpoint_id, 3, stem || 'not_found_for_missing_' || p, '404' FROM k WHERE m = 'GET' AND p = 'id'
          UNION ALL SELECT endpoint_id, 4, stem || 'missing_authorization', '401' FROM k WHERE auth UNION ALL SELECT endpoint_id, 5, stem || 'invalid_authorization', '401' FROM k WHERE auth
          UNION ALL SELECT endpoint_id, 6, stem || 'response_schema_validation', ok FROM k UNION ALL SELECT endpoint_id, 7, stem || 'database_failure_handled', '500' FROM k WHERE db)
        SELECT endpoint_id, (row_number() OVER (PARTITION BY endpoint_id ORDER BY o) - 1)::INT AS pos, name, status FROM r""",
)
def contract_scenarios(spark, sf_dir):
    none = F.array().cast("array<string>")
    c = contracts.scaffold(_facts(spark, sf_dir)).withColumns({
        "body_fields": F.lit(None).cast("array<struct<name:string,type:string,format:string,required:boolean>>"), "query_params": F.lit(None).cast("array<struct<name:string,type:string,required:boolean>>"),
        "has_auth": F.col("endpoint_id") % 2 == 0, "response_fields": none, "sinks": F.when(F.col("endpoint_id") % 3 == 0, F.array(F.lit("database"))).otherwise(none),
    })
    return scenarios.contract_scenarios(c).select("endpoint_id", "pos", "name", "status")
