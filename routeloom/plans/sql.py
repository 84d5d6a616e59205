"""The derived relations of :mod:`derive`, and shared expressions, in the SQL of the oracle."""

MOUNTS = """
mounts AS (
  SELECT r_regionkey::BIGINT AS mount_id, 'app' AS parent, CASE WHEN r_regionkey <> 4 THEN 'region:' || r_regionkey END AS child, '/' || lower(r_name) || '/' AS prefix FROM region
  UNION ALL
  SELECT n_nationkey + 100, 'region:' || n_regionkey, 'nation:' || n_nationkey, '//' || lower(n_name) FROM nation WHERE n_nationkey % 7 <> 3)"""


def _routes(table, key, nation, balance, stem, offset):
    return f"""
  SELECT ({key} + {offset})::BIGINT AS ord, k.verb AS method,
    CASE {key} % 3 WHEN 0 THEN '/{stem}/:id/' || ({key} % 50) WHEN 1 THEN '/{stem}/<int:id>/' || ({key} % 50) ELSE '{stem}/' || ({key} % 50) || '/' END AS path,
    CASE WHEN {key} % 13 <> 0 THEN '{stem}_handler_' || ({key} % 20) END AS handler,
    CASE WHEN {key} % 17 = 0 THEN 'tests/test_' || ({key} % 5) || '.py' ELSE 'src/nation_' || {nation} || '.py' END AS file,
    '{stem}-repo' AS repo, CASE WHEN {key} % 6 <> 0 THEN 'svc' || {nation} END AS service,
    CASE WHEN {key} % 11 <> 0 THEN round(({balance} + 1000) / 11000, 2) END AS confidence,
    CASE WHEN {key} % 5 = 0 THEN 'deterministic' WHEN {key} % 5 <> 1 THEN 'llm' END AS status,
    CASE {key} % 5 WHEN 0 THEN '@app.' || k.verb || '(''/x'')' WHEN 1 THEN 'client.' || k.verb || '(''/x'')' ELSE 'seen' END AS label,
    'nation:' || {nation} AS container
  FROM {table}, LATERAL (SELECT ['get', 'post', 'put', 'delete'][({key} % 4 + 1)::INT] AS verb) k"""


ENDPOINTS = f"""
endpoints AS ({_routes('customer', 'c_custkey', 'c_nationkey', 'c_acctbal', 'customers', 0)}
  UNION ALL {_routes('supplier', 's_suppkey', 's_nationkey', 's_acctbal', 'suppliers', 100000000)})"""

CALLS = """
calls AS (
  SELECT o_orderkey AS call_id, CASE o_orderkey % 4 WHEN 0 THEN 'GET' WHEN 1 THEN 'requests.put' WHEN 2 THEN 'head' END AS method,
    CASE o_orderkey % 5 WHEN 0 THEN 'https://api.svc' || (o_orderkey % 25) || '.example.com/customers/' || (o_custkey % 50) || '?q=1#top'
      WHEN 1 THEN '//customers//' || (o_custkey % 50) || '/' WHEN 2 THEN '''/suppliers/' || (o_custkey % 50) || '''' WHEN 3 THEN '/nowhere/' || (o_custkey % 50) END AS path,
    CASE WHEN o_orderkey % 3 = 0 THEN ' Svc' || (o_orderkey % 25) END AS service,
    CASE WHEN o_orderkey % 7 <> 0 THEN round((o_orderkey % 10) / 10.0::DOUBLE, 1) END AS confidence
  FROM orders)"""

STEPS = """
steps AS (
  SELECT user_id AS flow_id, event_id AS ord, ts, event_type, value, props,
    CASE event_type WHEN 'purchase' THEN 'db_write' WHEN 'view' THEN 'return' WHEN 'error' THEN 'branch' WHEN 'click' THEN 'await_call' ELSE 'signup' END AS kind
  FROM events)"""

FILES = """
files AS (
  SELECT p_brand AS repo, p_size::BIGINT AS size, p_partkey AS ord,
    ['src/routes/user', 'app/main', 'tests/test_api', 'docs/guide', 'lib/util', 'api/controllers/item', 'server', 'pkg/view_model'][(p_partkey % 8 + 1)::INT]
    || CASE WHEN p_partkey % 4 <> 0 THEN '_' || (p_partkey % 100) ELSE '' END
    || ['.py', '.ts', '.js', '.md', '.go', '.java', '', '.test.ts', '.rb'][(p_partkey % 9 + 1)::INT] AS path
  FROM part)"""


def path(c):
    """Path with leading slash and one trailing slash off; blank is null."""
    t = f"nullif(trim({c}), '')"
    return f"regexp_replace(CASE WHEN {t} LIKE '/%' THEN {t} ELSE '/' || {t} END, '(.)/$', '\\1')"


def identity(c):
    return path(f"regexp_replace(regexp_replace({path(c)}, '<(?:[^:>]+:)?([^>]+)>', '{{\\1}}', 'g'), ':([A-Za-z_]\\w*)', '{{\\1}}', 'g')")


def verb(c):
    return f"nullif(upper(regexp_extract(lower({c}), '\\b(get|post|put|delete|patch)\\b', 1)), '')"


def api_path(c):
    bare = f"regexp_replace(trim(trim({c}), '\"'''), '^https?://[^/?#]*', '')"
    cut = f"nullif(regexp_extract({bare}, '^[^?#]*', 0), '')"
    return f"regexp_replace(regexp_replace(CASE WHEN {cut} LIKE '/%' THEN {cut} ELSE '/' || {cut} END, '/+', '/', 'g'), '(.)/$', '\\1')"


SUFFIX = "regexp_extract(lower({c}), '[^./](\\.[^./]+)$', 1)"


def suffix(c):
    return SUFFIX.replace("{c}", c)


def role(c):
    low, name = f"lower({c})", f"regexp_extract(lower({c}), '[^/]*$', 0)"
    return (
        f"CASE WHEN {low} LIKE '%docs/%' OR regexp_matches({name}, '\\.(md|rst|adoc)$') THEN 'docs_candidate' "
        f"WHEN regexp_matches({low}, '(^|/)(tests|test|__tests__|spec)(/|$)') OR regexp_matches({name}, '^test_.*\\.py$|_test\\.py$|\\.(test|spec)\\.(ts|js|jsx|tsx)$') THEN 'test_usage_candidate' "
        f"WHEN {suffix(c)} IN ('.py', '.js', '.ts', '.jsx', '.tsx', '.java', '.go', '.rb', '.php', '.cs', '.kt') THEN 'source_route_candidate' ELSE 'unknown' END"
    )
