"""Graphs of traces, as relations of nodes, edges and flow steps, for any number of traces at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routeloom.functions import evidence as ev
from routeloom.functions import routes, text
from routeloom.functions.kinds import any_of

NODE = (
    "trace_id long, ord long, node_id string, type string, name string, repo string, service string, file string, symbol string, method string, path string, "
    f"confidence double, status string, metadata map<string,string>, evidence {ev.EVIDENCE}"
)
EDGE = f"trace_id long, ord long, edge_id string, source string, target string, type string, repo string, service string, confidence double, status string, evidence {ev.EVIDENCE}"

# Types of nodes, and words that tell what a flow does.
SINK_TYPES = ("database", "external_api", "queue", "file_sink", "sink")
AUTH_WORDS = ("auth", "authorize", "permission", "jwt", "token")
VALIDATION_WORDS = ("validate", "validation", "schema", "required field")
LOOKUP_WORDS = (".first()", "get by id", "get_by_id", "find_by_id", "query(")
ADD_WORDS = ("db.add(", "insert", "create ", "repository.save")
COMMIT_WORDS = ("db.commit", "commit(", "save(", "flush(")
UNIQUE_WORDS = ("email", "unique", "already exists", "duplicate")
# Labels of evidence that show an expression, or a call to another service; words of clients.
EXPRESSION_LABELS = ("deterministic:db_read:", "deterministic:db_write:", "deterministic:external_call:", "deterministic:dependency:")
OUTBOUND_LABELS = ("chain_extraction:", "multiline_chain:", "partial_extraction:", "multiline_chain_partial:", "http_client_call", "outbound_client_call")
CLIENT_WORDS = ("client", "webclient", "requests", "httpx", "axios")
CLIENT_CALLS = ("fetch", ".retrieve", ".exchange", ".uri")


def selected_nodes(flow_steps: DataFrame, nodes: DataFrame) -> DataFrame:
    """The nodes of each trace's key flow (trace_id, pos, node_id), with their ``pos``; of nodes with one id the last counts."""
    return flow_steps.select("trace_id", "pos", "node_id").join(_by_id(nodes), ["trace_id", "node_id"])


def _by_id(nodes: DataFrame) -> DataFrame:
    row = F.struct(*[F.col(c) for c in nodes.columns])
    return nodes.groupBy("trace_id", "node_id").agg(F.max_by(row, "ord").alias("_row")).select("_row.*")


def key_flow(flows: DataFrame) -> DataFrame:
    """``trace_id, pos, node_id`` of the flow that a summary names, else of the first. ``flows``: trace_id, ord, flow_id, is_key, node_ids."""
    best = flows.groupBy("trace_id").agg(F.min_by("node_ids", F.struct(~F.coalesce("is_key", F.lit(False)), F.col("ord"))).alias("ids"))
    return best.select("trace_id", F.posexplode("ids").alias("pos", "node_id"))


def _said(chunks: list[Column]) -> Column:
    """All that a node says, lower case, each piece followed by a blank."""
    return F.concat(F.lower(F.concat_ws(" ", *chunks)), F.lit(" "))


def node_text(snippets: bool = False) -> Column:
    e = F.col("evidence")
    shown = [F.transform(e, lambda x: x[k]) for k in (("label", "snippet") if snippets else ("label", "symbol"))]
    return _said([F.col("name"), F.map_values("metadata"), *shown])


def resource_root(path: Column) -> Column:
    """A path's segments that are no parameters."""
    return F.concat(F.lit("/"), F.array_join(routes.static_segments(F.coalesce(path, F.lit(""))), "/"))


def crosses_repositories(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``trace_id`` of traces in which an API call leads from one repository to another."""
    end = lambda c: _by_id(nodes).filter("repo <> ''").select("trace_id", F.col("node_id").alias(c), F.col("repo").alias(f"_{c}"))
    calls = edges.filter("type = 'CALLS_API'").select("trace_id", "source", "target")
    return calls.join(end("source"), ["trace_id", "source"]).join(end("target"), ["trace_id", "target"]).filter("_source <> _target").select("trace_id").distinct()


def trace_facts(targets: DataFrame, nodes: DataFrame, flow_steps: DataFrame, edges: DataFrame) -> DataFrame:
    """``targets`` (trace_id, method, path) with what their graphs show, as scenario rules take it, and ``lookup, returns, has_steps, sinks_seen``."""
    any_ = lambda c: F.coalesce(F.max(F.coalesce(c, F.lit(False))), F.lit(False))
    action, kind = F.col("metadata")["action"], F.col("type")
    root, wanted = resource_root(F.col("path")), F.col("_root")
    roots = targets.select("trace_id", resource_root(F.col("path")).alias("_root"))
    whole = nodes.join(roots, "trace_id").groupBy("trace_id").agg(
        any_((kind == "database") & (action == "write")).alias("db_write"), any_((kind == "database") & (action == "read")).alias("db_read"),
        any_(kind == "external_api").alias("external"), any_(kind == "queue").alias("queue"), any_(kind.isin(*SINK_TYPES[:4])).alias("sinks_seen"),
        any_((kind == "api_endpoint") & (F.upper("method") == "GET") & (root.startswith(wanted) | wanted.startswith(root))).alias("explicit_get"),
    )
    flow = selected_nodes(flow_steps, nodes)
    step = ~kind.isin("api_endpoint", *SINK_TYPES) & (F.coalesce("name", F.lit("")) != "")
    name, said = F.lower(routes.strip(F.col("name"))), node_text()
    along = flow.groupBy("trace_id").agg(
        any_(step & any_of(name, AUTH_WORDS)).alias("auth"), any_(step & any_of(name, VALIDATION_WORDS)).alias("validated"),
        any_(step & (name.startswith("return ") | name.contains(" return "))).alias("returns"), any_(step).alias("has_steps"),
        *[any_(any_of(said, words)).alias(c) for c, words in (("lookup", LOOKUP_WORDS), ("db_add", ADD_WORDS), ("db_commit", COMMIT_WORDS), ("unique", UNIQUE_WORDS))],
    )
    crossing = crosses_repositories(nodes, edges).withColumn("cross_repo", F.lit(True))
    facts = [c for df in (whole, along, crossing) for c in df.columns if c != "trace_id"]
    joined = targets.join(whole, "trace_id", "left").join(along, "trace_id", "left").join(crossing, "trace_id", "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in facts})


# --- expressions and HTTP details -----------------------------------------------------------------------


def expression(evidence: Column) -> Column:
    """What the first label that shows an expression says."""
    shown = F.transform(evidence, lambda e: F.coalesce(*[F.when(e["label"].startswith(p), routes.blank_to_null(F.trim(F.substring(e["label"], len(p) + 1, 10_000)))) for p in EXPRESSION_LABELS]))
    return F.try_element_at(F.filter(shown, lambda s: s.isNotNull()), F.lit(1))


def operation(name: Column, evidence: Column) -> Column:
    """A step's or a sink's expression, else its name if that reads like code."""
    bare = F.trim(F.coalesce(name, F.lit("")))
    return F.coalesce(expression(evidence), F.when(bare.rlike(r"[.()]"), bare))


def queried_entity(code: Column) -> Column:
    """``X`` of ``db.query(X)``."""
    return routes.blank_to_null(F.regexp_extract(code, r"(?i)\bdb\s*\.\s*query\(\s*([a-z_]\w*)\s*\)", 1))


def http_details(method: Column, path: Column, raw: Column) -> Column:
    """``struct(method, path, url)`` of a call: its own method and path, else those that its text shows."""
    shown = F.coalesce(raw, F.lit(""))
    verb = routes.blank_to_null(F.upper(F.regexp_extract(shown, rf"(?i)\.({'|'.join(routes.CALL_VERBS)})\s*\(", 1)))
    uri = routes.blank_to_null(F.regexp_extract(shown, r"""(?i)\.uri\s*\(\s*["']([^"']+)["']\s*\)""", 1))
    url = routes.blank_to_null(F.regexp_extract(shown, r"""(?i)["'](https?://[^"']+)["']""", 1))
    of_url = routes.blank_to_null(F.regexp_extract(url, r"(?i)^https?://[^/?#]*([^?#]*)", 1))
    found = F.coalesce(path, uri, of_url)
    return F.struct(F.coalesce(method, verb).alias("method"), F.when(found != "", routes._rooted(found)).otherwise(found).alias("path"), url.alias("url"))


def has_outbound_evidence(raw: Column, evidence: Column) -> Column:
    """Whether a call shows a client at work, and no declaration."""
    labels = F.transform(evidence, lambda e: F.coalesce(e["label"], F.lit("")))
    declared = F.exists(labels, lambda s: s.contains("route_declaration"))
    told = F.exists(labels, lambda s: F.coalesce(*[F.when(s.startswith(p), True) for p in OUTBOUND_LABELS], F.lit(False)))
    low = F.lower(F.coalesce(raw, F.lit("")))
    spoken = F.arrays_overlap(F.split(low, r"\W+"), F.array(*map(F.lit, CLIENT_WORDS))) | any_of(F.regexp_replace(low, r"\s+\(", "("), [f"{c}(" for c in CLIENT_CALLS])
    return ~declared & (told | spoken)


def call_sources(calls: DataFrame, nodes: DataFrame) -> DataFrame:
    """``calls`` (trace_id, repo, file, symbol, …) with ``source``: the node a call comes from, and ``source_type``.

    In this order: the step of its symbol, a step of its file, the endpoint of its file, an endpoint of its repository, any endpoint; of several the
    first. Each tier is one equi-join with the first node of its key.
    """
    full = lambda c: F.nullif(F.col(c), F.lit(""))
    c = calls.withColumns({"_repo": full("repo"), "_file": full("file"), "_symbol": full("symbol")})
    own = nodes.select("trace_id", "ord", "node_id", "type", full("repo").alias("_repo"), full("file").alias("_file"), full("symbol").alias("_symbol"))
    tiers = [("internal_step", ["_repo", "_file", "_symbol"]), ("internal_step", ["_repo", "_file"]), ("api_endpoint", ["_repo", "_file"]), ("api_endpoint", ["_repo"]), ("api_endpoint", [])]
    found = []
    for i, (kind, key) in enumerate(tiers):
        first = own.filter(F.col("type") == kind).groupBy("trace_id", *key).agg(F.min_by(F.struct("node_id", "type"), "ord").alias(f"_t{i}"))
        c = c.join(first, ["trace_id", *key], "left")
        found.append(F.col(f"_t{i}"))
    return c.withColumn("_source", F.coalesce(*found)).withColumns({"source": F.col("_source.node_id"), "source_type": F.col("_source.type")}).select(*calls.columns, "source", "source_type")


def add_links(nodes: DataFrame, edges: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``nodes`` and ``edges`` with those of links from calls to endpoints: an API edge each, and the endpoint, where they are not there yet.

    ``links``: trace_id, ord, repo, file, symbol, raw, evidence (of the call), target (struct of an endpoint: repo, file, method, path, handler, service, confidence,
    status, evidence), link_type, confidence. A link within one repository needs evidence of a client; one whose call has no source is left out.
    """
    t = F.col("target")
    sourced = call_sources(links, nodes).filter("source IS NOT NULL").withColumn("_target", text.node_id("endpoint", t["repo"], t["file"], t["path"], t["method"]))
    same = (F.coalesce("repo", F.lit("")) != "") & (F.col("repo") == t["repo"])
    good = sourced.filter(~F.coalesce(same, F.lit(False)) | has_outbound_evidence(F.col("raw"), F.col("evidence")))
    good = good.withColumn("edge_id", F.concat_ws(":", F.lit("edge"), F.lit("cross_repo"), text.id_token(F.col("source")), text.id_token(F.col("_target"))))
    shown = F.struct(F.coalesce("file", F.lit("?")).alias("file"), "symbol", F.lit("webclient_call").alias("label"), text.snippet(F.col("raw")).alias("snippet"))
    own = F.filter(F.array(shown), lambda e: F.coalesce(e["snippet"], F.lit("")) != "")
    fresh = good.groupBy("trace_id", "edge_id").agg(F.min_by(F.struct(*[F.col(c) for c in good.columns if c not in ("trace_id", "edge_id")]), "ord").alias("g")).select("trace_id", "edge_id", "g.*")
    fresh = fresh.join(edges.select("trace_id", "edge_id").distinct(), ["trace_id", "edge_id"], "left_anti")
    made_edges = fresh.select(
        "trace_id", (F.col("ord") + F.lit(1 << 40)).alias("ord"), "edge_id", "source", F.col("_target").alias("target"), F.lit("CALLS_API").alias("type"), "repo", t["service"].alias("service"), "confidence",
        F.lit("inferred").alias("status"), F.array_distinct(F.concat(F.coalesce("evidence", F.array().cast(ev.EVIDENCE)), own)).cast(ev.EVIDENCE).alias("evidence"),
    )
    first = good.groupBy("trace_id", "_target").agg(F.min_by(F.struct("ord", "target", "link_type"), "ord").alias("g")).withColumnRenamed("_target", "node_id")
    e = F.col("g.target")
    made_nodes = first.join(nodes.select("trace_id", "node_id").distinct(), ["trace_id", "node_id"], "left_anti").select(
        "trace_id", (F.col("g.ord") + F.lit(1 << 40)).alias("ord"), "node_id", F.lit("api_endpoint").alias("type"), F.coalesce(e["path"], e["file"]).alias("name"), e["repo"].alias("repo"), e["service"].alias("service"), e["file"].alias("file"),
        e["handler"].alias("symbol"), e["method"].alias("method"), e["path"].alias("path"), e["confidence"].alias("confidence"), e["status"].alias("status"),
        F.create_map(F.lit("cross_repo_linked"), F.lit("true"), F.lit("link_type"), F.col("g.link_type")).alias("metadata"), e["evidence"].alias("evidence"),
    )
    return nodes.select(*made_nodes.columns).unionByName(made_nodes), edges.select(*made_edges.columns).unionByName(made_edges)


def enrich(nodes: DataFrame, edges: DataFrame, calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``nodes`` and ``edges`` with what calls (trace_id, ord, repo, file, symbol, method, path, raw, evidence) tell of them.

    The step that a call comes from, the external edges out of it and the services they lead to get its method, path, URL and operation where they have
    none, the first call's first, and its evidence. A service is named after the last path that is called on it.
    """
    sourced = call_sources(calls, nodes).withColumn("d", http_details(F.col("method"), F.col("path"), F.col("raw")))
    d = F.col("d")
    said = F.when(d["method"].isNotNull() & d["path"].isNotNull(), F.concat_ws(" ", F.lit("WebClient"), d["method"], d["path"])).when(d["method"].isNotNull(), F.concat_ws(" ", F.lit("WebClient"), d["method"])).when(
        d["path"].isNotNull(), F.concat_ws(" ", F.lit("WebClient call"), d["path"])
    )
    shown = F.struct(F.coalesce("file", F.lit("?")).alias("file"), "symbol", F.lit("webclient_call").alias("label"), text.snippet(F.col("raw")).alias("snippet"))
    pieces = F.concat(F.filter(F.array(shown), lambda e: F.coalesce(e["snippet"], F.lit("")) != ""), F.coalesce("evidence", F.array().cast(ev.EVIDENCE)))
    told = sourced.select("trace_id", "ord", "source", "source_type", d["method"].alias("m"), d["path"].alias("p"), d["url"].alias("u"), said.alias("o"), pieces.alias("e"))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("ord")))
    gather = lambda df, *key: df.groupBy(*key).agg(
        *[first(c).alias(f"_{c}") for c in ("m", "p", "u", "o")], F.max_by("p", F.when(F.col("p").isNotNull(), F.col("ord"))).alias("_last"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ord", "e"))), lambda x: x["e"])).alias("_e"),
    )
    by_source = gather(told.filter("source IS NOT NULL"), "trace_id", "source")
    external = edges.filter("type = 'CALLS_EXTERNAL'").select("trace_id", "source", "target").distinct()
    steps = gather(told.filter("source_type = 'internal_step'"), "trace_id", "source").withColumnRenamed("source", "node_id").withColumns({"_role": F.lit("step"), "type": F.lit("internal_step")})
    sinks = gather(told.join(external, ["trace_id", "source"]), "trace_id", "target").withColumnRenamed("target", "node_id").withColumns({"_role": F.lit("sink"), "type": F.lit("external_api")})
    both = nodes.join(steps.unionByName(sinks), ["trace_id", "node_id", "type"], "left")
    role = F.col("_role")
    have = F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda k, v: F.coalesce(v, F.lit("")) != "")
    have = F.when(role == "step", F.map_filter(have, lambda k, v: ~((k == "step_kind") & (v == "unknown")))).otherwise(have)
    offers = [("step_kind", F.when(role == "step", "external_api_call")), ("sink_kind", F.when(role == "sink", "external_api")), ("action", F.when(role == "sink", "read"))]
    offers += [("operation", F.col("_o")), ("http_method", F.col("_m")), ("target_path", F.col("_p")), ("target_url", F.col("_u"))]
    extra = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in offers]), lambda x: x["value"].isNotNull() & ~F.map_contains_key(have, x["key"]))
    joined = lambda old: F.array_distinct(F.concat(F.coalesce(old, F.array().cast(ev.EVIDENCE)), "_e")).cast(ev.EVIDENCE)
    out = both.withColumns({
        "metadata": F.when(role.isNotNull(), F.map_concat(have, F.map_from_entries(extra))).otherwise(F.col("metadata")),
        "name": F.when((role == "sink") & F.col("_last").isNotNull(), F.col("_last")).otherwise(F.col("name")),
        "evidence": F.when(role.isNotNull(), joined(F.col("evidence"))).otherwise(F.col("evidence")),
    })
    touched = edges.join(by_source.select("trace_id", "source", "_e"), ["trace_id", "source"], "left")
    outbound = (F.col("type") == "CALLS_EXTERNAL") & F.col("_e").isNotNull()
    return out.select(*nodes.columns), touched.withColumn("evidence", F.when(outbound, joined(F.col("evidence"))).otherwise(F.col("evidence"))).select(*edges.columns)
