"""Evidence packets: what of a trace is shown to a model, in bounded size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from routeloom.functions import routes, text
from routeloom.operators.graph import running_budget
from routeloom.operators.relational import first_per_key, top_k

# Metadata that names a node's kind or shows its code, in the order looked at; nodes that count as sinks; sizes.
KIND_KEYS = ("step_kind", "kind", "layer", "action")
SNIPPET_KEYS = ("snippet", "expression", "detail", "operation")
SINK_KINDS = ("store_write", "database_write", "database_read")
SINK_TYPES = ("database", "external_api", "queue", "file_sink")
MAX_NODES, MAX_EDGES, MAX_SCENARIOS, MAX_SOURCE_CHARS, SNIPPET_CHARS = 40, 60, 12, 8_000, 600


def node_kind(kind: Column, metadata: Column) -> Column:
    return F.coalesce(*[routes.blank_to_null(routes.strip(metadata[k])) for k in KIND_KEYS], kind)


def best_snippet(evidence: Column, metadata: Column | None = None) -> Column:
    """The first snippet or label of evidence, else the first piece of code in the metadata, on one line."""
    filled = lambda c: F.when(c != "", c)
    shown = F.filter(F.transform(evidence, lambda e: F.coalesce(filled(e["snippet"]), filled(e["label"]))), lambda s: s.isNotNull())
    said = [routes.blank_to_null(routes.strip(metadata[k])) for k in SNIPPET_KEYS] if metadata is not None else []
    return text.snippet(F.coalesce(F.try_element_at(shown, F.lit(1)), *said), SNIPPET_CHARS)


def packet_nodes(nodes: DataFrame, limit: int = MAX_NODES) -> DataFrame:
    """The first ``limit`` nodes of each trace, compacted: ``trace_id, rank, node_id, type, name, kind, repo, file, symbol, snippet, confidence, status``."""
    return top_k(nodes, ["trace_id"], [F.col("ord")], limit).select(
        "trace_id", "rank", "node_id", "type", "name", node_kind(F.col("type"), F.col("metadata")).alias("kind"), "repo", "file", "symbol",
        best_snippet(F.col("evidence"), F.col("metadata")).alias("snippet"), "confidence", "status",
    )


def packet_edges(edges: DataFrame, limit: int = MAX_EDGES) -> DataFrame:
    """The first ``limit`` edges of each trace: ``trace_id, rank, edge_id, source, target, type, snippet, confidence``."""
    return top_k(edges, ["trace_id"], [F.col("ord")], limit).select("trace_id", "rank", "edge_id", "source", "target", "type", best_snippet(F.col("evidence")).alias("snippet"), "confidence")


def packet_sinks(sinks: DataFrame, nodes: DataFrame) -> DataFrame:
    """``trace_id, ord, name, kind, repo, file, symbol, snippet, confidence``: sinks (trace_id, ord, name, kind, repo, file, symbol, snippet, confidence), then
    nodes that are some, one for each name, kind and file."""
    kind = node_kind(F.col("type"), F.col("metadata"))
    seen = nodes.filter(kind.isin(*SINK_KINDS) | F.col("type").isin(*SINK_TYPES)).select(
        "trace_id", (F.col("ord") + F.lit(1 << 40)).alias("ord"), "name", kind.alias("kind"), "repo", "file", "symbol", best_snippet(F.col("evidence"), F.col("metadata")).alias("snippet"), "confidence"
    )
    return first_per_key(sinks.select(*seen.columns).unionByName(seen), ["trace_id", "name", "kind", "file"], F.col("ord"))


def packet_notes(nodes: DataFrame, edges: DataFrame, max_nodes: int = MAX_NODES, max_edges: int = MAX_EDGES) -> DataFrame:
    """``trace_id, note`` for traces that were cut."""
    told = lambda df, what, most: df.groupBy("trace_id").count().filter(F.col("count") > most).select(
        "trace_id", F.concat(F.lit(f"Trace {what} truncated: kept {most} of "), F.col("count").cast("string"), F.lit(".")).alias("note")
    )
    return told(nodes, "nodes", max_nodes).unionByName(told(edges, "edges", max_edges))


def source_windows(places: DataFrame, budget: int = MAX_SOURCE_CHARS) -> DataFrame:
    """``trace_id, ord, repo, file, start_line, text``: source of a trace's files while a budget of characters lasts; the last is cut.

    ``places``: trace_id, ord, repo, file, start_line, text; of one file the first place counts.
    """
    once = first_per_key(places.filter("text IS NOT NULL AND text <> ''"), ["trace_id", "repo", "file"], F.col("ord"))
    granted = running_budget(once, ["trace_id"], ["ord"], F.length("text"), budget)
    return granted.select("trace_id", "ord", "repo", "file", "start_line", F.expr("substring(text, 1, granted)").alias("text"))


def matrix_summary(tests: DataFrame, limit: int = MAX_SCENARIOS) -> DataFrame:
    """``trace_id, groups, scenarios, first``: counts of a matrix and its first scenarios. ``tests``: trace_id, group_ord, ord, group_category, name, category, priority, status, contract_refs."""
    order = Window.partitionBy("trace_id").orderBy("group_ord", "ord")
    shown = F.struct(F.col("_n").alias("n"), "name", F.coalesce("category", "group_category").alias("category"), "priority", "status", "contract_refs")
    ranked = tests.withColumn("_n", F.row_number().over(order))
    return ranked.groupBy("trace_id").agg(
        F.countDistinct("group_ord").alias("groups"), F.count(F.lit(1)).alias("scenarios"), F.array_sort(F.collect_list(F.when(F.col("_n") <= limit, shown))).alias("first")
    )


def packets(targets: DataFrame, nodes: DataFrame, edges: DataFrame, sinks: DataFrame, places: DataFrame, tests: DataFrame) -> DataFrame:
    """One row per trace of ``targets`` (trace_id, method, path, repo, handler, file): its packet. Every list has a bound of its own, so a packet is small."""
    listed = lambda df, order, *cols: df.groupBy("trace_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(order, F.struct(*cols).alias("x")))), lambda r: r["x"]).alias("x"))
    few_sinks = top_k(packet_sinks(sinks, nodes), ["trace_id"], [F.col("ord")], MAX_NODES)
    parts = {
        "trace_nodes": listed(packet_nodes(nodes), "rank", "node_id", "type", "name", "kind", "file", "symbol", "snippet"), "trace_edges": listed(packet_edges(edges), "rank", "source", "target", "type", "snippet"),
        "sinks": listed(few_sinks, "rank", "name", "kind", "file", "snippet"), "source_windows": listed(source_windows(places), "ord", "file", "start_line", "text"),
    }
    out = targets
    for name, df in parts.items():
        out = out.join(df.withColumnRenamed("x", name), "trace_id", "left")
    notes = packet_notes(nodes, edges).groupBy("trace_id").agg(F.array_sort(F.collect_list("note")).alias("notes"))
    summary = matrix_summary(tests).select("trace_id", F.struct("groups", "scenarios", "first").alias("tests"))
    return out.join(notes, "trace_id", "left").join(summary, "trace_id", "left")
