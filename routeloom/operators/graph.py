"""Mounts, chains and nearest neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from routeloom.functions import routes
from routeloom.session import cut


def mount_prefixes(mounts: DataFrame) -> DataFrame:
    """``container, prefix, chain`` for every way from a root down to a container.

    ``mounts``: mount_id, parent, child, prefix; mounts without a child lead nowhere. A root is a parent that is mounted nowhere.
    Ways are simple: none passes a container twice. Containers that only a cycle leads to are not reached, and
    count as unmounted in :func:`compose_routes`. One join per level of depth, all roots at once.
    """
    edges = mounts.filter("child IS NOT NULL").select("mount_id", "parent", "child", F.col("prefix").alias("_leg"))
    children = edges.select(F.col("child").alias("parent")).distinct()
    reached = edges.select("parent").distinct().join(children, "parent", "left_anti").select(
        F.col("parent").alias("container"), F.lit("").alias("prefix"), F.array().cast("array<bigint>").alias("chain"), F.array("parent").alias("seen")
    )
    out = reached
    while True:  # ends by itself, for ways are simple
        step = reached.join(edges, F.col("container") == F.col("parent")).filter(~F.array_contains("seen", F.col("child")))
        reached = cut(step.select(
            F.col("child").alias("container"), routes.join_paths(F.col("prefix"), F.col("_leg")).alias("prefix"),
            F.concat("chain", F.array(F.col("mount_id").cast("bigint"))).alias("chain"), F.concat("seen", F.array("child")).alias("seen"),
        ))
        if reached.isEmpty():
            break
        out = out.unionByName(reached)
    return out.select("container", "prefix", "chain").distinct()


def compose_routes(declarations: DataFrame, mounts: DataFrame) -> DataFrame:
    """Full paths of ``declarations`` (decl_id, container, method, path): a row for each way to the container; its own path alone if there is none."""
    ways = mount_prefixes(mounts)
    return declarations.join(ways, "container", "left").select(
        "decl_id", "container", F.upper("method").alias("method"),
        routes.join_paths(F.coalesce("prefix", F.lit("/")), routes.colon_params(F.col("path"))).alias("full_path"),
        F.coalesce("chain", F.array().cast("array<bigint>")).alias("chain"),
    )


def unresolved_mounts(mounts: DataFrame) -> DataFrame:
    return mounts.filter("child IS NULL").select("mount_id", "parent", routes.collapsed_path(F.col("prefix")).alias("prefix"))


def chain_edges(steps: DataFrame, flow: str, order: list, node: Column, entry: Column) -> DataFrame:
    """``flow, position, source, target``: each flow's entry leads to its first step, and each step to the next."""
    w = Window.partitionBy(flow).orderBy(*order)
    return steps.select(
        flow, F.row_number().over(w).alias("position"), F.coalesce(F.lag(node).over(w), entry).alias("source"), node.alias("target")
    )


def last_of_flow(steps: DataFrame, flow: str, order: Column, node: Column) -> DataFrame:
    """``flow, last``: the step that a flow's sinks hang off."""
    return steps.groupBy(flow).agg(F.max_by(node, order).alias("last"))


def nearest_before(lines: DataFrame, by: list, order: list, value: Column) -> Column:
    """The last non-null ``value`` in a row or before it."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return F.last(value, ignorenulls=True).over(w)


def running_budget(rows: DataFrame, by: list, order: list, size: Column, budget: int) -> DataFrame:
    """Rows while a budget lasts, with ``granted``: the size each gets; the last one may get less than it wants."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.sum(size).over(w), F.lit(0))
    return rows.withColumn("_left", F.lit(budget) - spent).withColumn("granted", F.least(size, F.col("_left"))).filter("_left > 0").drop("_left")
