"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routeloom.llm.common import discard, join_hot, materialise


def _with_least(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) with ``least``, the least neighbour of a. Neighbours are counted along, for nodes with many of them."""
    least = materialise(edges.groupBy("a").agg(F.min("b").alias("least"), F.count(F.lit(1)).alias("count")), "edges-least")
    joined = join_hot(edges, least.select("a", "least"), "a", counts=least.select("a", "count"))
    joined._rl_path = least._rl_path
    return joined


def _large_star(edges: DataFrame) -> DataFrame:
    both = _with_least(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    star = both.filter("b > a").select(F.col("b").alias("a"), F.least("a", "least").alias("b")).filter("a <> b").distinct()
    return _written(star, both)


def _small_star(edges: DataFrame) -> DataFrame:
    down = _with_least(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    # each lower neighbour goes to the least one, and so does the node itself
    moved = down.select(F.when(F.col("b") == F.col("least"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("least").alias("b"))
    return _written(moved.filter("a <> b").distinct(), down)


def _written(star: DataFrame, source: DataFrame) -> DataFrame:
    made = materialise(star, "edges")
    discard(source)
    return made


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (a, b: long): root is the least node of its component. A written table.

    An edge is a row of its own throughout. The neighbours of a node with many of them stay where they are (:func:`join_hot`),
    and only least neighbours are aggregated. Loops and repeated edges do no harm; no edges give no rows.
    """
    now = materialise(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    mark = None
    while True:
        star = _large_star(now)
        discard(now)
        now = _small_star(star)
        discard(star)
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    leaves = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = leaves.unionByName(leaves.select(F.col("root").alias("node"), "root").distinct())
    out._rl_path = now._rl_path
    return out
