"""Mixing sources to target weights by hash-threshold histograms.

Sizes are summed by source and hash bucket. A source's budget is met by all rows whose
hash is under its threshold; thresholds of larger budgets include those of smaller ones. Only
the bucket that a threshold falls in is refined, by the next bits of the hash. Nothing is sorted
but each source's few thousand buckets.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from routeloom.llm.common import doc_key, documents, materialise, words_of

HASH_BITS, LEVEL_BITS = 60, 12
#: Up to so many sources, what is known of each is broadcast; beyond, it is joined by shuffle.
BROADCAST_SOURCES = 50_000
#: Sources in one partition while they are ranked.
RANKED_AT_ONCE = 100_000

_OUT = ("size", "source_size", "target", "taken", "copies")


def source_targets(sizes: DataFrame, weights: Sequence[int] | Mapping, max_repeat: int = 3) -> DataFrame:
    """``_rl_source, source_size, weight, target`` for ``sizes`` (``_rl_source``, ``size``).

    ``weights``: by rank of the source's name in code point order, null last, repeating; or by
    name, others 0. All weights share 100 % of the sizes; a target stops at ``max_repeat`` times
    its source's size and the excess is shared again by weight until none is above. What cannot
    be placed, as other weights are 0, is not taken.
    """
    totals = sizes.groupBy("_rl_source").agg(F.sum("size").alias("source_size"))
    totals = materialise(totals, "mix-sources")
    if isinstance(weights, Mapping):
        weight = F.lit(0)
        for name, w in weights.items():
            weight = F.when(F.col("_rl_source").eqNullSafe(F.lit(name)), F.lit(w)).otherwise(weight)
        ranked = totals.withColumn("weight", weight)
    else:
        parts = totals.count() // RANKED_AT_ONCE + 1
        dealt = materialise(
            totals.repartitionByRange(parts, F.asc_nulls_last("_rl_source")).withColumn("_rl_part", F.spark_partition_id()),
            "mix-ranks",
        )
        before, starts = 0, F.lit(0)
        for part, n in sorted(dealt.groupBy("_rl_part").count().collect()):  # a row for each RANKED_AT_ONCE sources
            starts = F.when(F.col("_rl_part") == part, F.lit(before)).otherwise(starts)
            before += n
        order = Window.partitionBy("_rl_part").orderBy(F.asc_nulls_last("_rl_source"))
        cycle = F.array(*[F.lit(int(w)) for w in weights])
        rank = (F.row_number().over(order) - 1 + starts) % F.lit(len(weights))
        ranked = dealt.withColumn("weight", F.element_at(cycle, (rank + 1).cast("int")))
    ranked = materialise(ranked.select("_rl_source", "source_size", "weight"), "mix-weights")

    share, capped = F.lit(0.0), F.lit(False)
    total = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    known = None
    while True:
        free = ~capped
        held, w, n = ranked.agg(
            F.coalesce(F.sum(F.when(capped, F.col("source_size") * max_repeat)), F.lit(0)),
            F.coalesce(F.sum(F.when(free, F.col("weight"))), F.lit(0)),
            F.count(F.when(capped, 1)),
        ).first()
        if n == known:
            break
        known = n
        share = F.col("weight") * (F.lit(int(total - held)).cast("double") / F.lit(int(w)).cast("double")) if w else F.lit(0.0)
        capped = share > F.col("source_size") * max_repeat if w else F.lit(True)
    limit = (F.col("source_size") * max_repeat).cast("double")
    return ranked.withColumn("target", F.when(share > limit, limit).otherwise(share))


def thresholds(rows: DataFrame, targets: DataFrame, max_repeat: int = 3) -> DataFrame:
    """For each source: ``_rl_whole`` times all rows are taken, and once more those with hash under ``_rl_end``.
    ``rows``: ``_rl_source, size, _rl_h``.

    Of the two thresholds around the budget the nearer one holds, so a source's sum is off by half of one
    row's size at most (of one group of repeated rows, as they share a hash).
    """
    n = F.when(F.col("source_size") > 0, F.least(F.lit(max_repeat), F.floor(F.col("target") / F.col("source_size")))).otherwise(0)
    state = targets.withColumn("_rl_whole", n.cast("int")).withColumn(
        "_rl_rest", F.col("target") - F.col("_rl_whole") * F.col("source_size")
    )
    state = materialise(
        state.withColumns({"_rl_prefix": F.lit(0).cast("long"), "_rl_before": F.lit(0).cast("long"), "_rl_in": F.lit(None).cast("long")}),
        "mix-state",
    )
    small = state.count() <= BROADCAST_SOURCES
    for level in range(1, HASH_BITS // LEVEL_BITS + 1):
        shift = HASH_BITS - LEVEL_BITS * level
        open_ = state.filter("_rl_rest > 0").select(F.col("_rl_source").alias("_rl_s"), F.col("_rl_prefix").alias("_rl_p"), "_rl_rest", "_rl_before")
        open_ = F.broadcast(open_) if small else open_
        inside = rows.join(
            open_, F.col("_rl_source").eqNullSafe(F.col("_rl_s")) & (F.shiftright("_rl_h", shift + LEVEL_BITS) == F.col("_rl_p"))
        )
        hist = inside.groupBy("_rl_source", F.shiftright("_rl_h", shift).alias("_rl_bucket")).agg(
            F.sum("size").alias("_rl_sum"), F.first("_rl_rest").alias("_rl_rest"), F.first("_rl_before").alias("_rl_before"),
            (F.min("_rl_h") != F.max("_rl_h")).alias("_rl_many"),
        )
        upto = F.sum("_rl_sum").over(Window.partitionBy("_rl_source").orderBy("_rl_bucket"))
        edge = (
            hist.withColumn("_rl_upto", F.col("_rl_before") + upto)
            .filter("_rl_upto > _rl_rest AND _rl_upto - _rl_sum <= _rl_rest AND _rl_sum > 0")
            .select(
                F.col("_rl_source").alias("_rl_s"), F.col("_rl_bucket").alias("_rl_b"),
                (F.col("_rl_upto") - F.col("_rl_sum")).alias("_rl_lo"), F.col("_rl_upto").alias("_rl_hi"), "_rl_many",
            )
        )
        edge = materialise(edge, "mix-edge")
        state = materialise(
            state.join(F.broadcast(edge) if small else edge, F.col("_rl_source").eqNullSafe(F.col("_rl_s")), "left").select(
                "_rl_source", "source_size", "weight", "target", "_rl_whole", "_rl_rest",
                F.coalesce("_rl_b", "_rl_prefix").alias("_rl_prefix"),
                F.coalesce("_rl_lo", "_rl_before").alias("_rl_before"),
                F.coalesce("_rl_hi", "_rl_in").alias("_rl_in"),
            ),
            "mix-state",
        )
        if shift == 0 or edge.filter("_rl_many").isEmpty():
            break
    also = (F.col("_rl_rest") - F.col("_rl_before")) > (F.col("_rl_in") - F.col("_rl_rest"))
    some = F.col("_rl_rest") > 0
    return state.select(
        "_rl_source", "source_size", "weight", "target", "_rl_whole",
        # a bucket with one hash left is taken whole or not at all
        F.when(some & also, F.shiftleft(F.col("_rl_prefix") + 1, shift)).otherwise(
            F.when(some, F.shiftleft(F.col("_rl_prefix"), shift)).otherwise(0)
        ).cast("long").alias("_rl_end"),
    )


def mix(docs: DataFrame, weights: Sequence[int] | Mapping = (1, 2, 3), max_repeat: int = 3, *, size=None) -> DataFrame:
    """``docs`` with ``size, source_size, target, taken, copies``: each row once, taken ``copies`` times.

    ``size``: words of the text unless a column is given. Reruns agree: the hash is md5 of id and text.

    * Null text: size 0. Null source: a source of its own, the last. Null ids count as empty.
    * Repeated rows share a hash, and are taken alike.
    * No rows give no rows. Input columns with the name of an output column are replaced.
    """
    size = words_of(F.col("text")) if size is None else size
    h = F.conv(F.substring(doc_key(F.col("doc_id"), F.col("text")), 1, HASH_BITS // 4), 16, 10).cast("long")
    full = docs.select(
        *[F.col(f"`{c}`") for c in docs.columns if c not in _OUT], size.alias("size"), h.alias("_rl_h"), F.col("source").alias("_rl_source")
    )
    narrow = materialise(full.select("_rl_source", "size", "_rl_h", "doc_id"), "mix-sizes")
    return _apply(full, narrow, docs.columns, weights, max_repeat)


def mix_sizes(docs: DataFrame, weights: Sequence[int] | Mapping = (1, 2, 3), max_repeat: int = 3) -> DataFrame:
    """As :func:`mix`, for ``doc_id`` alone: the texts are read once."""
    h = F.conv(F.substring(doc_key(F.col("doc_id"), F.col("text")), 1, HASH_BITS // 4), 16, 10).cast("long")
    narrow = materialise(
        docs.select(F.col("source").alias("_rl_source"), words_of(F.col("text")).alias("size"), h.alias("_rl_h"), "doc_id"), "mix-sizes"
    )
    return _apply(narrow, narrow, ["doc_id"], weights, max_repeat)


def _apply(rows: DataFrame, narrow: DataFrame, columns, weights, max_repeat) -> DataFrame:
    known = thresholds(narrow, source_targets(narrow, weights, max_repeat), max_repeat)
    small = known.count() <= BROADCAST_SOURCES
    known = known.withColumnRenamed("_rl_source", "_rl_s")
    copies = (F.col("_rl_whole") + F.when(F.col("_rl_h") < F.col("_rl_end"), 1).otherwise(0)).cast("int")
    return rows.join(F.broadcast(known) if small else known, F.col("_rl_source").eqNullSafe(F.col("_rl_s"))).select(
        *[F.col(f"`{c}`") for c in columns if c not in _OUT],
        "size", F.col("source_size").cast("long").alias("source_size"), "target",
        (F.col("size") * copies).cast("long").alias("taken"), copies.alias("copies"),
    )


def query(spark, sf_dir):
    """Mix of all documents; sources weigh 1, 2, 3, repeating, by name."""
    return mix_sizes(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def stage(spark, docs, sf_dir):
    """The mixture: each document as often as the mix takes it."""
    mixed = mix(docs)
    return mixed.filter("copies > 0").withColumn("_rl_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(
        *[F.col(f"`{c}`") for c in docs.columns]
    )


SQL = """
WITH RECURSIVE h AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS k
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w
  FROM h GROUP BY source),
fill AS (
  SELECT 0 AS step, (SELECT sum(source_size) FROM s)::DOUBLE / (SELECT sum(w) FROM s)::DOUBLE AS unit
  UNION ALL
  SELECT step + 1, (SELECT ((SELECT sum(source_size) FROM s) - coalesce(sum(3 * source_size) FILTER (w * unit > 3 * source_size), 0))::DOUBLE
                    / (sum(w) FILTER (NOT (w * unit > 3 * source_size)))::DOUBLE FROM s)
  FROM fill WHERE step < 60),
t AS (
  SELECT source, source_size, CASE WHEN w * unit > 3 * source_size THEN (3 * source_size)::DOUBLE ELSE w * unit END AS target
  FROM s, (SELECT unit FROM fill ORDER BY step DESC LIMIT 1)),
r AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(3, floor(target / source_size)) ELSE 0 END AS whole FROM t),
c AS (
  SELECT h.doc_id, h.source, h.size, h.k, r.source_size, r.target, r.whole, r.target - r.whole * r.source_size AS rest,
         sum(h.size) OVER (PARTITION BY h.source ORDER BY h.k) AS upto, sum(h.size) OVER (PARTITION BY h.source, h.k) AS own
  FROM h JOIN r ON h.source IS NOT DISTINCT FROM r.source),
e AS (
  SELECT source, min(k) AS k, any_value(upto) AS hi, any_value(upto - own) AS lo, any_value(rest) AS rest
  FROM c WHERE rest > 0 AND upto > rest AND upto - own <= rest AND own > 0 GROUP BY source)
SELECT c.doc_id, c.size, c.source_size, c.target,
       (c.size * (c.whole + CASE WHEN c.k < e.k OR (c.k = e.k AND e.rest - e.lo > e.hi - e.rest) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c LEFT JOIN e ON c.source IS NOT DISTINCT FROM e.source
"""
