"""Sharding by extendible hashing.

A directory is indexed by the leading bits of a row's hash. It starts as one bucket;
a bucket over the byte limit splits on the next bit, the others stay, until every
shard fits. Only sums by hash prefix are computed, and further bits are read only for
buckets that are still too large, so no bucket's rows ever meet in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routeloom.llm.common import doc_key, documents, materialise

#: Bits that come from a row's key; as many again come from its place, for rows that are alike.
KEY_BITS = 60
#: The directory's cells are about this many times finer, in bits, than even shards would be.
CELL_BITS = 3
#: Up to so many cells (some 60 bytes each), the directory goes to the rows; beyond, both are shuffled.
BROADCAST_CELLS = 1_000_000
#: Byte limit of a shard in the registered query.
SHARD_BYTES = 1 << 20

_OUT = ("n_bytes", "depth", "shard", "shard_bytes", "oversize")


def _bits(md5: Column) -> Column:
    """The first 60 bits of an md5 string, as 0 and 1."""
    return F.lpad(F.conv(F.substring(md5, 1, KEY_BITS // 4), 16, 2), KEY_BITS, "0")


def assign_shards(rows: DataFrame, key: Column, size: Column, max_bytes: int) -> DataFrame:
    """``rows`` with columns ``n_bytes, depth, shard, shard_bytes, oversize``; every row once.

    * ``shard``: the first ``depth`` bits of the key's hash; empty if one shard holds all.
    * Repeated rows have the same hash. Where they alone are over the limit, further bits come
      from a hash of the row's place in the written input; such rows are alike, so it decides
      nothing that shows.
    * A row that alone is over the limit gets a shard of its own, with ``oversize`` true.
    * Null sizes count as 0, null keys as empty; no rows give no rows. Input columns with the
      name of an output column are replaced.
    """
    own = [F.col(f"`{c}`") for c in rows.columns if c not in _OUT]
    placed = materialise(
        rows.select(
            *own,
            F.coalesce(size, F.lit(0)).cast("long").alias("n_bytes"),
            F.coalesce(key, F.lit("")).alias("_rl_key"),
        ).withColumn("_rl_row", F.monotonically_increasing_id()),
        "shard-rows",
    ).withColumn(
        "_rl_bits", F.concat(_bits(F.col("_rl_key")), _bits(F.md5(F.concat_ws(":", "_rl_key", "_rl_row").cast("binary"))))
    )
    total = placed.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    base, depth = 0, min(2 * KEY_BITS, math.ceil(math.log2(max(1, total / max_bytes))) + CELL_BITS)
    left, done = placed, None
    while True:
        cells = _directory(left, base, depth, max_bytes)
        known = F.broadcast(cells) if cells.count() <= BROADCAST_CELLS else cells
        part = left.withColumn("_rl_cell", F.substring("_rl_bits", 1, depth)).join(known, "_rl_cell")
        last = depth >= 2 * KEY_BITS
        fits = part if last else part.filter("shard IS NOT NULL")
        fits = fits.select(
            *[F.col(f"`{c}`") for c in rows.columns if c not in _OUT],
            "n_bytes",
            F.length(F.coalesce("shard", "_rl_cell")).cast("int").alias("depth"),
            F.coalesce("shard", "_rl_cell").alias("shard"),
            F.coalesce("shard_bytes", "_rl_bytes").alias("shard_bytes"),
        )
        done = fits if done is None else done.unionByName(fits)
        if last or cells.filter("shard IS NULL").isEmpty():
            return done.withColumn("oversize", F.col("shard_bytes") > max_bytes)
        left = materialise(part.filter("shard IS NULL").select(*left.columns), "shard-left")
        base, depth = depth, min(2 * KEY_BITS, depth + CELL_BITS)


def _directory(rows: DataFrame, base: int, depth: int, max_bytes: int) -> DataFrame:
    """For each hash prefix of ``depth`` bits: the shard that holds it; null where it must split further.

    A prefix's shard is its shortest prefix of at least ``base`` bits whose bucket fits.
    """
    cells = materialise(
        rows.groupBy(F.substring("_rl_bits", 1, depth).alias("_rl_cell")).agg(
            F.sum("n_bytes").alias("_rl_bytes"), F.count(F.lit(1)).alias("_rl_n")
        ),
        "shard-cells",
    )
    levels = cells.select("*", F.explode(F.sequence(F.lit(base), F.lit(depth))).alias("_rl_level")).withColumn(
        "_rl_prefix", F.expr("substring(_rl_cell, 1, _rl_level)")
    )
    fits = (
        levels.groupBy("_rl_prefix")
        .agg(F.sum("_rl_bytes").alias("shard_bytes"), F.sum("_rl_n").alias("_rl_rows"))
        .filter((F.col("shard_bytes") <= max_bytes) | (F.col("_rl_rows") == 1))
        .select("_rl_prefix", "shard_bytes")
    )
    found = (
        levels.join(fits, "_rl_prefix")
        .groupBy("_rl_cell")
        .agg(F.min(F.struct("_rl_level", F.col("_rl_prefix").alias("shard"), "shard_bytes")).alias("_rl_first"))
        .select("_rl_cell", "_rl_first.shard", "_rl_first.shard_bytes")
    )
    return materialise(cells.select("_rl_cell", "_rl_bytes").join(found, "_rl_cell", "left"), "shard-directory")


def query(spark, sf_dir):
    """Shard of every document; shards hold 1 MiB of text at most."""
    docs = documents(spark, sf_dir)
    rows = docs.select("doc_id", doc_key(F.col("doc_id"), F.col("text")).alias("k"), F.octet_length("text").alias("b"))
    return assign_shards(rows, F.col("k"), F.col("b"), SHARD_BYTES).select("doc_id", *_OUT)


def stage(spark, docs, sf_dir):
    """All columns of the documents, and their shard."""
    return assign_shards(docs, doc_key(F.col("doc_id"), F.col("text")), F.octet_length("text"), SHARD_BYTES)


SQL = f"""
WITH h AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS n_bytes,
         lpad(bin(('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15))::BIGINT), 60, '0') AS bits
  FROM documents),
p AS (
  SELECT left(bits, l::INT) AS prefix, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS n
  FROM h, range(0, 41) AS r(l) GROUP BY 1),
f AS (SELECT * FROM p WHERE shard_bytes <= {SHARD_BYTES} OR n = 1),
m AS (SELECT h.bits, min(l) AS depth FROM h, range(0, 41) AS r(l) JOIN f ON f.prefix = left(h.bits, l::INT) GROUP BY 1)
SELECT h.doc_id, h.n_bytes, m.depth::INT AS depth, f.prefix AS shard, f.shard_bytes, f.shard_bytes > {SHARD_BYTES} AS oversize
FROM h JOIN m ON h.bits = m.bits JOIN f ON f.prefix = left(h.bits, m.depth::INT)
"""
