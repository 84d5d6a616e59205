"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def session(df: DataFrame) -> SparkSession:
    return df.sparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that setting is absent and Spark runs on this machine alone (tests, a laptop) a folder of the machine
    is chosen, once for each session; on a cluster its absence is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.conf.get("spark.routeloom.scratch", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="routeloom-")
        spark.conf.set("spark.routeloom.scratch", named)
    return named.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a Parquet table in the shared folder and read it back.

    It cuts the lineage and survives the loss of executors.
    """
    spark = session(df)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made._rl_path = path
    return made


def discard(*tables: DataFrame) -> None:
    """Delete tables that :func:`materialise` wrote, once all that was made of them is written too."""
    for df in tables:
        spark = session(df)
        path = spark._jvm.org.apache.hadoop.fs.Path(df._rl_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def doc_key(doc_id: Column, text: Column) -> Column:
    """md5 of id and text: the same on every run and in other SQL engines. Null id or text: empty."""
    return F.md5(
        F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))).cast("binary")
    )


def words_of(text: Column) -> Column:
    """Number of words (long) of a text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def small_arrow_batches(spark: SparkSession, rows: int = 256, size: int = 8 << 20) -> None:
    """Keep Arrow batches small, in rows and in bytes: documents can be long, and Python workers have little memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Bits of a key bitmap, at most: 16 MB. With more keys it lets more rows through, and loses none.
BITMAP_BITS = 1 << 27


def split_by_keys(rows: DataFrame, key: str, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` that may have a key in ``keys`` (one column), and those that surely have none, without a shuffle.

    A bitmap of the keys' hashes is made by aggregation and broadcast; its size has a fixed bound.
    """
    spark = rows.sparkSession
    bits = min(BITMAP_BITS, 1 << max(10, (16 * keys.count()).bit_length()))
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    at = slot(F.col(keys.columns[0]))
    words = keys.select(at.alias("s")).groupBy(F.shiftright("s", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 AS int))")).alias("b"))
    found = words.toPandas()
    table = np.zeros(bits // 64, np.int64)
    table[found["w"].to_numpy(np.int64)] = found["b"].to_numpy(np.int64)
    shared = spark.sparkContext.broadcast(table)
    schema, columns = rows.schema, rows.columns

    def side(wanted: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                s = batch.column(len(columns)).to_numpy()
                hit = (shared.value[s >> 6] >> (s & 63) & 1).astype(bool)
                yield batch.select(range(len(columns))).filter(pa.array(hit == wanted))

        return rows.withColumn("_rl_slot", slot(F.col(key))).mapInArrow(run, schema)

    return side(True), side(False)


#: Rows of a key from which on it counts as hot, at least, and hot keys, at most.
HOT_ROWS, HOT_KEYS = 256, 2_000


def join_hot(rows: DataFrame, table: DataFrame, key: str, how: str = "inner", *, counts: DataFrame | None = None) -> DataFrame:
    """``rows`` joined with ``table``, which has each ``key`` once, though a key may hold any share of the rows.

    Keys that hold more than their share are few, whatever the size: at most :data:`HOT_KEYS`. Their rows of ``table`` are broadcast, so that
    theirs of ``rows`` stay where they are; the others meet by a shuffle. ``rows`` is read twice: it should be a written table.
    ``counts``: (key, count) of the rows by key, where that is known; it may hold ``table``'s columns too.
    """
    counts = rows.groupBy(key).count() if counts is None else counts
    total, most = counts.agg(F.sum("count"), F.max("count")).first()
    limit = max(HOT_ROWS, (total or 0) // HOT_KEYS)
    hot = [] if (most or 0) <= limit else [r[0] for r in counts.filter(F.col("count") > limit).filter(F.col(key).isNotNull()).select(key).collect()]
    if not hot:
        return rows.join(table, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    return rows.filter(~is_hot).join(table.filter(~is_hot), key, how).unionByName(rows.filter(is_hot).join(F.broadcast(table.filter(is_hot)), key, how))
