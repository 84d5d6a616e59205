"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are partitioned by their number of shingles. An item's sketch is its bottom-k MinHash, the k
shingles of lowest hash; k is set by its partition so that a text which contains the threshold's share of the item's
shingles cannot lack all of them. So any text that shares a sketch value is a candidate, none is missed, and each
candidate is verified by exact shingle containment. The partition decides nothing but k: the sketches of all partitions are one
sorted table of values, so a text's shingles are looked up once. A long text is never compared as a whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routeloom.llm.common import documents, small_arrow_batches
from routeloom.llm.shingles import ALNUM_WORD, NOT_ALNUM, shingles_of

WORDS, THRESHOLD = 5, 0.8
#: Characters of test items that are searched at once; more items are searched in blocks, each over all texts.
BLOCK_CHARS = 16_000_000


def _words(text: str | None) -> list[str]:
    return ALNUM_WORD.findall((text or "").lower())


def _needed(n: int, threshold: float) -> int:
    """The fewest of ``n`` shingles that reach the threshold."""
    return max(1, math.ceil(threshold * n - 1e-9))


class ItemIndex:
    """Sketches of test items whose shingles have ``k`` words."""

    def __init__(self, items: list[tuple[object, str]], k: int, threshold: float) -> None:
        self.k, self.threshold, self.ids, self.sets = k, threshold, [], []
        column = pa.array([t for _, t in items], pa.string())
        self.texts = [t for _, t in items]
        self.ids = [i for i, _ in items]
        for _, _, hashes, bounds in shingles_of(column, k, NOT_ALNUM, short=False):
            self.sets += [np.unique(hashes[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        values, owners = [], []
        for i, s in enumerate(self.sets):
            largest = 2 ** (int(math.log2(len(s))) + 1) - 1  # of the item's size partition
            size = largest - _needed(largest, threshold) + 1
            values.append(s[:size])
            owners.append(np.full(len(values[-1]), i))
        values, owners = np.concatenate(values), np.concatenate(owners)
        order = np.argsort(values, kind="stable")
        values, self.owners = values[order], owners[order]
        self.values, self.starts = np.unique(values, return_index=True)
        self.starts = np.append(self.starts, len(values))

    def search(self, column: pa.Array) -> Iterator[tuple[int, int, int]]:
        """``(row, item, shared shingles)`` of all items that a row of texts contains."""
        for at, _, hashes, bounds in shingles_of(column, self.k, NOT_ALNUM, short=False):
            spot = np.searchsorted(self.values, hashes)
            spot[spot == len(self.values)] = 0
            hits = np.flatnonzero(self.values[spot] == hashes)
            rows = np.searchsorted(bounds, hits, side="right") - 1
            for row in np.unique(rows):
                found = np.unique(spot[hits[rows == row]])
                own = np.unique(hashes[bounds[row] : bounds[row + 1]])
                exact = None
                for item in np.unique(np.concatenate([self.owners[self.starts[v] : self.starts[v + 1]] for v in found])):
                    s = self.sets[item]
                    need = _needed(len(s), self.threshold)
                    if len(own) < need or np.isin(s, own, assume_unique=True).sum() < need:
                        continue
                    exact = exact or self._shingles(column[int(at + row)].as_py())
                    wanted = self._shingles(self.texts[item])
                    shared = len(wanted & exact)
                    if shared >= _needed(len(wanted), self.threshold):
                        yield int(at + row), int(item), shared

    def _shingles(self, text: str) -> set:
        words = _words(text)
        return set(zip(*[words[j:] for j in range(self.k)], strict=False))


def _indexes(texts: DataFrame, threshold: float, k: int, block_chars: int) -> Iterator:
    """Broadcast indexes of distinct item texts (key, text), block by block. The key decides the block, so each has its share of the characters."""
    chars = texts.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = int(chars // block_chars) + 1
    for block in range(blocks):
        by_k: dict[int, list] = {}
        for r in texts.filter(F.pmod(F.xxhash64("key"), F.lit(blocks)) == block).collect():  # block_chars or so
            if words := _words(r["text"]):
                by_k.setdefault(min(k, len(words)), []).append((r["key"], r["text"]))
        yield texts.sparkSession.sparkContext.broadcast([ItemIndex(v, n, threshold) for n, v in sorted(by_k.items())])


def _keyed(items: DataFrame) -> DataFrame:
    return items.filter("text IS NOT NULL").withColumn("key", F.md5(F.col("text").cast("binary")))


def _texts(items: DataFrame) -> DataFrame:
    """``key, text`` of the distinct texts of ``items``."""
    return _keyed(items).groupBy("key").agg(F.first("text").alias("text"))


def find_leaks(docs: DataFrame, items: DataFrame, *, threshold: float = THRESHOLD, k: int = WORDS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``doc_id, item_id, shared, item_shingles, containment`` for every document and test item it contains.

    ``docs`` (doc_id, text), ``items`` (item_id, text), ids of any type. Words are runs of letters and digits, in lower case;
    a document contains an item if it has ``threshold`` of the item's ``k``-word shingles. Of an item of fewer words, all of them in a row are
    its one shingle; items without words are contained nowhere.

    Null texts are empty; null ids stay null. A row for each repeated document or item row, though a text is searched once; other columns are ignored.
    """
    small_arrow_batches(docs.sparkSession)
    names = ["doc_id", "key", "shared", "item_shingles", "containment"]
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, key string, shared long, item_shingles long, containment double"
    found = None
    for indexes in _indexes(_texts(items), threshold, k, block_chars):

        def search(batches: Iterator[pa.RecordBatch], indexes=indexes) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows, keys, shared, sizes = [], [], [], []
                for index in indexes.value:
                    for row, item, n in index.search(batch.column(1)):
                        rows.append(row)
                        keys.append(index.ids[item])
                        shared.append(n)
                        sizes.append(len(index.sets[item]))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(rows, pa.int64())),
                        pa.array(keys, pa.string()),
                        pa.array(shared, pa.int64()),
                        pa.array(sizes, pa.int64()),
                        pa.array([n / s for n, s in zip(shared, sizes, strict=True)], pa.float64()),
                    ],
                    names=names,
                )

        part = docs.select("doc_id", "text").mapInArrow(search, schema)
        found = part if found is None else found.unionByName(part)
    return found.join(_keyed(items).select("key", "item_id"), "key").select("doc_id", "item_id", *names[2:])


def drop_leaks(docs: DataFrame, items: DataFrame, *, threshold: float = THRESHOLD, k: int = WORDS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` without the rows that contain a test item; the rest as it was, null texts and repeated rows included."""
    small_arrow_batches(docs.sparkSession)
    at = docs.columns.index("text")
    for indexes in _indexes(_texts(items), threshold, k, block_chars):

        def clean(batches: Iterator[pa.RecordBatch], indexes=indexes) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for index in indexes.value:
                    keep[[row for row, _, _ in index.search(batch.column(at))]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs


def query(spark, sf_dir):
    """All benchmark items in all documents."""
    return find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def stage(spark, docs, sf_dir):
    """The documents that contain no benchmark item."""
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: All shingles of all items in all documents, counted.
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '{ALNUM_WORD.pattern}') AS w FROM documents),
b AS (SELECT row_number() OVER () AS i, item_id, regexp_extract_all(lower(coalesce(text, '')), '{ALNUM_WORD.pattern}') AS w FROM benchmark),
wanted AS (SELECT DISTINCT i, item_id, k, array_to_string(list_slice(w, p, p + k - 1), ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS p FROM (SELECT *, least({WORDS}, len(w)) AS k FROM b WHERE len(w) > 0))),
sizes AS (SELECT i, count(*) AS n FROM wanted GROUP BY i),
ks AS (SELECT DISTINCT k FROM wanted),
own AS (SELECT DISTINCT r, k, array_to_string(list_slice(w, p, p + k - 1), ' ') AS s FROM (SELECT r, k, w, unnest(range(1, len(w) - k + 2)) AS p FROM d, ks WHERE len(w) >= k)),
hit AS (SELECT r, i, item_id, count(*) AS shared FROM own JOIN wanted USING (k, s) GROUP BY ALL)
SELECT doc_id, item_id, shared::BIGINT AS shared, n::BIGINT AS item_shingles, shared / n::DOUBLE AS containment
FROM hit JOIN sizes USING (i) JOIN d USING (r) WHERE shared >= greatest(1, ceil({THRESHOLD} * n - 1e-9))"""
