"""N-gram Jaccard join with Bayesian candidate pruning.

1. Exact copies collapse to one text. Every text gets a MinHash signature of its word shingles.
2. Texts that agree on a band of the signature are candidates. A bucket of few texts gives its pairs; their MinHash
   values are compared step by step, and a pair is dropped when the posterior probability that its similarity reaches the threshold
   falls below a tolerance. In a larger bucket each text is compared with the first one in the same way, and what is not similar to it again, so
   no bucket's pairs are ever rows, and texts that only share a passage do not meet.
3. What is left falls into groups. A group's texts are dealt to tiles, and each pair of tiles is a unit of work of bounded
   size: within it all pairs go through the same pruning, and the rest is verified by their exact sets of shingles.
   Units return sums for each text, not pairs.

The links of a text are counted in full, so a group of n texts costs n**2 comparisons of MinHash values,
in n**2 / tile**2 units that run apart; its rows grow with n**2 / tile.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routeloom.llm.common import discard, documents, join_hot, materialise, small_arrow_batches, split_by_keys
from routeloom.llm.components import components
from routeloom.llm.shingles import SPACE, mix, shingles_of

WORDS, THRESHOLD = 5, 0.8
#: A pair of similarity 0.8 shares no band with probability (1 - 0.8**5)**36, under one in a million.
BANDS, ROWS = 36, 5
#: Posterior probability below which a pair is dropped, and MinHash values looked at in a step.
TOLERANCE, STEP = 1e-6, 20
#: Texts of a bucket whose pairs are listed; larger ones give stars.
LISTED = 16
#: Two texts that are similar to one text are as similar as this (Jaccard distance is a metric).
BORDER = 1 - 2 * (1 - THRESHOLD)
#: Texts and shingles of a tile.
TILE_TEXTS, TILE_SHINGLES = 512, 400_000

_SEEDS = np.random.Generator(np.random.PCG64(8)).integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """MinHash values (32 bits) of each run of shingle hashes; of an empty run, zeros."""
    full = np.flatnonzero(np.diff(bounds))
    out = np.zeros((len(bounds) - 1, len(_SEEDS)), np.uint32)
    if len(full):
        starts = bounds[full]
        for i, seed in enumerate(_SEEDS):
            out[full, i] = np.minimum.reduceat(((hashes * seed) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def bands_of(signature: np.ndarray) -> np.ndarray:
    """A hash of each band of each signature."""
    parts = signature.reshape(len(signature), BANDS, ROWS).astype(np.uint64)
    h = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) + np.uint64(1), parts.shape[:2])
    for r in range(ROWS):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r])
    return h.view(np.int64) if h.flags.c_contiguous else np.ascontiguousarray(h).view(np.int64)


@cache
def fewest_matches(n: int, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> int:
    """Of ``n`` MinHash values, the fewest equal ones at which a pair is not dropped.

    With m equal, under a uniform prior, P(similarity >= t) = P(Binomial(n + 1, t) <= m).
    """
    tail = 0.0
    for m in range(n + 1):
        tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if tail >= tolerance:
            return m
    return n


def plausible(left: np.ndarray, right: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """Which pairs of rows of two signature tables are left after the last step."""
    alive, matches = np.arange(len(left)), np.zeros(len(left), np.int64)
    for at in range(0, left.shape[1], STEP):
        matches[alive] += (left[alive, at : at + STEP] == right[alive, at : at + STEP]).sum(1)
        alive = alive[matches[alive] >= fewest_matches(min(at + STEP, left.shape[1]), threshold)]
    return alive


def _sign(texts: DataFrame) -> DataFrame:
    """``_rl_key, doc_id, n, sig, bands`` of each row of ``texts`` (_rl_key, doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, hashes, bounds in shingles_of(batch.column(2), WORDS, SPACE, short=True):
                sig = signatures(hashes, bounds)
                n = np.diff(bounds)
                bands = pa.FixedSizeListArray.from_arrays(pa.array(bands_of(sig).ravel()), BANDS).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, to - at), batch.column(1).slice(at, to - at), pa.array(n), pa.array([s.tobytes() for s in sig.astype("<u2")], pa.binary()), bands],
                    names=["_rl_key", "doc_id", "n", "sig", "bands"],
                )

    return texts.mapInArrow(run, f"_rl_key binary, doc_id {dict(texts.dtypes)['doc_id']}, n long, sig binary, bands array<long>")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, len(_SEEDS))


def _compare(pairs: DataFrame, sig: DataFrame, *, hot: bool) -> DataFrame:
    """``a, b, near`` of the pairs (a, b) that may reach :data:`BORDER`; ``near``: they may reach the threshold as well.
    ``hot``: a text may be ``a`` of any number of pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = _matrix(batch.column(2)), _matrix(batch.column(3))
            close = plausible(left, right, BORDER)
            near = np.isin(close, plausible(left, right))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(close)), batch.column(1).take(pa.array(close)), pa.array(near)], names=["a", "b", "near"])

    sig_a = sig.toDF("a", "sig_a")
    signed = (join_hot(pairs, sig_a, "a") if hot else pairs.join(sig_a, "a")).join(sig.toDF("b", "sig_b"), "b")
    return signed.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long, near boolean")


def _listed(posted: DataFrame) -> DataFrame:
    """``a, b``: all pairs of the buckets in ``posted`` (band, rid), which are small."""
    lists = posted.groupBy("band").agg(F.array_sort(F.collect_list("rid")).alias("r")).select("r").distinct()
    return lists.select(
        F.explode(F.expr("flatten(transform(sequence(1, size(r) - 1), i -> transform(slice(r, i + 1, size(r)), x -> struct(r[i - 1] AS a, x AS b))))")).alias("p")
    ).select("p.a", "p.b").distinct()


def _within(posted: DataFrame, sig: DataFrame) -> DataFrame:
    """``a, b``: links that hold together the texts of a bucket in ``posted`` (band, rid, size) that may be similar.

    A bucket's texts are dealt to tiles; every pair of tiles is a unit of work, in which all pairs are compared step by step. A unit gives
    no more links than it has texts.
    """
    tiles = F.ceil(F.col("size") / F.lit(TILE_TEXTS))
    rows = posted.join(sig, "rid").withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64("rid"), F.col("tiles")))
    units = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))).select(
        "band", F.least("tile", "other").alias("one"), F.greatest("tile", "other").alias("two"), "tile", "rid", "sig"
    )

    def links(key, rows) -> list[tuple[int, int]]:
        _, one, two = key
        tile, rid = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
        table, root, out = np.frombuffer(b"".join(r[2] for r in rows), "<u2").reshape(-1, len(_SEEDS)), list(range(len(rows))), []

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        others = np.flatnonzero(tile == two)
        for i in np.flatnonzero(tile == one):
            near = others[others > i] if one == two else others
            for j in near[plausible(np.broadcast_to(table[i], (len(near), table.shape[1])), table[near])]:
                if find(i) != find(j):
                    root[find(j)] = find(i)
                    out.append((int(rid[i]), int(rid[j])))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            found = []
            for *key, tile, rid, signature in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != now:
                    found += links(now, held) if held else []
                    now, held = key, []
                held.append((tile, rid, signature))
            yield table(found)
        yield table(links(now, held) if held else [])

    def table(found) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return units.repartition("band", "one", "two").sortWithinPartitions("band", "one", "two", "rid").mapInArrow(run, "a long, b long")


def _candidates(posted: DataFrame, sig: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """``a, b``: links by which all texts that may be similar fall into one group, and the tables they are read from.

    ``posted`` (band, rid): the buckets. A small one gives its pairs. In a large one every text is compared with the first. Those that may
    reach the threshold are done: whoever is similar to them is close to the first too, 1 - 2 * (1 - threshold) at least, and linked to it.
    The others are a bucket again; one that fits in a tile is compared at once, larger ones as before, as long as that makes them much smaller.
    """
    out, tables, before = None, [posted], None
    while True:
        buckets = materialise(posted.groupBy("band").agg(F.count(F.lit(1)).alias("size"), F.min("rid").alias("hub")).filter("size > 1"), "join-hubs")
        sized = materialise(join_hot(posted, buckets, "band", counts=buckets.select("band", F.col("size").alias("count"))), "join-buckets")
        tables += [buckets, sized]
        if out is None:
            most, out = LISTED, _compare(_listed(sized.filter(F.col("size") <= LISTED)), sig, hot=False).filter("near").select("a", "b")
        else:
            most = TILE_TEXTS
        n = buckets.filter(F.col("size") > most).agg(F.sum("size")).first()[0] or 0
        if before is not None:  # what is left after the first round
            done = not n or n > 0.7 * before
            out = out.unionByName(_within((sized if done else sized.filter(F.col("size") <= most)).select("band", "rid", "size"), sig))
            if done:
                return out, tables
        elif not n:
            return out, tables
        before = n
        spokes = sized.filter((F.col("size") > most) & (F.col("rid") != F.col("hub")))
        stars = materialise(_compare(spokes.select(F.col("hub").alias("a"), F.col("rid").alias("b")).distinct(), sig, hot=True), "join-stars")
        out = out.unionByName(stars.select("a", "b"))
        near = stars.filter("near").select(F.col("a").alias("hub"), F.col("b").alias("rid"))
        posted = materialise(spokes.join(near, ["rid", "hub"], "left_anti").select("band", "rid"), "join-rest")
        tables += [stars, posted]


class _Unit:
    """The texts of one or two tiles of a group."""

    def __init__(self, key) -> None:
        self.key, self.rows, self.seen = key, [], set()

    def add(self, tile: int, rid: int, copies: int, shingles: bytes) -> None:
        if rid not in self.seen:  # repeated rows of one document
            self.seen.add(rid)
            self.rows.append((tile, rid, copies, np.frombuffer(shingles, np.uint64)))

    def links(self) -> list[tuple[int, int, int]]:
        """``(text, linked documents, a text of its class)`` for the texts that have links."""
        _, one, two = self.key
        rows = sorted(self.rows, key=lambda r: r[:2])
        sets = [r[3] for r in rows]
        sig = signatures(np.concatenate(sets), np.cumsum([0, *map(len, sets)])).astype(np.uint16)
        tile, size = np.array([r[0] for r in rows]), np.array([len(s) for s in sets])
        copies, linked, root = np.array([r[2] for r in rows]), np.zeros(len(rows), np.int64), list(range(len(rows)))
        others = np.arange(len(rows)) if one == two else np.flatnonzero(tile == two)

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for i in range(len(rows)) if one == two else np.flatnonzero(tile == one):
            near = others[others > i] if one == two else others
            ratio = size[near] / size[i]
            near = near[(ratio >= THRESHOLD) & (ratio * THRESHOLD <= 1)]  # else their sizes alone rule it out
            near = near[plausible(np.broadcast_to(sig[i], (len(near), sig.shape[1])), sig[near])]
            if not len(near):
                continue
            pool = np.concatenate([sets[j] for j in near])
            spot = np.searchsorted(sets[i], pool)
            spot[spot == size[i]] = 0
            shared = np.add.reduceat((sets[i][spot] == pool).astype(np.int64), np.cumsum([0, *size[near[:-1]]]))
            for j in near[shared >= THRESHOLD * (size[i] + size[near] - shared) - 1e-9]:
                linked[i] += copies[j]
                linked[j] += copies[i]
                root[find(max(i, j))] = find(min(i, j))
        return [(rows[i][1], int(linked[i]), rows[find(i)][1]) for i in np.flatnonzero(linked)]


def _verify(rows: DataFrame) -> DataFrame:
    """``rid, linked, mate`` for the texts in ``rows`` (group, one, two, tile, rid, copies, shingles), dealt and sorted by unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = None
        for batch in batches:
            found = []
            for *key, tile, rid, copies, shingles in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if unit is None or unit.key != key:
                    found += unit.links() if unit else []
                    unit = _Unit(key)
                unit.add(tile, rid, copies, shingles)
            yield table(found)
        yield table(unit.links() if unit else [])

    def table(found) -> pa.RecordBatch:
        cols = list(zip(*found, strict=True)) or [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["rid", "linked", "mate"])

    dealt = rows.repartition("group", "one", "two").sortWithinPartitions("group", "one", "two", "rid")
    return dealt.mapInArrow(run, "rid long, linked long, mate long")


def _shingle_sets(texts: DataFrame) -> DataFrame:
    """Adds ``shingles`` (sorted distinct hashes) in place of ``text``, the last column."""
    names = [*texts.columns[:-1], "shingles"]
    schema = ", ".join(f"{n} {k}" for n, k in texts.dtypes[:-1]) + ", shingles binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, hashes, bounds in shingles_of(batch.column(batch.num_columns - 1), WORDS, SPACE, short=True):
                sets = [np.unique(hashes[a:b]).tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*(c.slice(at, to - at) for c in batch.columns[:-1]), pa.array(sets, pa.binary())], names=names)

    return texts.mapInArrow(run, schema)


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of ``docs`` (doc_id, text): each row's ``doc_id, _rl_key, n``; and for each text with words
    ``_rl_key, least_id, copies, linked, root`` (root: the least text of its class)."""
    spark = docs.sparkSession
    small_arrow_batches(spark)
    texts = docs.select(F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("_rl_key"), "doc_id", "text")
    signed = materialise(_sign(texts), "join-signed")
    reps = (
        signed.filter("n > 0").groupBy("_rl_key")
        .agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
        .withColumn("rid", F.monotonically_increasing_id())
    )
    reps = materialise(reps, "join-texts")

    links, tables = _candidates(materialise(reps.select(F.explode("bands").alias("band"), "rid"), "join-bands"), reps.select("rid", "sig"))
    groups = components(links)
    discard(*tables)

    placed = materialise(
        groups.select(F.col("node").alias("rid"), F.col("root").alias("group")).join(reps.select("rid", "_rl_key", "least_id", "copies", "n"), "rid"), "join-groups"
    )
    tiles = materialise(placed.groupBy("group").agg(
        F.ceil(F.greatest(F.count(F.lit(1)) / F.lit(TILE_TEXTS), F.sum("n") / F.lit(TILE_SHINGLES))).alias("tiles"), F.count(F.lit(1)).alias("count")
    ), "join-tiles")
    needed = join_hot(placed, tiles.select("group", "tiles"), "group", counts=tiles.select("group", "count")).withColumn("tile", F.pmod(F.xxhash64("rid"), F.col("tiles")))
    grouped, _ = split_by_keys(texts, "_rl_key", placed.select("_rl_key"))  # few texts are in groups; only they move
    sets = _shingle_sets(
        grouped.withColumnRenamed("doc_id", "least_id")
        .join(
            needed.select(F.col("_rl_key").alias("_rl_k"), F.col("least_id").alias("_rl_id"), "group", "tile", "tiles", "rid", "copies"),
            (F.col("_rl_key") == F.col("_rl_k")) & F.col("least_id").eqNullSafe(F.col("_rl_id")),
        )
        .select("group", "tile", "tiles", "rid", "copies", "text")
    )
    sets = materialise(sets, "join-sets")
    units = sets.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))).select(
        "group", F.least("tile", "other").alias("one"), F.greatest("tile", "other").alias("two"), "tile", "rid", "copies", "shingles"
    )
    links = materialise(_verify(units), "join-links")
    discard(sets, placed, tiles, groups)
    roots = components(links.select(F.col("mate").alias("a"), F.col("rid").alias("b")))
    counted = links.groupBy("rid").agg(F.sum("linked").alias("linked")).join(roots.withColumnRenamed("node", "rid"), "rid", "left")
    classes = materialise(reps.select("rid", "_rl_key", "least_id", "copies").join(counted, "rid", "left").select(
        "_rl_key", "least_id", "copies", F.coalesce("linked", F.lit(0)).alias("linked"), F.coalesce("root", "rid").alias("root")
    ), "join-rooted")
    discard(links, roots, reps)
    one = F.struct(F.col("least_id").isNull().alias("none"), "least_id", "_rl_key")
    of_root = materialise(classes.groupBy("root").agg(F.min("least_id").alias("class_id"), F.min(one).alias("one"), F.sum("copies").alias("members"), F.count(F.lit(1)).alias("count")), "join-roots")
    whole = join_hot(classes, of_root.drop("count"), "root", counts=of_root.select("root", "count"))
    whole = materialise(whole.select("_rl_key", "least_id", "copies", "linked", "class_id", "members", (F.col("one._rl_key") == F.col("_rl_key")).alias("stays")), "join-classes")
    discard(classes, of_root)
    return signed.select("doc_id", "_rl_key", "n"), whole


def join_similar(docs: DataFrame) -> DataFrame:
    """``doc_id, class_id, n_links`` for every row of ``docs`` (doc_id, text).

    Two documents are linked if the Jaccard similarity of their sets of five-word shingles is 0.8 or more; words are runs of
    characters that are not ASCII white space, in lower case. ``n_links``: other documents linked to it, exact copies included.
    ``class_id``: the least id of the documents that links connect with it.

    A text of one to four words has one shingle, all its words. Null, empty and blank texts are linked to nothing, and are a class each.
    Null ids: such documents are linked like others; a class without any id has the class id null.
    Repeated rows are documents of their own. Other columns are ignored.
    """
    rows, classes = _classes(docs)
    by_key = classes.select("_rl_key", "class_id", (F.col("linked") + F.col("copies") - 1).cast("long").alias("n_links"))
    found = join_hot(rows.filter("n > 0"), by_key, "_rl_key", counts=classes.select("_rl_key", F.col("copies").alias("count")))
    blank = rows.filter("n = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return found.select("doc_id", "class_id", "n_links").unionByName(blank)


def drop_similar(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each class, that of the least id; all columns. Texts without words all stay.

    Of rows that repeat its id and text, that stays whose other columns come first as JSON.
    """
    _, classes = _classes(docs.select("doc_id", "text"))
    keep = classes.filter("stays").select(F.col("_rl_key").alias("_rl_k"), F.col("least_id").alias("_rl_id"))
    rows = docs.withColumn("_rl_key", F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))))
    match = (F.col("_rl_key") == F.col("_rl_k")) & F.col("doc_id").eqNullSafe(F.col("_rl_id"))
    maybe, alone = split_by_keys(rows, "_rl_key", classes.filter("members > 1").select("_rl_key"))
    stays = maybe.join(keep, match, "left_semi")
    if not stays.groupBy("_rl_key").count().filter("count > 1").isEmpty():  # repeated rows of one document
        whole = F.struct(*[F.col(f"`{c}`") for c in stays.columns])
        others = F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")], F.lit(0)))
        stays = stays.groupBy("_rl_key").agg(F.min_by(whole, others).alias("_rl_row")).select("_rl_row.*")
    has_words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    stays = stays.unionByName(alone.filter(has_words))
    return stays.unionByName(rows.filter(~has_words)).select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark, sf_dir):
    """Class and number of links of every document."""
    return join_similar(documents(spark, sf_dir))


def stage(spark, docs, sf_dir):
    """One document of each class."""
    return drop_similar(docs)


#: Exact similarities of all texts that share a shingle, and classes by reachability.
SQL = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
t AS (SELECT text, row_number() OVER (ORDER BY text) AS i, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w, count(*) AS copies FROM d GROUP BY text),
own AS (SELECT DISTINCT i, hash(array_to_string(list_slice(w, p, p + {WORDS - 1}), ' ')) AS s FROM (SELECT i, w, unnest(range(1, greatest(2, len(w) - {WORDS - 2}))) AS p FROM t WHERE len(w) > 0)),
sizes AS (SELECT i, count(*) AS n FROM own GROUP BY i),
pair AS (SELECT a.i AS a, b.i AS b, count(*) AS shared FROM own a JOIN own b ON a.s = b.s AND a.i < b.i GROUP BY ALL),
link AS (SELECT a, b FROM pair JOIN sizes x ON x.i = a JOIN sizes y ON y.i = b WHERE shared >= {THRESHOLD} * (x.n + y.n - shared) - 1e-9),
both_ways AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT i AS a, i AS b FROM sizes UNION SELECT reach.a, e.b FROM reach JOIN both_ways e ON reach.b = e.a),
root AS (SELECT a AS i, min(b) AS root FROM reach GROUP BY a),
degree AS (SELECT a AS i, sum(copies) AS linked FROM both_ways JOIN t ON t.i = b GROUP BY a),
least_id AS (SELECT root, min(doc_id) AS class_id FROM root JOIN t USING (i) JOIN d USING (text) GROUP BY root)
SELECT doc_id, CASE WHEN len(w) > 0 THEN class_id ELSE doc_id END AS class_id, CASE WHEN len(w) > 0 THEN copies - 1 + coalesce(linked, 0) ELSE 0 END::BIGINT AS n_links
FROM d JOIN t USING (text) LEFT JOIN root USING (i) LEFT JOIN least_id USING (root) LEFT JOIN degree USING (i)"""
