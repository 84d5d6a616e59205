"""Operators that look at whole tables, against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from routeloom.llm import common, decontamination, jaccard_join, mixing, quality_model, sharding
from routeloom.llm.common import doc_key
from routeloom.llm.components import components
from pyspark.sql import functions as F

from .cases import SCHEMA, near_copies, odd_documents, words


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_documents(), SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def lower_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())


def shingles(ws, k=5):
    return {tuple(ws)} if 0 < len(ws) < k else {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)}


def brute_links(texts):
    sets = [shingles(lower_words(t)) for t in texts]
    return {
        (i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j]
        and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9
    }


def check_join(spark, rows, schema, monkeypatch=None):
    got = jaccard_join.join_similar(spark.createDataFrame(rows, schema)).collect()
    links = brute_links([r[1] for r in rows])
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    degree = Counter()
    for i, j in links:
        degree[i] += 1
        degree[j] += 1
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    members = defaultdict(list)
    for i, r in enumerate(rows):
        members[find(i)].append(r[0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in members.items()}
    want = sorted(((r[0], least[find(i)], degree[i]) for i, r in enumerate(rows)), key=str)
    assert sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in got), key=str) == want


def test_join_finds_all_links(spark, monkeypatch):
    rng = random.Random(3)
    texts = near_copies(rng) + [" ".join(words(rng, rng.randrange(1, 40))) for _ in range(30)]
    texts += [texts[0]] * 3
    rows = [(i, t, "ab"[i % 2]) for i, t in enumerate(texts)]
    check_join(spark, rows, "doc_id long, text string, source string")


def test_join_of_a_large_group(spark, monkeypatch):
    """Many near-copies of one text: buckets over the limit, and a group of several tiles."""
    monkeypatch.setattr(jaccard_join, "LISTED", 4)
    monkeypatch.setattr(jaccard_join, "TILE_TEXTS", 20)
    rng = random.Random(4)
    rows = [(i, t) for i, t in enumerate(near_copies(rng, 1, 90, 80) + [" ".join(words(rng, 50)) for _ in range(9)])]
    check_join(spark, rows, "doc_id long, text string")


@pytest.mark.parametrize("families", [1, 6])
def test_join_where_passages_are_shared(spark, monkeypatch, families):
    """Large buckets of texts that share a passage only, with families of near-copies among them, and chains of slow change."""
    monkeypatch.setattr(jaccard_join, "LISTED", 3)
    monkeypatch.setattr(jaccard_join, "TILE_TEXTS", 16)
    rng = random.Random(11)
    passage = words(rng, 60)
    texts = [" ".join(words(rng, 15) + passage + words(rng, 15)) for _ in range(60)]
    for _ in range(families):
        base = words(rng, 12) + passage + words(rng, 12)
        for _ in range(20):
            edited = list(base)
            for _ in range(rng.randrange(3)):
                edited[rng.randrange(len(edited))] = "edit" + str(rng.randrange(100))
            texts.append(" ".join(edited))
    chain = words(rng, 100)
    for i in range(40):
        texts.append(" ".join(chain[i:] + [f"tail{j}" for j in range(i)]))
    check_join(spark, list(enumerate(texts)), "doc_id int, text string")


def test_join_of_hot_keys(spark, monkeypatch):
    """Keys that hold many rows are joined by broadcast: exact copies, and one large group."""
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    rng = random.Random(12)
    texts = near_copies(rng, 2, 30, 60)
    check_join(spark, list(enumerate(texts + [texts[0]] * 20 + [""] * 20 + [None] * 9)), "doc_id long, text string")


@pytest.mark.parametrize("kind", ["int", "bigint", "string", "smallint"])
def test_one_document_stays_whatever_the_ids_are(spark, kind):
    rows = [(1, "a b c d e f", "x"), (2, "a b c d e f", "y"), (2, "a b c d e f", "b"), (None, "a b c d e f", "z"), (3, "other words altogether here now", "x"), (None, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("doc_id", F.col("doc_id").cast(kind))
    kept = jaccard_join.drop_similar(docs)
    assert sorted(map(str, (tuple(r) for r in kept.collect()))) == sorted(map(str, [(r[0] if kind != "string" or r[0] is None else str(r[0]), *r[1:]) for r in (rows[0], rows[4], rows[5])]))
    again = jaccard_join.drop_similar(docs.filter("doc_id = 2")).collect()
    assert [r["source"] for r in again] == ["b"]  # of repeated rows, that whose other columns come first


def test_join_on_odd_rows(spark, odd, nothing):
    check_join(spark, odd_documents(), SCHEMA)
    assert jaccard_join.join_similar(nothing).count() == 0
    assert jaccard_join.drop_similar(nothing).count() == 0
    kept = jaccard_join.drop_similar(odd)
    assert kept.columns == odd.columns
    ids = sorted(str(r["doc_id"]) for r in kept.collect())
    assert ids == sorted(["1", "3", "4", "5", "6", "None", "7", "9"])


def test_pruning_keeps_what_reaches_the_threshold():
    rng = np.random.default_rng(1)
    n, lost = 20_000, 0
    left = rng.integers(0, 60_000, (n, 180)).astype(np.uint16)
    right = np.where(rng.random((n, 180)) < 0.8, left, rng.integers(0, 60_000, (n, 180))).astype(np.uint16)
    lost = n - len(jaccard_join.plausible(left, right))
    assert lost <= 1
    far = np.where(rng.random((n, 180)) < 0.4, left, rng.integers(0, 60_000, (n, 180))).astype(np.uint16)
    assert len(jaccard_join.plausible(left, far)) < n / 1000


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 100), (7, 7), (200, 201), (200, 201)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_leaks(spark, odd, nothing):
    rng = random.Random(6)
    items = [(i, " ".join(words(rng, n))) for i, n in enumerate([1, 3, 5, 6, 12, 40, 200])] + [(90, None), (91, " . "), (None, " ".join(words(rng, 9)))]
    docs = []
    for d in range(60):
        ws = words(rng, rng.randrange(0, 300))
        for _, t in rng.sample(items, 2):
            part = (t or "").split()
            if part and rng.random() < 0.3:
                part[rng.randrange(len(part))] = "other"
            at = rng.randrange(len(ws) + 1)
            ws[at:at] = [w.upper() + "!" for w in part]
        docs.append((d, " ".join(ws), "x"))
    alnum = lambda t: re.findall(r"[^\W_]+", (t or "").lower())

    def brute(docs):
        for i, t in items:
            ws = alnum(t)
            k = min(5, len(ws))
            s = {tuple(ws[j : j + k]) for j in range(len(ws) - k + 1)} if k else set()
            for d, text in docs:
                dw = alnum(text)
                own = {tuple(dw[j : j + k]) for j in range(len(dw) - k + 1)}
                if s and len(s & own) >= 0.8 * len(s) - 1e-9:
                    yield d, i, len(s & own)

    want = set(brute([r[:2] for r in docs]))
    tests = spark.createDataFrame(items, "item_id long, text string")
    frame = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    for block in (16_000_000, 300):  # in one block, and in several
        got = decontamination.find_leaks(frame, tests, block_chars=block)
        assert {(r["doc_id"], r["item_id"], r["shared"]) for r in got.collect()} == want
    for kind in ("int", "string"):  # ids of any type; repeated items give their rows each
        twice = tests.unionByName(tests.filter("item_id = 5")).withColumn("item_id", F.col("item_id").cast(kind))
        got = Counter((r["doc_id"], r["item_id"], r["shared"]) for r in decontamination.find_leaks(frame, twice, block_chars=300).collect())
        own = {"int": lambda i: i, "string": lambda i: None if i is None else str(i)}[kind]
        assert got == Counter({(d, own(i), n): 2 if i == 5 else 1 for d, i, n in want})
    clean = decontamination.drop_leaks(frame, tests, block_chars=300)
    assert {r["doc_id"] for r in clean.collect()} == set(range(60)) - {d for d, _, _ in want} and clean.columns == frame.columns
    leaked = {n for n, _, _ in brute([(n, r[1]) for n, r in enumerate(odd_documents())])}
    assert decontamination.drop_leaks(odd, tests).count() == odd.count() - len(leaked)
    assert decontamination.find_leaks(nothing, tests).count() == 0
    assert decontamination.find_leaks(frame, tests.limit(0)).count() == 0


def test_mixing_meets_targets(spark, odd, nothing):
    rng = random.Random(7)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 60)), rng.choice("aaaaaabbbccd") if rng.random() < 0.95 else None) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    got = mixing.mix_sizes(docs).collect()
    total, by = sum(r["size"] for r in got), defaultdict(list)
    for r, s in ((r, rows[r["doc_id"]][2]) for r in got):
        by[s].append(r)
        assert r["taken"] <= 3 * r["size"] and r["taken"] % max(1, r["size"]) == 0
    assert abs(sum(v[0]["target"] for v in by.values()) - total) < 1e-6 * total
    for v in by.values():
        assert v[0]["target"] <= 3 * v[0]["source_size"] and abs(sum(r["taken"] for r in v) - v[0]["target"]) <= 60
    assert {(r["doc_id"], r["taken"]) for r in mixing.mix_sizes(docs.coalesce(1)).collect()} == {(r["doc_id"], r["taken"]) for r in got}
    mixed = mixing.mix(odd)
    assert mixed.count() == odd.count() and set(mixed.columns) == set(odd.columns) | {"source_size", "target", "taken", "copies"}
    assert mixing.mix(nothing).count() == 0
    only = mixing.mix(docs, {"a": 1}).agg(F.sum("taken")).first()[0]
    assert only == 3 * by["a"][0]["source_size"] or abs(only - total) <= 60


def test_shards_fit(spark, odd, nothing):
    rng = random.Random(8)
    rows = [(i % 400, "x" * rng.randrange(0, 90)) for i in range(500)] + [(1000, "y" * 5000)] + [(7, "same")] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = sharding.assign_shards(docs, doc_key(F.col("doc_id"), F.col("text")), F.octet_length("text"), 600).collect()
    assert len(out) == len(rows)
    sums = defaultdict(int)
    for r in out:
        sums[r["shard"]] += r["n_bytes"]
        assert len(r["shard"]) == r["depth"]
    assert all(sums[r["shard"]] == r["shard_bytes"] for r in out)
    assert {r["n_bytes"] for r in out if r["oversize"]} == {5000} and all(v <= 600 or v == 5000 for v in sums.values())
    names = sorted(sums)  # prefix-free, and no split that was not needed
    assert not any(b.startswith(a) for a, b in zip(names, names[1:]))
    placed = sharding.stage(spark, odd, "")
    assert placed.count() == odd.count() and sharding.stage(spark, nothing, "").count() == 0
    assert [r["shard"] for r in placed.select("shard").distinct().collect()] == [""]


def test_quality_model_learns(spark, odd, nothing):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(400):
        ws = words(rng, rng.randrange(20, 90))
        bad = i % 5 == 0
        rows.append((i, " ".join(w + "###" if bad else w for w in ws)))
        labels.append((i, int(not bad), None))
    labels += [(None, 1, 0), (3, 0, 0), (5, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    truth = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality_model.train(docs, truth.filter(~quality_model.held_out(F.col("doc_id"))))
    got = {r["doc_id"]: r["score"] for r in quality_model.score_documents(docs, model).collect()}
    assert all((got[i] >= quality_model.KEEP) == (i % 5 != 0) for i in got) and all(0 <= s <= 1 for s in got.values())
    again = quality_model.train(docs.repartition(5), truth.filter(~quality_model.held_out(F.col("doc_id"))))
    assert np.array_equal(model.weight, again.weight)
    assert quality_model.score_documents(odd, model).count() == odd.count()
    assert quality_model.keep_good(odd, model).columns == odd.columns
    untaught = quality_model.train(nothing, truth)
    assert quality_model.keep_good(odd, untaught).count() == odd.count() and quality_model.score_documents(nothing, model).count() == 0
