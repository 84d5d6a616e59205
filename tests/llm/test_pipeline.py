"""The pipeline's stages and the fitted query against plain Python, on the smallest tables."""

import os
import re
import zlib
from collections import defaultdict
from hashlib import md5

import numpy as np
import pyarrow.parquet as pq
import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from routeloom.llm import quality_model as qm
from routeloom.llm.common import materialise

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def rows(df):
    return [(r["doc_id"], r["text"], r["source"]) for r in df.select("doc_id", "text", "source").collect()]


def brute_quality(docs):
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{SF}/labels.parquet").to_pylist() if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2}
    packer = zstandard.ZstdCompressor(level=1)
    x = {d: qm.features(t or "", packer) for d, t, _ in docs}
    known = sorted(d for d in x if d in labels)
    model = qm.fit(np.array([x[d] for d in known]), np.array([labels[d] for d in known]))
    return sorted(r for r in docs if model.score(x[r[0]][None])[0] >= qm.KEEP)


def brute_distinct(docs):
    def shingles(t):
        ws = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5 else {tuple(ws)} - {()}

    sets, root = [shingles(t) for _, t, _ in docs], list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    best = {}
    for i, r in enumerate(docs):
        best[find(i)] = min(best.get(find(i), r), r)
    return sorted(best.values())


def brute_clean(docs):
    words = lambda t: re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (t or "").lower())
    grams = lambda ws: {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)}
    items = [grams(words(r["text"])) for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    return sorted(r for r in docs if not any(s and len(s & grams(words(r[1]))) >= 0.8 * len(s) - 1e-9 for s in items))


def brute_mix(docs):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    by = defaultdict(list)
    for r in docs:
        by[r[2]].append((int(md5(f"{r[0]}:{r[1]}".encode()).hexdigest()[:15], 16), size(r[1]), r))
    names = sorted(by, key=lambda s: (s is None, s))
    sums, weight = {s: sum(x[1] for x in by[s]) for s in names}, {s: 1 + i % 3 for i, s in enumerate(names)}
    capped = set()
    while True:
        unit = (sum(sums.values()) - sum(3 * sums[s] for s in capped)) / max(1, sum(weight[s] for s in names if s not in capped))
        more = {s for s in names if s not in capped and weight[s] * unit > 3 * sums[s]}
        if not more:
            break
        capped |= more
    out = []
    for s in names:
        target = 3 * sums[s] if s in capped else weight[s] * unit
        whole = min(3, int(target // sums[s])) if sums[s] else 0
        rest, took, extra = target - whole * sums[s], 0, set()
        for h, n, _ in sorted(by[s], key=lambda x: x[0]):
            if rest <= 0 or (took + n > rest and not rest - took > took + n - rest):
                break
            took += n
            extra.add(h)
            if took > rest:
                break
        for h, _, r in by[s]:
            out += [r] * (whole + (h in extra))
    return sorted(out)


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for (name, stage), brute in zip(corpus_pipeline.STAGES, [brute_quality, brute_distinct, brute_clean, brute_mix, sorted], strict=True):
        before = rows(docs)
        after = materialise(stage(spark, docs, SF), "test")
        assert sorted(rows(after)) == brute(before), name
        if name != corpus_pipeline.STAGES[-1][0]:
            assert after.columns == docs.columns
        docs = after
    assert docs.filter("oversize").count() == 0 and {"shard", "depth", "shard_bytes"} <= set(docs.columns)


def test_run_and_held_out_accuracy(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
    scored = qm.query(spark, SF)
    assert scored.count() == 200
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    held = scored.join(labels, "doc_id").filter("held_out").agg(F.avg((F.col("predicted") == F.col("quality")).cast("double"))).first()[0]
    assert held >= 0.9
