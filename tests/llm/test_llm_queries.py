"""Every registered query of the subpackage on the smallest tables: against its SQL where there is one, against plain versions else."""

import os
import re
import zlib

import duckdb
import numpy as np
import pytest
import zstandard

from routeloom.llm import quality_model, quality_rules
from routeloom.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_says_what_its_sql_says(spark, oracle, name):
    got = QUERIES[name](spark, SF)
    names = sorted(got.columns)
    want = oracle.execute(SQL[name]).to_arrow_table()
    assert sorted(want.column_names) == names
    assert plain(tuple(r) for r in got.select(*names).collect()) == plain(tuple(r[n] for n in names) for r in want.select(names).to_pylist())


def plain_kept(text):
    """Compression bands step by step: limits looked up by hand, the text cut by hand."""
    bands = quality_rules.BANDS

    def inside(data):
        n, ratio = len(data), len(zstandard.ZstdCompressor(level=3).compress(data)) / len(data)
        low = [limit for upto, limit in bands.least if upto is None or n <= upto][0]
        points = list(bands.most)
        if n <= points[0][0]:
            high = points[0][1]
        elif n >= points[-1][0]:
            high = points[-1][1]
        else:
            (x0, y0), (x1, y1) = next((a, b) for a, b in zip(points, points[1:]) if a[0] <= n <= b[0])
            high = y0 + (y1 - y0) * (n - x0) / (x1 - x0)
        return low <= ratio <= high + 1e-12

    data = text.encode()
    if not data or not inside(data):
        return not data
    if len(data) <= 4096:
        return True
    chunks = [data[i : i + 4096] for i in range(0, len(data), 4096)]
    if len(chunks[-1]) < 1024:
        chunks[-1] = data[-1024:]
    return sum(not inside(c) for c in chunks) <= 0.02 * len(chunks)


def test_kept_is_the_verdict_of_the_bands(spark, oracle):
    texts = dict(oracle.execute("SELECT doc_id, text FROM documents").fetchall())
    rows = QUERIES["op3_quality_rules"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r["kept"] == (not r["base_failed"] and plain_kept(texts[r["doc_id"]] or "")), r["doc_id"]


def test_added_spans_hold_the_base_spans(spark, oracle):
    texts = dict(oracle.execute("SELECT doc_id, text FROM documents").fetchall())
    for r in QUERIES["op7_pii"](spark, SF).collect():
        spans = [s.split(":") for s in r["spans"].split(",")] if r["spans"] else []
        assert r["n_spans"] == len(spans) and sum(r[f"n_{k}"] for k in ("email", "ip", "card", "phone")) == sum(s[0] in ("email", "ip", "card", "phone") for s in spans)
        assert len(re.findall(r'token = "[0-9a-f]{40}"', texts[r["doc_id"]] or "", re.I)) <= sum(s[0] == "secret" for s in spans)


def test_scores_tell_the_labels_held_out(spark, oracle):
    quality = dict(oracle.execute("SELECT doc_id, quality FROM labels").fetchall())
    rows = QUERIES["op1_quality_model"](spark, SF).collect()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    held = [(r["predicted"], quality[r["doc_id"]]) for r in rows if r["held_out"] and quality.get(r["doc_id"]) is not None]
    assert held and np.mean([a == b for a, b in held]) >= 0.9


def plain_fit(x, y, steps=4_000):
    """Bradley-Terry by plain gradient ascent over all pairs of a good and a bad row, with the same penalty."""
    z = ((x - x.mean(0)) / (x.std(0) + 1e-6)).clip(-8, 8)
    d = np.array([z[i] - z[j] for i in np.flatnonzero(y == 1) for j in np.flatnonzero(y == 0)])
    w = np.zeros(x.shape[1])
    rate = 1 / (np.linalg.norm(d, 2) ** 2 / len(d) / 4 + 1e-3)
    for _ in range(steps):
        w += rate * (d.T @ (1 / (1 + np.exp(d @ w))) / len(d) - 1e-3 * w)
    return z @ w


def test_fit_is_that_of_all_pairs():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, quality_model.FEATURES))
    x[:, 6:] = 0
    y = (x[:, 0] + 0.5 * x[:, 1] + rng.normal(size=60) * 0.7 > 0).astype(int)
    model = quality_model.fit(x, y)
    score = ((x - model.mean) / model.scale).clip(-8, 8) @ model.weight
    want = plain_fit(x[:, :6], y)
    assert np.corrcoef(score, want)[0, 1] > 0.98  # pairs are drawn, so the fit is near that of all pairs, not the same
    assert ((score > model.cut) == (y == 1)).mean() >= 0.8
