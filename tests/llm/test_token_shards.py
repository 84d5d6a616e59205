"""Token shards: the permutation, the files, seeking and going on, against plain versions."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from routeloom.llm import token_shards

from .cases import SCHEMA, odd_documents, words

M64 = 2**64 - 1


def plain_permute(i, n, key, rounds=6):
    """One number at a time, in Python integers."""
    b = max(1, ((max(n, 1) - 1).bit_length() + 1) // 2)

    def mixed(half, turn):
        h = half ^ ((key + (turn + 1) * 0x9E3779B97F4A7C15) & M64)
        h = ((h ^ (h >> 30)) * 0xBF58476D1CE4E5B9) & M64
        h = ((h ^ (h >> 27)) * 0x94D049BB133111EB) & M64
        return h ^ (h >> 31)

    while True:
        left, right = i >> b, i % 2**b
        for turn in range(rounds):
            left, right = right, left ^ (mixed(right, turn) % 2**b)
        i = left * 2**b + right
        if i < n:
            return i


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 4097])
def test_permutation(n):
    places = token_shards.permute(np.arange(n), n)
    assert sorted(places) == list(range(n))
    assert list(places) == [plain_permute(i, n, token_shards.KEY) for i in range(n)]


def test_permutation_of_wide_numbers_and_keys():
    n = 3 * 2**59 + 7
    some = [0, 1, n // 2, n - 1]
    assert list(token_shards.permute(np.array(some), n)) == [plain_permute(i, n, token_shards.KEY) for i in some]
    assert list(token_shards.permute(np.arange(100), 100, key=1)) != list(token_shards.permute(np.arange(100), 100, key=2))


def test_long_white_space_is_encoded_as_it_would_be(monkeypatch):
    own = token_shards.coder(token_shards.load_ranks())
    monkeypatch.setattr(token_shards, "LONG_RUN", 5)
    monkeypatch.setattr(token_shards, "_LONG_SPACE", token_shards.re.compile(token_shards._LONG_SPACE.pattern.replace("10000", "5")))
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice([" ", " " * 9, "\n" * 7, "\t \u2003 \xa0   ", "ab", "don't", "7", "!?", "\u3000" * 6, "é"]) for _ in range(rng.randrange(12)))
        assert token_shards.encode(own, text) == own.encode_ordinary(text)


def brute(rows, ranks, tokens, key):
    """Records in order: documents in their order, numbered, permuted and sorted, all in memory."""
    own = token_shards.coder(ranks)
    room = max(len((t or "").encode()) // tokens + 1 for _, t in rows)
    out = []
    for number, (doc_id, text) in enumerate(rows):
        ids = token_shards.encode(own, text or "") + [token_shards.END_OF_TEXT]
        for part in range((len(ids) - 1) // tokens + 1):
            piece = np.array(ids[part * tokens : (part + 1) * tokens], "<u2").tobytes()
            out.append((plain_permute(number * room + part, len(rows) * room, key), doc_id, part, len(piece) // 2, zlib.crc32(piece)))
    return [(slot, *r[1:]) for slot, r in enumerate(sorted(out))]


COLUMNS = ("slot", "doc_id", "part", "n_tokens", "tokens_crc32")


def read(df):
    return [tuple(r[c] for c in COLUMNS) for r in df.orderBy("slot").collect()]


def test_shards_against_brute_force(spark, tmp_path):
    ranks = token_shards.load_ranks()
    source, path = str(tmp_path / "docs"), str(tmp_path / "out")
    odd = spark.createDataFrame(odd_documents(), SCHEMA)
    odd.coalesce(1).write.parquet(source)
    docs = spark.read.parquet(source)
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], ranks, 64, token_shards.KEY)
    token_shards.write_shards(docs, path, ranks, in_files=True, tokens=64, per_shard=40)
    assert read(token_shards.read_shards(spark, path)) == want
    for first in (1, 777, len(want) - 1, len(want)):  # going on from a slot
        assert read(token_shards.read_shards(spark, path, first=first)) == want[first:]

    form, coder = token_shards.read_format(spark, path), token_shards.coder(ranks)
    for slot in (0, 5, len(want) - 1):  # a seek
        file, at = token_shards.locate(spark, path, slot)
        with open(file.removeprefix("file:"), "rb") as f:
            f.seek(at)
            record = np.frombuffer(f.read(form.stride), form.record)[0]
        _, doc_id, part, n, crc = want[slot]
        assert (record["part"], record["n_tokens"], zlib.crc32(record["tokens"][:n].tobytes())) == (part, n, crc)
        assert bool(record["has_id"]) == (doc_id is not None) and (record["tokens"][n:] == token_shards.END_OF_TEXT).all()
    assert token_shards.locate(spark, path, len(want)) is None
    whole = [r["tokens"] for r in token_shards.read_shards(spark, path).filter("doc_id = 6").orderBy("part").collect()]
    assert coder.decode(np.frombuffer(b"".join(whole), "<u2")[:-1].tolist()) == next(r[1] for r in odd_documents() if r[0] == 6)


def test_order_does_not_depend_on_splits(spark, tmp_path):
    ranks, rng = token_shards.load_ranks(), random.Random(2)
    rows = [(i, " ".join(words(rng, rng.randrange(300)))) for i in range(200)] + [(7, "same"), (7, "same"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen = []
    for kind, parts in (("long", 1), ("long", 50), ("string", 1), ("string", 50)):
        path = str(tmp_path / f"{kind}{parts}")
        token_shards.write_shards(docs.select(F.col("doc_id").cast(kind).alias("doc_id"), "text").repartition(parts), path, ranks, tokens=64, per_shard=100)
        seen.append(read(token_shards.read_shards(spark, path)))
    assert seen[0] == seen[1] and seen[2] == seen[3]
    as_text = lambda rows: [(s, None if d is None else str(d), *r) for s, d, *r in rows]
    assert sorted(as_text(seen[0]), key=str) == sorted(map(tuple, seen[2]), key=str)
    assert [r[0] for r in seen[0]] == list(range(len(seen[0])))


def test_split_size_of_the_query_does_not_matter(spark):
    first = read(token_shards.query(spark, "/root/testdata/sf0.001"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        assert read(token_shards.query(spark, "/root/testdata/sf0.001")) == first
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_empty_and_white_space(spark, tmp_path):
    ranks = token_shards.load_ranks()
    none = spark.createDataFrame([], SCHEMA)
    form = token_shards.write_shards(none, str(tmp_path / "none"), ranks)
    assert form.n_shards == 0 and token_shards.read_shards(spark, str(tmp_path / "none")).count() == 0
    blank = spark.createDataFrame([(1, " " * 1_100_000), (2, "\n" * 1_100_000 + "word")], "doc_id int, text string")
    token_shards.write_shards(blank, str(tmp_path / "blank"), ranks)
    got = token_shards.read_shards(spark, str(tmp_path / "blank"))
    assert {r["doc_id"] for r in got.collect()} == {1, 2} and dict(got.dtypes)["doc_id"] == "int"
