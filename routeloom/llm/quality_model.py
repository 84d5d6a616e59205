"""Quality classifier: Bradley-Terry ranking of documents by features of their text.

A document's score is linear in its features: counts of its surface, and shares of its words and their endings by hash, in any script. It is learned from preference pairs (a document labelled 1 before one
labelled 0) by logistic loss on the difference of their features, and cut at a quantile of the labelled documents' scores.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routeloom.llm.common import WORD, documents, small_arrow_batches
from routeloom.llm.quality_rules import repeat_words
from routeloom.llm.shingles import SPACE, word_hashes

#: Labelled rows that the model is fitted on, at most: those of lowest hash.
MAX_LABELLED = 20_000
#: Preference pairs, at most.
MAX_PAIRS = 200_000
#: Scores from here on are kept.
KEEP = 0.7

_WORD = re.compile(WORD)
_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "space": b" \t\n\v\f\r",
    "stop": b".,;:?",
    "bang": b"!",
    "bar": b"|",
    "mark": b"#*$%&<>",
    "bracket": b"()[]{}\"'",
    "other": b"@+-=/\\^_`~",
}
#: Lead bytes of characters beyond ASCII, by length: they tell scripts apart.
_CLASSES |= {"two": bytes(range(0xC2, 0xE0)), "three": bytes(range(0xE0, 0xF0)), "four": bytes(range(0xF0, 0xF5))}
_TABLE = np.zeros((256, len(_CLASSES)))
for _i, _chars in enumerate(_CLASSES.values()):
    _TABLE[list(_chars), _i] = 1
#: Buckets that words fall into by hash.
LEXICON = 96
SURFACE = 2 * len(_CLASSES) + 11
FEATURES = SURFACE + LEXICON
#: Pairs that are held as rows of differences at once.
_BLOCK = 16_384


def features(text: str, packer: zstandard.ZstdCompressor) -> np.ndarray:
    """Features of a whole text; of an empty one, zeros."""
    out = np.zeros(FEATURES)
    data = text.encode()
    words = _WORD.findall(text)
    if not words:
        return out
    share = np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ _TABLE / len(data)
    k = len(_CLASSES)
    out[:k], out[k : 2 * k] = share, np.log1p(200 * share)
    n = len(words)
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    distinct = len(counts) / n
    repeated = repeat_words(words) / n
    dup_lines = 1 - len(set(lines)) / max(1, len(lines))
    ratio = len(packer.compress(data)) / len(data)
    low = np.frombuffer(text.lower().encode(), np.uint8)
    hashes, _ = word_hashes(low, np.array([0, len(low)]), SPACE)
    out[SURFACE:] = np.sqrt(np.bincount((hashes >> np.uint64(40)) % np.uint64(LEXICON), minlength=LEXICON) / max(1, len(hashes)))
    out[2 * k : SURFACE] = (
        np.log1p(n),
        len(data) / n / 10,
        distinct,
        repeated,
        np.log1p(20 * repeated),
        dup_lines,
        max(counts.values()) / n if n > 20 else 0,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        min(ratio, 1.5),
        np.log(ratio) if n > 20 else 0,
        sum(not w[-1].isalnum() for w in words) / n,
    )
    return out


@dataclass(frozen=True)
class Model:
    """``score``: above :data:`KEEP` beyond the cut. Without pairs to learn from, every document scores 1."""

    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    cut: float
    width: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.weight.any():
            return np.ones(len(x))
        z = ((x - self.mean) / self.scale).clip(-8, 8) @ self.weight
        return 1 / (1 + np.exp(-((z - self.cut) / self.width).clip(-30, 30) - np.log(KEEP / (1 - KEEP))))


def fit(x: np.ndarray, y: np.ndarray, *, max_pairs: int = MAX_PAIRS, penalty: float = 1e-3, steps: int = 30) -> Model:
    """Learn from feature rows ``x`` and labels ``y`` (0, 1)."""
    mean, scale = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(FEATURES), np.ones(FEATURES))
    z = ((x - mean) / scale).clip(-8, 8)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    w = np.zeros(FEATURES)
    if not len(good) or not len(bad):
        return Model(mean, scale, w, 0.0, 1.0)
    rng = np.random.default_rng(7)
    pairs = min(max_pairs, len(good) * len(bad))
    first = rng.choice(good, pairs)
    second = np.resize(rng.permutation(bad), pairs)
    for _ in range(steps):  # Newton's method, over blocks of pairs
        gradient, hessian = -penalty * w, penalty * np.eye(FEATURES)
        for at in range(0, pairs, _BLOCK):
            d = z[first[at : at + _BLOCK]] - z[second[at : at + _BLOCK]]
            p = 1 / (1 + np.exp(-(d @ w)))
            gradient = gradient + d.T @ (1 - p) / pairs
            hessian = hessian + (d * (p * (1 - p))[:, None]).T @ d / pairs
        step = np.linalg.solve(hessian, gradient)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    score = z @ w
    order = np.sort(score)
    # the quantile at which the labelled documents are told apart best, both labels weighing the same
    rank_good = np.searchsorted(np.sort(score[good]), order)
    rank_bad = np.searchsorted(np.sort(score[bad]), order)
    right = (1 - rank_good / len(good)) + rank_bad / len(bad)
    at = int(np.argmax(right))
    cut = (order[at] + order[at - 1]) / 2 if at else order[0] - 1e-9
    return Model(mean, scale, w, float(cut), float(score.std()) or 1.0)


def train(docs: DataFrame, labels: DataFrame, *, max_labelled: int = MAX_LABELLED) -> Model:
    """Fit on ``labels`` (doc_id, quality), at most ``max_labelled`` of them. Labels that are null or that
    contradict each other for one document are left out; a document that is repeated counts once, by the text that comes first."""
    clear = (
        labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("_rl_y"), F.max("quality").alias("_rl_max"))
        .filter("_rl_y = _rl_max")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_labelled)
        .select(F.col("doc_id").alias("_rl_id"), "_rl_y")
    )
    chosen = docs.select("doc_id", "text").join(F.broadcast(clear), F.col("doc_id") == F.col("_rl_id"))
    chosen = chosen.groupBy("doc_id", "_rl_y").agg(F.min("text").alias("text"))  # at most max_labelled rows, however often a document is there

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            rows = [features(t.as_py() or "", packer) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in rows], pa.binary()), batch.column(1), batch.column(2)], names=["x", "y", "doc_id"])

    kinds = dict(docs.dtypes)
    got = chosen.select("text", F.col("_rl_y").cast("int"), "doc_id").mapInArrow(extract, f"x binary, y int, doc_id {kinds['doc_id']}").toPandas()
    got["x"] = got["x"].map(bytes)
    got = got.sort_values(["doc_id", "x"]).drop_duplicates("doc_id")  # the same order, so the same model, on every run
    x = np.frombuffer(b"".join(got["x"]), float).reshape(-1, FEATURES)
    return fit(x, got["y"].to_numpy())


def held_out(doc_id):
    """Rows whose labels are never learned from. Null ids are not among them, for they have no labels."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` of every row of ``docs`` (doc_id, text). Null texts are empty; repeated rows are kept; other columns are ignored."""
    spark = docs.sparkSession
    small_arrow_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            x = np.array([features(t.as_py() or "", packer) for t in batch.column(1)]).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(x), pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")


def keep_good(docs: DataFrame, model: Model, keep: float = KEEP) -> DataFrame:
    """The rows of ``docs`` that score ``keep`` or more, with all their columns."""
    spark = docs.sparkSession
    small_arrow_batches(spark)
    shared, at = spark.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            x = np.array([features(t.as_py() or "", packer) for t in batch.column(at)]).reshape(-1, FEATURES)
            yield batch.filter(pa.array(shared.value.score(x) >= keep))

    return docs.mapInArrow(run, docs.schema)


def _trained(spark, docs, sf_dir) -> Model:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return train(docs, labels.filter(~held_out(F.col("doc_id"))))


def query(spark, sf_dir):
    """Scores of all documents by a model that never saw the labels held out."""
    docs = documents(spark, sf_dir)
    scored = score_documents(docs, _trained(spark, docs, sf_dir))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= KEEP).cast("int").alias("predicted"))


def stage(spark, docs, sf_dir):
    """The documents that the classifier keeps."""
    return keep_good(docs, _trained(spark, docs, sf_dir))
