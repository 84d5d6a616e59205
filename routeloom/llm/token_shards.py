"""Token ids in training order, in fixed-stride binary shards.

Texts are encoded and cut into sequences of a fixed number of tokens. A sequence's number is its document's number times
the most sequences that any document may have, plus its part; no two have the same. A keyed Feistel permutation with cycle-walking maps these
numbers onto themselves, and that is the training order: it needs no sort, no count of tokens and no table of documents.
Ranges of permuted numbers are shards, dealt by range to partitions, which write them as binary files of fixed-stride records.

Permuted numbers are sparse; the *slot* of a sequence is its rank among them, 0 to N - 1. The index has each shard's first slot, and the
record of slot s is at ``(s - first_slot) * stride`` of its shard's file, so a reader seeks, and can go on from any slot.

Layout of a folder: ``format`` (one row: what the records look like), ``shards/shard=<n>/*.txt`` (records, nothing else),
``index`` (one row per shard), which is written last: a folder with an index is whole.

Record: has_id (1 byte), size of the id (4 bytes), id (8 bytes for integers, else as many as the longest has, as UTF-8, zeros behind), part (4),
n_tokens (4), all big-endian; then the tokens, 16 bits each, little-endian, end-of-text beyond n_tokens; then a line feed.
"""

from __future__ import annotations

import base64
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from routeloom.llm.common import doc_key, documents, materialise, shared_dir, small_arrow_batches

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How byte_bpe_50k cuts a text before merging (fixed value, part of the tokenizer).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END_OF_TEXT = 50_256
#: Tokens of a sequence, and sequences of a shard, about, at most.
TOKENS, PER_SHARD = 512, 32_768
KEY = 0x5EED_0F_0BDE2
#: Bytes of records that a partition writes, about, at most.
PARTITION_BYTES = 256 << 20
#: Shards of which the index is broadcast to readers; beyond, it is joined by shuffle.
BROADCAST_SHARDS = 500_000
#: Records that are made at once, about; a longer document's are more.
RECORDS_AT_ONCE = 2_048
#: White space runs from here on are encoded apart; the pattern's engine cannot take runs of any length.
LONG_RUN = 10_000
_LONG_SPACE = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG_RUN)
_INTEGERS = ("tinyint", "smallint", "int", "bigint")


def coder(ranks: dict[bytes, int]):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(own, text: str) -> list[int]:
    """The ids of a text. The pattern cuts a run of white space before its last character if a word follows, so there a long run may be cut off."""
    if len(text) < LONG_RUN:
        return own.encode_ordinary(text)
    out, at = [], 0
    for run in _LONG_SPACE.finditer(text):
        stop = run.end() if run.end() == len(text) else run.end() - 1
        out += own.encode_ordinary(text[at : run.start()])
        out += own._encode_single_piece(text[run.start() : stop])
        at = stop
    return out + own.encode_ordinary(text[at:])


def _mixed(half: np.ndarray, key: int, turn: int) -> np.ndarray:
    h = half ^ np.uint64((key + (turn + 1) * 0x9E3779B97F4A7C15) % 2**64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def permute(index: np.ndarray, n: int, key: int = KEY, rounds: int = 6) -> np.ndarray:
    """Where ``index`` (0 to n - 1) goes under a permutation of 0 to n - 1 that ``key`` sets; n up to 2**62.

    A balanced Feistel network permutes 2**(2b) >= n numbers; a number that leaves the range walks on until it is back.
    """
    bits = np.uint64(max(1, ((max(n, 1) - 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(bits)) - 1)
    out = index.astype(np.uint64)
    todo = np.ones(len(out), bool)
    while todo.any():
        left, right = out[todo] >> bits, out[todo] & mask
        for turn in range(rounds):
            left, right = right, left ^ (_mixed(right, key, turn) & mask)
        out[todo] = left << bits | right
        todo = out >= np.uint64(n)
    return out.astype(np.int64)


def load_ranks(path: str = TOKENIZER) -> dict[bytes, int]:
    """A tiktoken vocabulary file, read by the driver."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@dataclass(frozen=True)
class Format:
    """What a folder's records look like, and how its order was made: ``room`` numbers for each document, permuted
    within ``domain`` by ``key``; ``span`` permuted numbers to a shard."""

    tokens: int
    id_type: str
    id_width: int
    room: int
    domain: int
    span: int
    n_shards: int
    key: int

    @property
    def record(self) -> np.dtype:
        head = [("has_id", "u1"), ("id_size", ">u4"), ("id", f"S{self.id_width}"), ("part", ">u4"), ("n_tokens", ">u4")]
        return np.dtype([*head, ("tokens", "<u2", (self.tokens,)), ("end", "u1")])

    @property
    def stride(self) -> int:
        return self.record.itemsize


def _numbered(docs: DataFrame, in_files: bool) -> DataFrame:
    """``doc_id, text, file, at``: rows with their place. Rows that are in no files are written first, in order of their content."""
    rows = docs.select("doc_id", "text")
    if not in_files:
        key = doc_key(F.col("doc_id"), F.col("text"))
        rows = materialise(rows.withColumn("_rl_key", key).repartitionByRange("_rl_key").sortWithinPartitions("_rl_key", "doc_id", "text").drop("_rl_key"), "token-documents")
    return rows.select("doc_id", "text", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))


def _plan(rows: DataFrame, tokens: int, per_shard: int, key: int) -> tuple[Format, dict[str, int]]:
    """The format for ``rows``, and the number of each file's first row. The driver learns four numbers for each file.

    A token is a byte at least, so a text of b bytes has b // tokens + 1 sequences at most, its end-of-text included.
    """
    id_type = dict(rows.dtypes)["doc_id"]
    room = F.floor(F.coalesce(F.octet_length("text"), F.lit(0)) / F.lit(tokens)).cast("long") + 1
    width = F.max(F.octet_length(F.col("doc_id").cast("string")))
    files = rows.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.max(room).alias("most"), F.sum(room).alias("total"), width.alias("width")).collect()
    starts, n = {}, 0
    for f in sorted(files, key=lambda f: f["file"]):
        starts[f["file"]], n = n, n + f["n"]
    most = max((f["most"] for f in files), default=1)
    if n * most >= 1 << 62:
        raise ValueError("too many documents, or too long ones, for the numbers of the training order")
    n_shards = -(-sum(f["total"] for f in files) // per_shard)
    id_width = 8 if id_type in _INTEGERS else max([f["width"] or 0 for f in files] + [1])
    return Format(tokens, id_type, id_width, most, n * most, -(-(n * most) // max(1, n_shards)), n_shards, key), starts


def sequences(rows: DataFrame, form: Format, starts: dict[str, int], ranks: dict[bytes, int]) -> DataFrame:
    """``shard, place, record`` of all sequences of ``rows`` (doc_id, text, file, at); ``place``: the permuted number."""
    small_arrow_batches(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast((ranks, starts))
    integer = form.id_type in _INTEGERS

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, first = shared.value
        own, held, n = coder(vocabulary), [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                doc_id, text, file, at = (c[i].as_py() for c in batch.columns)
                raw = b"" if doc_id is None else doc_id.to_bytes(8, "big", signed=True) if integer else str(doc_id).encode()
                ids = np.array(encode(own, text or ""), "<u2")
                held.append((raw, doc_id is not None, first[file] + at, ids))
                n += len(ids) // form.tokens + 1
                if n >= RECORDS_AT_ONCE:
                    yield from packed(held)
                    held, n = [], 0
        yield from packed(held)

    def packed(held) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        raw, has_id, number, ids = zip(*held, strict=True)
        size = np.array([len(x) for x in ids])
        n = size // form.tokens + 1
        start = np.concatenate([[0], np.cumsum(n)[:-1]])
        part = np.arange(n.sum()) - np.repeat(start, n)
        out, tokens = np.zeros(n.sum(), form.record), np.full(n.sum() * form.tokens, END_OF_TEXT, "<u2")
        for at, x in zip(start * form.tokens, ids, strict=True):
            tokens[at : at + len(x)] = x
        out["has_id"], out["id_size"], out["part"], out["end"] = np.repeat(has_id, n), np.repeat([len(x) for x in raw], n), part, 10
        out["id"] = np.repeat(np.array(raw, f"S{form.id_width}"), n)
        out["n_tokens"], out["tokens"] = np.minimum(form.tokens, np.repeat(size + 1, n) - part * form.tokens), tokens.reshape(-1, form.tokens)
        place = permute(np.repeat(number, n) * form.room + part, form.domain, form.key)
        data = pa.Array.from_buffers(pa.binary(form.stride), len(out), [None, pa.py_buffer(out.tobytes())]).cast(pa.binary())
        yield from pa.Table.from_arrays([pa.array(place // form.span), pa.array(place), data], names=["shard", "place", "record"]).to_batches(RECORDS_AT_ONCE)

    return rows.mapInArrow(cut, "shard long, place long, record binary")


def write_shards(docs: DataFrame, path: str, ranks: dict[bytes, int], *, in_files: bool = False, tokens: int = TOKENS, per_shard: int = PER_SHARD, key: int = KEY) -> Format:
    """Write the sequences of ``docs`` (doc_id, text) to the new folder ``path``, of any store that Spark writes to.

    A document's tokens end with one end-of-text; its last sequence is filled up with more. A null or
    empty text is end-of-text alone. Ids are integers or strings (others are written as strings); null ids are kept, repeated rows too; other
    columns are ignored. An empty table has no shards and an empty index. A run of white space may have any length.

    ``in_files``: ``docs`` is a table as read from its files, no row more than once; a document's number is then its place in the files, in order
    of their names. Else it is its rank by content. Either way the order does not depend on how Spark splits the input.
    """
    spark = docs.sparkSession
    rows = _numbered(docs, in_files)
    form, starts = _plan(rows, tokens, per_shard, key)
    names = [*Format.__dataclass_fields__]
    spark.createDataFrame([tuple(getattr(form, n) for n in names)], ", ".join(f"{n} {'string' if n == 'id_type' else 'long'}" for n in names)).coalesce(1).write.parquet(f"{path}/format")
    if not form.n_shards:
        spark.createDataFrame([], _INDEX).write.parquet(f"{path}/index")
        return form
    wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), form.n_shards * per_shard * form.stride // PARTITION_BYTES)
    parts = min(form.n_shards, wanted)
    dealt = sequences(rows, form, starts, ranks).repartitionById(parts, F.expr(f"cast(shard * {parts} div {form.n_shards} as int)"))
    # the text sink writes bytes as they are, and a line feed behind each row: the record's last byte
    lines = dealt.sortWithinPartitions("shard", "place").select("shard", F.substring("record", 1, form.stride - 1).cast("string").alias("value"))
    lines.write.partitionBy("shard").option("compression", "none").text(f"{path}/shards")
    _index(spark, path, form).write.parquet(f"{path}/index")
    return form


_INDEX = "shard long, file string, n_sequences long, first_slot long"


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(f"{path}/shards")


def _index(spark: SparkSession, path: str, form: Format) -> DataFrame:
    """A row per shard, from the lengths of the files; their contents are not read. Running sums are taken in blocks, then over blocks."""
    n = F.assert_true(F.col("length") % form.stride == 0, F.lit("a shard is not whole")).isNull()
    found = _files(spark, path).filter(n).select(F.col("shard").cast("long").alias("shard"), F.col("path").alias("file"), F.floor(F.col("length") / form.stride).alias("n_sequences"))
    found = found.withColumn("_block", F.floor(F.col("shard") / 4_096))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    blocks = found.groupBy("_block").agg(F.sum("n_sequences").alias("n")).select("_block", F.coalesce(F.sum("n").over(before.orderBy("_block")), F.lit(0)).alias("_base"))
    inside = F.coalesce(F.sum("n_sequences").over(before.partitionBy("_block").orderBy("shard")), F.lit(0))
    return found.withColumn("_inside", inside).join(blocks, "_block").select("shard", "file", "n_sequences", (F.col("_base") + F.col("_inside")).alias("first_slot"))


def read_format(spark: SparkSession, path: str) -> Format:
    return Format(**spark.read.parquet(f"{path}/format").first().asDict())


def locate(spark: SparkSession, path: str, slot: int) -> tuple[str, int] | None:
    """``(file, byte offset)`` of the record of ``slot``; None if there is no such slot."""
    hit = spark.read.parquet(f"{path}/index").filter(F.lit(slot).between(F.col("first_slot"), F.col("first_slot") + F.col("n_sequences") - 1)).first()
    return hit and (hit["file"], (slot - hit["first_slot"]) * read_format(spark, path).stride)


def read_shards(spark: SparkSession, path: str, *, first: int = 0) -> DataFrame:
    """The records from slot ``first`` on: ``slot, shard, byte_offset, doc_id, part, n_tokens, tokens, tokens_crc32`` (of the ids as 16-bit bytes).

    Shards before it are not opened. A task holds one shard at a time.
    """
    small_arrow_batches(spark)
    form = read_format(spark, path)
    index = spark.read.schema(_INDEX).parquet(f"{path}/index")
    schema = f"slot long, shard long, byte_offset long, doc_id {form.id_type}, part long, n_tokens long, tokens binary, tokens_crc32 long"
    start = index.filter(F.col("first_slot") + F.col("n_sequences") > first).agg(F.min("shard")).first()[0]
    if start is None:
        return spark.createDataFrame([], schema)
    named = ["shard", "at", "id", "part", "n_tokens", "tokens"]

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(*batch.columns, strict=True):
                rows = np.frombuffer(content.as_buffer(), form.record)
                for low in range(0, len(rows), RECORDS_AT_ONCE):
                    some = rows[low : low + RECORDS_AT_ONCE]
                    ids = [r[:k] if has else None for r, k, has in zip(_bytes(some["id"]), some["id_size"].tolist(), some["has_id"].tolist(), strict=True)]
                    tokens = [t[: 2 * k] for t, k in zip(_bytes(some["tokens"]), some["n_tokens"].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(some), shard.as_py())), pa.array(low + np.arange(len(some))), pa.array(ids, pa.binary()),
                            pa.array(some["part"].astype(np.int64)), pa.array(some["n_tokens"].astype(np.int64)), pa.array(tokens, pa.binary()),
                        ],
                        names=named,
                    )

    files = _files(spark, path).filter(F.col("shard") >= start).select(F.col("shard").cast("long").alias("shard"), "content")
    rows = files.mapInArrow(records, "shard long, at long, id binary, part long, n_tokens long, tokens binary")
    doc_id = F.conv(F.hex("id"), 16, -10) if form.id_type in _INTEGERS else F.col("id").cast("string")
    starts = index.select("shard", "first_slot")
    placed = rows.join(F.broadcast(starts) if index.count() <= BROADCAST_SHARDS else starts, "shard").withColumn("slot", F.col("first_slot") + F.col("at"))
    return placed.filter(F.col("slot") >= first).select(
        "slot", "shard", (F.col("at") * form.stride).alias("byte_offset"), doc_id.cast(form.id_type).alias("doc_id"), "part", "n_tokens", "tokens", F.crc32("tokens").alias("tokens_crc32")
    )


def _bytes(column: np.ndarray) -> list[bytes]:
    """Each row of a column of records as bytes, zeros at the end included."""
    flat = np.ascontiguousarray(column)
    data, size = flat.tobytes(), flat.nbytes // max(1, len(flat))
    return [data[i : i + size] for i in range(0, len(data), size)]


def query(spark, sf_dir):
    """All documents' sequences by slot, read back from shards in the shared folder."""
    path = f"{shared_dir(spark)}/token-shards-{uuid.uuid4().hex}"
    write_shards(documents(spark, sf_dir), path, load_ranks(), in_files=True)
    return read_shards(spark, path).drop("tokens")
