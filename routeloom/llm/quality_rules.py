"""Quality rules: base counts of a text, and compression bands.

The zstandard ratio (bytes out / bytes in) of the whole text, and of fixed chunks of it, must lie in a band.
The limits depend on the length, for short input compresses badly whatever it says: repetitive text falls
below its band, incompressible text above.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from routeloom.llm.common import WORD, documents, small_arrow_batches

_WORD = re.compile(WORD)
_SYMBOL = re.compile(r"[#*$%&|<>]")


@dataclass(frozen=True)
class Bands:
    """Limits of the ratio by bytes of input, for whole texts and for chunks alike.

    ``least``: (up to so many bytes, limit), the last without end. ``most``: (bytes, limit), with straight lines between.
    The upper limits lie above what slices of the corpus's prose reach at most (10,593 of 100 bytes: 1.09; 7,797 of 1,000: 0.61;
    1,827 of 4,096: 0.48) and, from 1,000 bytes on, below random lower-case letters (0.62 of 1,000 bytes, 0.59 of 4,096); base64
    (0.79 and 0.76) is above them from 200 bytes on. Shorter input does not tell letters from words. A few words said again and again go below 0.1.
    ``chunks_out``: the share of a text's chunks that may be outside: with fewer than 50 chunks, none.
    """

    least: tuple = ((200, 0.35), (1_000, 0.30), (4_000, 0.25), (None, 0.20))
    most: tuple = (
        (64, 1.30), (100, 1.10), (150, 0.98), (200, 0.88), (300, 0.79), (400, 0.75), (600, 0.69), (800, 0.655), (1_000, 0.615),
        (1_200, 0.60), (1_500, 0.58), (2_000, 0.57), (3_000, 0.55), (4_096, 0.54), (20_000, 0.52),
    )
    chunk_bytes: int = 4_096
    least_chunk: int = 1_024
    chunks_out: float = 0.02
    level: int = 3

    def hold(self, data: bytes | memoryview, packer: zstandard.ZstdCompressor) -> bool:
        """Whether the ratio of ``data`` lies within the limits for its length."""
        n = len(data)
        ratio = len(packer.compress(data)) / n
        least = next(low for upto, low in self.least if upto is None or n <= upto)
        return least <= ratio <= np.interp(n, *zip(*self.most, strict=True))


BANDS = Bands()


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words``."""
    words = _WORD.findall(text)
    symbols = len(_SYMBOL.findall(text))
    seen, dup_lines = set(), 0
    for line in text.split("\n"):
        if line in seen:
            dup_lines += 1
        elif _WORD.search(line):
            seen.add(line)
    return len(words), sum(map(len, words)), symbols, dup_lines, repeat_words(words)


def repeat_words(words: list[str]) -> int:
    """Words that stand in a window of five words that the text holds twice or more, the first time included."""
    windows = list(zip(words, words[1:], words[2:], words[3:], words[4:], strict=False))
    first: dict = {}
    covered = bytearray(len(words)) if len(set(windows)) < len(windows) else None
    if covered is None:
        return 0
    for i, w in enumerate(windows):
        j = first.setdefault(w, i)
        if j != i:
            covered[i : i + 5] = b"\1\1\1\1\1"
            covered[j : j + 5] = b"\1\1\1\1\1"
    return sum(covered)


def in_bands(data: bytes, bands: Bands = BANDS, packer=None) -> bool:
    """The verdict of the compression bands. No bytes: nothing to reject."""
    if not data:
        return True
    packer = packer or zstandard.ZstdCompressor(level=bands.level)
    if not bands.hold(data, packer):
        return False
    size = bands.chunk_bytes
    if len(data) <= size:  # one chunk, seen already
        return True
    view = memoryview(data)
    starts = range(0, len(data), size)
    # a tail too short to be told is moved back, so that every byte is in a chunk
    chunks = (view[min(at, len(data) - bands.least_chunk) : at + size] for at in starts)
    return sum(not bands.hold(c, packer) for c in chunks) <= bands.chunks_out * len(starts)


def apply_rules(docs: DataFrame, bands: Bands = BANDS, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: ``id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept``.

    A null text has no words and fails; so does an empty one. Null ids stay null; repeated rows are kept. Other columns are ignored.
    """
    small_arrow_batches(docs.sparkSession)

    def verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=bands.level)
        for batch in batches:
            rows = []
            for value in batch.column(1):
                text = value.as_py() or ""
                n, chars, symbols, dup, repeat = base_counts(text)
                failed = n < 10 or 100 * repeat > 20 * n
                rows.append((n, chars, symbols, dup, repeat, failed, not failed and in_bands(text.encode(), bands, packer)))
            cols = list(zip(*rows, strict=True)) or [()] * 7
            arrays = [pa.array(c, pa.int64()) for c in cols[:5]] + [pa.array(c, pa.bool_()) for c in cols[5:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=names)

    names = [id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    id_type = docs.schema[id_col].dataType.simpleString()
    kinds = [id_type, "long", "long", "long", "long", "long", "boolean", "boolean"]
    return docs.select(id_col, text_col).mapInArrow(verdicts, ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds, strict=True)))


def query(spark, sf_dir):
    """Verdict on every document."""
    return apply_rules(documents(spark, sf_dir))


def base_counts_query(spark, sf_dir):
    """Base counts and the base verdict of every document."""
    return apply_rules(documents(spark, sf_dir)).drop("kept")


#: The same from the words and lines themselves; compression has no SQL.
BASE_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS x FROM documents),
w AS (SELECT r, doc_id, x, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS words FROM t),
win AS (SELECT r, i, list_slice(words, i, i + 4) AS s FROM (SELECT r, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)),
twice AS (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, s) > 1),
again AS (SELECT r, count(DISTINCT i + j) AS n FROM twice, range(5) AS g(j) GROUP BY r),
lines AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM (SELECT r, unnest(string_split(x, chr(10))) AS line FROM t) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda s: length(s))), 0)::BIGINT AS word_chars, len(regexp_extract_all(x, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  coalesce(lines.n, 0)::BIGINT AS n_dup_lines, coalesce(again.n, 0)::BIGINT AS n_repeat_words, len(words) < 10 OR 100 * coalesce(again.n, 0) > 20 * len(words) AS base_failed
FROM w LEFT JOIN lines USING (r) LEFT JOIN again USING (r)"""
