"""Word shingles of whole Arrow batches, by array operations on their bytes.

A word's hash is a polynomial over its bytes, taken as a difference of prefix sums; a
shingle's combines the hashes of its words. Both are exact arithmetic modulo 2**64 with a final mix, so equal
shingles have equal hashes in every task and run.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)  # odd, so that its powers have inverses
_INVERSE = _U(pow(int(_BASE), -1, 2**64))
_BYTES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.uint64)

#: Bytes that are no part of a word: ASCII white space, or all of ASCII but letters and digits.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[:128] = [not chr(b).isalnum() for b in range(128)]
SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM_WORD = re.compile(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")

#: Texts are taken together up to so many bytes; a longer one is alone.
CHUNK_BYTES = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        for i, b in enumerate((_BASE, _INVERSE)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _powers[i] = np.cumprod(p)
    return _powers[0][:n], _powers[1][:n]


def word_hashes(data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word in ``data`` (bytes of texts end to end), and where each text's words begin (one more than texts)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    word = ~gaps[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    begins = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[begins] = word[begins]
    last = word.copy()
    last[:-1] &= ~word[1:]
    ends = begins[1:] - 1
    last[ends] = word[ends]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last)
    power, inverse = _power_tables(n)
    sums = np.cumsum(_BYTES[data] * power)
    before = np.where(starts > 0, sums[starts - 1], _U(0))
    hashes = mix((sums[stops] - before) * inverse[starts])
    return hashes, np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, k: int, *, short: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's ``k``-word shingles, repeats kept, and their bounds.

    ``short``: a text of fewer words, but at least one, has one shingle, all its words.
    """
    counts = np.diff(bounds)
    n = np.maximum(counts - k + 1, 0)
    if len(words) >= k:
        total = np.zeros(len(words) - k + 1, np.uint64)
        for j in range(k):
            total += words[j : len(words) - k + 1 + j] * _U((int(_BASE) * (2 * j + 1) | 1) % 2**64)
        total = mix(total)
    else:
        total = np.zeros(0, np.uint64)
    out = np.concatenate([[0], np.cumsum(n + ((counts > 0) & (n == 0) if short else 0))]).astype(np.int64)
    if short and ((counts > 0) & (n == 0)).any():
        parts = []
        for a, b, m in zip(bounds[:-1], bounds[1:], n, strict=True):
            if m:
                parts.append(total[a : a + m])
            elif b > a:
                h = np.array([b - a], np.uint64)
                for i in range(a, b):
                    h = mix(h * _BASE + words[i : i + 1])
                parts.append(h)
        return np.concatenate(parts), out
    full = np.flatnonzero(n)
    take = np.repeat(bounds[full] - np.concatenate([[0], np.cumsum(n[full])[:-1]]), n[full]) + np.arange(n.sum())
    return total[take], out


def text_chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(from, to, bytes, offsets)`` for runs of a text column's rows, lower case, null as empty."""
    lower = pc.utf8_lower(pc.fill_null(column, ""))
    if pa.types.is_large_string(lower.type):
        kind = np.int64
    else:
        lower, kind = lower.cast(pa.string()), np.int32
    if not len(lower):
        return
    offsets = np.frombuffer(lower.buffers()[1], kind)[lower.offset : lower.offset + len(lower) + 1].astype(np.int64)
    data = np.frombuffer(lower.buffers()[2], np.uint8) if lower.buffers()[2] else np.zeros(0, np.uint8)
    at = 0
    while at < len(lower):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, side="right")) - 1)
        to = min(to, len(lower))
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def shingles_of(column: pa.Array, k: int, gaps: np.ndarray, *, short: bool) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(from, to, hashes, bounds)`` for runs of a text column's rows."""
    for at, to, data, offsets in text_chunks(column):
        words, bounds = word_hashes(data, offsets, gaps)
        yield at, to, *shingle_hashes(words, bounds, k, short=short)
