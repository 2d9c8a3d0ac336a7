"""Whole Arrow string columns as one byte array: words, q-gram hashes and sums without a Python loop over texts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
LETTER = np.random.Generator(np.random.PCG64(20240517)).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
OTHER = np.random.Generator(np.random.PCG64(20250921)).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes behind an Arrow string column, and where each text starts and ends in them. Null counts as empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    _, where, data = texts.buffers()
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    ends = np.frombuffer(where, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), ends


def packs(batches: Iterator[pa.RecordBatch], column: str | int, limit: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of runs of rows with up to `limit` bytes of text, or one longer text. Null counts as empty."""
    for batch in batches:
        texts = batch.column(column)
        if not len(texts):
            continue
        held, ends = flat(texts)
        first = 0
        while first < len(texts):
            last = max(first + 1, int(np.searchsorted(ends, ends[first] + limit, "right")) - 1)
            yield batch.slice(first, last - first), held[ends[first] : ends[last]], ends[first : last + 1] - ends[first]
            first = last


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


@lru_cache(8)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[0] = 1
    return np.cumprod(out, dtype=U)


def powers(base: int, n: int) -> np.ndarray:
    return _powers(base, 1 << max(16, (n - 1).bit_length()))[:n]


def sums(buf: np.ndarray, letters: np.ndarray = LETTER) -> np.ndarray:
    """Prefix sums from which `gram` takes the hash of any stretch. letters: another set of them gives other hashes."""
    out = np.zeros(len(buf) + 1, U)
    np.cumsum(letters[buf] * powers(BASE, len(buf)), dtype=U, out=out[1:]) if len(buf) else None
    return out


def gram(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes from start to end; equal bytes, equal hashes."""
    return mixed((prefix[end] - prefix[start]) * powers(INVERSE, len(prefix))[start])


def words(buf: np.ndarray, offsets: np.ndarray, outside: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) of each word `[^\\x20\\x09-\\x0D]+` (or of bytes not `outside`), and how many words each text has. No word crosses texts."""
    n = len(buf)
    inside = ~outside[buf]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:] = inside[:-1]
    after[:-1] = inside[1:]
    before[offsets[:-1][offsets[:-1] < n]] = False
    cut = offsets[1:][offsets[1:] > 0] - 1
    after[cut] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return start, end, np.diff(np.searchsorted(start, offsets))


def word_hashes(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words, and how many words each text has."""
    start, end, n = words(buf, offsets)
    return gram(sums(LOWER[buf]), start, end), n


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column: counts[i] of the values for row i."""
    at = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=at[1:])
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, kind))
