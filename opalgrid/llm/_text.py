"""Vectorised text primitives over the flat byte buffers of Arrow string columns.

All positions are byte or word offsets inside one chunk; a chunk holds whole documents and about
``CHUNK_BYTES`` of text (a single longer document makes a chunk of its own).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

CHUNK_BYTES = 2 << 20
U64 = np.uint64


def _table(seps) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(seps)] = True
    return t


# Bytes that separate words.  Every byte of a multi-byte UTF-8 character is >= 0x80.
BLANK = _table([0x20, *range(0x09, 0x0E)])
NOT_ALNUM = _table([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (in place on a fresh copy)."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


BYTE_CODE = mix64(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
BASE = 0xD1342543DE82EF95
BASE_INV = pow(BASE, -1, 1 << 64)
WORD_BASE = 0xAF251AF3B0F025B5
WORD_BASE_INV = pow(WORD_BASE, -1, 1 << 64)
_POWERS: dict = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept between calls."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        out = np.full(size, base, U64)
        out[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(out)
    return have[:n]


class SpanHasher:
    """Hashes of any spans of a sequence from one prefix sum."""

    def __init__(self, values: np.ndarray, base: int, inverse: int):
        n = len(values)
        self.sums = np.zeros(n + 1, U64)
        np.cumsum(values * powers(base, n), out=self.sums[1:])
        self.back = powers(inverse, n + 1)

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix64((self.sums[ends] - self.sums[starts]) * self.back[starts] + (ends - starts).astype(U64))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return SpanHasher(BYTE_CODE[data], BASE, BASE_INV)(starts, ends)


def exact_ids(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, inside: np.ndarray | None = None) -> tuple[np.ndarray, pa.Array]:
    """Numbers of ascending, disjoint spans, and the distinct byte strings they stand for.

    Spans have one number if and only if their bytes agree: a hash table compares them in full.
    ``inside`` marks the spans' bytes, where the caller knows them."""
    if not len(starts):
        return np.empty(0, np.int64), pa.array([], pa.large_binary())
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    bytes_ = np.ascontiguousarray(data[cover(starts, ends, len(data)) if inside is None else inside])
    column = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(bytes_)])
    coded = column.dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary


def strong_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, inside: np.ndarray | None = None) -> np.ndarray:
    """XXH64 of each span; each distinct span is hashed once."""
    ids, words = exact_ids(data, starts, ends, inside)
    if not len(ids):
        return np.empty(0, U64)
    _, offsets, raw = words.buffers()
    at, raw, digest = np.frombuffer(offsets, np.int64)[: len(words) + 1].tolist(), raw.to_pybytes(), xxhash.xxh64_intdigest
    return np.array([digest(raw[a:b]) for a, b in zip(at, at[1:])], U64)[ids]


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of words[i:i+n] for each i; the caller masks spans that cross documents."""
    if len(words) < n:
        return np.empty(0, U64)
    i = np.arange(len(words) - n + 1)
    return SpanHasher(words, WORD_BASE, WORD_BASE_INV)(i, i + n)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows of strings or binaries, and the rows' offsets (one more than rows).  Null
    rows are empty."""
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.empty(0, np.uint8)
    return raw, at - at[0]


def chunks(batches, text: str = "text", limit: int = CHUNK_BYTES):
    """Yields (rows, bytes, offsets) with whole rows and about ``limit`` bytes of text each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        lo = 0
        while lo < batch.num_rows:
            base = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, base + limit, "right")))
            part = batch.slice(lo, hi - lo)
            yield part, *flat(part.column(text))
            lo = hi


def spans(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each row (and the end) its first word's number."""
    word = ~separators[data]
    if not len(word):
        z = np.empty(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    full = offsets[:-1] < offsets[1:]
    a, b = offsets[:-1][full], offsets[1:][full] - 1
    first[a] = word[a]
    last[b] = word[b]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def rows_of(bounds: np.ndarray) -> np.ndarray:
    """Row number of each word, from the rows' word bounds."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def count_by_row(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of flags[bounds[i]:bounds[i+1]] for each i."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def cover(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """True for each of n places that lies in any [start, end)."""
    steps = np.bincount(starts, minlength=n + 1).astype(np.int64) - np.bincount(ends, minlength=n + 1)
    return np.cumsum(steps[:n]) > 0
