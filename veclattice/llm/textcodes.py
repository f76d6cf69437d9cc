"""Vectorised word codes over Arrow string columns.

A word is a maximal run of characters other than U+0020 and U+0009..U+000D.
All of those are single bytes in UTF-8, so words are found on the raw bytes
of the Arrow buffer and hashed with polynomial prefix sums modulo 2**64; no
Python string is ever made.  Two different bases give a 128-bit code where a
collision must be practically impossible.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Odd multipliers of the two polynomial codes.
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
CHUNK_BYTES = 1_000_000

_WHITE = np.zeros(256, dtype=bool)
_WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_rng = np.random.default_rng(20240229)
_BYTE_CODE = _rng.integers(1, 2**63, size=256, dtype=np.int64).astype(U64)
_LOWER_CODE = _BYTE_CODE.copy()
_LOWER_CODE[0x41:0x5B] = _BYTE_CODE[0x61:0x7B]
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of a base and of its inverse modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have[0]) <= n:
        size = max(n + 1, 1 << 16)
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, dtype=U64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        have = _powers[base] = (both[0], both[1])
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser; spreads every input bit over all output bits."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


class Words(NamedTuple):
    """Words of a run of documents: word k of document d is first[d] + k."""

    data: np.ndarray  # the bytes
    begin: np.ndarray  # byte where a word begins
    end: np.ndarray  # byte after it
    first: np.ndarray  # first word of each document, and the total at the end
    code: np.ndarray  # 64-bit code of each word

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes, or of one row where that is longer."""
    offsets = _offsets(texts)
    n, i = len(texts), 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


def plain(texts: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One large_string array; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    return texts.cast(pa.large_string()).fill_null("")


def _offsets(texts: pa.Array) -> np.ndarray:
    raw = np.frombuffer(texts.buffers()[1], dtype=np.int64)
    return raw[texts.offset : texts.offset + len(texts) + 1]


def words(texts: pa.Array, i: int = 0, j: int | None = None, lower: bool = False) -> Words:
    """The words of rows i..j of a `plain` array; lower folds A-Z only."""
    j = len(texts) if j is None else j
    offsets = _offsets(texts)[i : j + 1]
    lo, hi = int(offsets[0]), int(offsets[-1])
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8)[lo:hi] if buffer is not None and hi > lo else np.zeros(0, dtype=np.uint8)
    edges = offsets - lo
    if not len(data):
        none = np.zeros(0, dtype=np.int64)
        return Words(data, none, none, np.zeros(j - i + 1, dtype=np.int64), np.zeros(0, dtype=U64))
    white = _WHITE[data]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[edges] = True
    begin = ~white
    begin[1:] &= white[:-1] | cut[1:-1]
    end = ~white
    end[:-1] &= white[1:] | cut[1:-1]
    begin, end = np.flatnonzero(begin), np.flatnonzero(end) + 1
    first = np.searchsorted(begin, edges)
    table = _LOWER_CODE if lower else _BYTE_CODE
    code = spans(table[data], begin, end, BASES[0])
    return Words(data, begin, end, first, code)


def byte_codes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Code of each data[begin:end], as `words` gives it."""
    return spans(_BYTE_CODE[data], begin, end, BASES[0])


def spans(values: np.ndarray, begin: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Code of each values[begin:end], the same wherever it stands."""
    up, down = powers(base, len(values))
    sums = np.zeros(len(values) + 1, dtype=U64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(U64))


def windows(w: Words, size: int, base: int = BASES[0]) -> tuple[np.ndarray, np.ndarray]:
    """Start word and code of every window of `size` words inside one document."""
    n = len(w.code)
    if n < size:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=U64)
    last = np.repeat(w.first[1:], np.diff(w.first))  # end of each word's document
    start = np.flatnonzero(np.arange(n) + size <= last)
    return start, spans(w.code, start, start + size, base)


def release() -> None:
    """Gives freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def tidied(run: Callable) -> Callable:
    """A batch function that gives freed memory back to the system when its task ends.

    Python workers are reused: what one task frees would else stay with its
    idle worker, beside the heap of later stages.
    """

    @functools.wraps(run)
    def tidy(*args, **kwargs):
        try:
            yield from run(*args, **kwargs)
        finally:
            release()

    return tidy
