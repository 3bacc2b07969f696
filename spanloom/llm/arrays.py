"""Vectorised text primitives over Arrow buffers: words, hashes and word windows.

Everything works on slices of a few MB of text, so memory does not follow the batch size. Null
texts count as empty. Hash families are keyed by an integer; two families together give 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: The same and ASCII punctuation.
PUNCTUATION = SPACES | np.array([chr(b) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
SLICE_BYTES = 1 << 19

_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_TABLES: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection that spreads every input bit."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """n pseudo-random 64-bit words that depend on the seed alone."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=U64) + U64(seed * 0x10001 + 7)) * U64(0x9E3779B97F4A7C15))


def powers(family: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd multiplier and of its inverse modulo 2**64."""
    have = _POWERS.get(family)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        base = int(stream(1000 + family, 1)[0]) | 5
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            a = np.full(size, b, U64)
            a[0] = 1
            out.append(np.cumprod(a, dtype=U64))
        have = _POWERS[family] = (out[0], out[1])
    return have[0][:n], have[1][:n]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's bytes and the n + 1 offsets of its rows; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(raw: np.ndarray, offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows (first, end, bytes, offsets) with about `limit` bytes; one longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j
    pa.default_memory_pool().release_unused()


def words(raw: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words, and for each row (and the end) the index of its first word."""
    if not len(raw):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    blank = separators[raw]
    edge = np.empty(len(raw) + 1, bool)
    edge[0] = edge[-1] = True
    edge[1:-1] = blank[:-1]
    edge[offsets] = True
    inside = ~blank
    starts = np.flatnonzero(inside & edge[:-1])
    edge[:-1] = blank
    edge[offsets] = True
    ends = np.flatnonzero(inside & edge[1:]) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, family: int = 0) -> np.ndarray:
    """64-bit hashes of byte spans, alike wherever the same bytes stand."""
    table = _TABLES.get(family)
    if table is None:
        table = _TABLES[family] = stream(family, 256)
    up, down = powers(family, len(raw) + 1)
    total = np.zeros(len(raw) + 1, U64)
    np.cumsum(table[raw] * up[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def run_hashes(items: np.ndarray, width: int, family: int = 0) -> np.ndarray:
    """Hashes of every run of `width` consecutive items (over row ends too: mask those with `whole`)."""
    n = len(items) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    up, down = powers(family + 100, len(items) + 1)
    total = np.zeros(len(items) + 1, U64)
    np.cumsum(items * up[:-1], out=total[1:])
    return mix((total[width:] - total[:n]) * down[:n] + U64(width))


def whole(first: np.ndarray, width: int, total: int) -> np.ndarray:
    """Which of the total - width + 1 runs of items lie within one row."""
    n = total - width + 1
    ok = np.ones(max(n, 0), bool)
    for e in np.unique(first[1:-1]):
        ok[max(0, e - width + 1) : e] = False
    return ok


def rows_of(first: np.ndarray) -> np.ndarray:
    """The row of each item, from the index of each row's first item."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))
