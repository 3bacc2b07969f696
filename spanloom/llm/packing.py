"""Packed exchange: many small (hash, key, position) entries travel as a few binary columns per bucket.

An entry costs its hash bytes plus, as a rule, one to three bytes for key and position, where a row would
cost over thirty. Buckets are drawn from hash bits that are not stored, so they add to the hash's width.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from spanloom.llm.arrays import U64, mix

#: Columns of a packed batch: bucket, number of entries, hashes, and delta-coded keys, positions and tags.
SCHEMA = "bucket int, n int, hashes binary, keys binary, spots binary, tags binary"
ARROW = pa.schema([("bucket", pa.int32()), ("n", pa.int32()), *((c, pa.binary()) for c in ("hashes", "keys", "spots", "tags"))])
NAMES = ["bucket", "n", "hashes", "keys", "spots", "tags"]


def pack_ints(a: np.ndarray) -> bytes:
    """Differences, byte planes, zstd: short for sorted or repeating integers."""
    planes = np.ascontiguousarray(np.diff(a.astype(np.int64), prepend=np.int64(0)).view(np.uint8).reshape(-1, 8).T)
    return pa.compress(planes.tobytes(), "zstd", asbytes=True)


def unpack_ints(b: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(b, 8 * n, "zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.int64).ravel())


def pack_plain(a: np.ndarray) -> bytes:
    """Byte planes, zstd, without differences: short for small integers in no order."""
    return pa.compress(np.ascontiguousarray(a.astype(np.int64).view(np.uint8).reshape(-1, 8).T).tobytes(), "zstd", asbytes=True)


def unpack_plain(b: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(b, 8 * n, "zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view(np.int64).ravel()


def pack_runs(a: np.ndarray, first: np.ndarray) -> bytes:
    """Integers that ascend in runs, each of which begins at one of first: as differences within a run, so none is negative."""
    steps = np.diff(a, prepend=np.int64(0))
    steps[first] = a[first]
    return pack_plain(steps)


def unpack_runs(b: bytes, first: np.ndarray, n: int) -> np.ndarray:
    steps = unpack_plain(b, n)
    sums = np.cumsum(steps)
    return sums - np.repeat(sums[first] - steps[first], np.diff(first, append=n))


def pack_hashes(h: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpack_hashes(b: bytes, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    if width:
        out[:, :width] = np.frombuffer(b, np.uint8).reshape(n, width)
    return out.view("<u8").ravel()


def pack(bucket: np.ndarray, hashes: np.ndarray, width: int, keys: np.ndarray, spots: np.ndarray, tags: np.ndarray | None = None) -> pa.RecordBatch | None:
    """One row for each bucket that has entries; inside it entries keep their order."""
    if not len(bucket):
        return None
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    at = np.flatnonzero(np.diff(bucket, prepend=-1))
    ends = np.append(at[1:], len(bucket))
    hashes, keys, spots = hashes[order], keys[order], spots[order]
    tags = tags[order] if tags is not None else np.zeros(len(bucket), np.int64)
    cut = [slice(a, b) for a, b in zip(at, ends, strict=True)]
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket[at], pa.int32()), pa.array(ends - at, pa.int32()), pa.array([pack_hashes(hashes[c], width) for c in cut], pa.binary()), *(pa.array([pack_ints(x[c]) for c in cut], pa.binary()) for x in (keys, spots, tags))],
        NAMES,
    )


def unpack(table: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """hashes, keys, positions, tags of one bucket."""
    out: tuple[list, ...] = ([], [], [], [])
    for n, *parts in zip(*(table.column(c).to_pylist() for c in NAMES[1:]), strict=True):
        out[0].append(unpack_hashes(parts[0], n, width))
        for kind, part in zip(out[1:], parts[1:], strict=True):
            kind.append(unpack_ints(part, n))
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)


class Packer:
    """Gathers entries over slices and packs them a limited number at a time."""

    def __init__(self, width: int, most: int = 1 << 20):
        self.width, self.most, self.held, self.n = width, most, [], 0

    def add(self, *entries: np.ndarray) -> Iterator[pa.RecordBatch]:
        """bucket, hashes, keys, positions, tags."""
        self.held.append(entries)
        self.n += len(entries[0])
        if self.n >= self.most:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.n:
            bucket, hashes, keys, spots, tags = (np.concatenate(x) for x in zip(*self.held, strict=True))
            yield pack(bucket, hashes, self.width, keys, spots, tags)
        self.held, self.n = [], 0


def bucket_of(hashes: np.ndarray, n: int) -> np.ndarray:
    return ((hashes >> U64(33)) % U64(n)).astype(np.int32)


def home_of(keys: np.ndarray, n: int) -> np.ndarray:
    """The bucket in which a document's text and all that is said of it meet."""
    with np.errstate(over="ignore"):
        return bucket_of(mix(keys.astype(np.int64).view(U64) + U64(0x9E3779B97F4A7C15)), n)


def groups(order_by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A sorting order, and where each run of equal values starts in it."""
    order = np.argsort(order_by, kind="stable")
    ordered = order_by[order]
    new = np.ones(len(ordered), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    return order, np.flatnonzero(new)


def sent_home(n: int, keys: np.ndarray, tags: np.ndarray, spots: np.ndarray, hashes: np.ndarray | None = None) -> pa.Table:
    """Entries as a table of packed rows for the documents' buckets, sorted by key, tag and position."""
    order = np.lexsort((spots, tags, keys))
    keys = keys[order]
    batch = pack(home_of(keys, n), hashes[order] if hashes is not None else np.zeros(len(keys), U64), 8 if hashes is not None else 0, keys, spots[order], tags[order])
    return pa.Table.from_batches([batch] if batch is not None else [], ARROW)


class Notes:
    """What came home to one bucket, by document."""

    def __init__(self, table: pa.Table, width: int = 0):
        hashes, keys, spots, tags = unpack(table, width)
        order = np.lexsort((spots, tags, keys))
        self.keys, self.spots, self.tags = keys[order], spots[order], tags[order]
        self.hashes = hashes[order] if width else hashes

    def of(self, keys: np.ndarray, tags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the notes for the given rows, and to which row each belongs."""
        lo, hi = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        row = np.repeat(np.arange(len(keys)), hi - lo)
        at = np.arange(len(row)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)
        same = self.tags[at] == tags[row]
        return at[same], row[same]
