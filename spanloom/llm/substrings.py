"""Substring dedup by level-wise doubling over word windows.

The asked length is halved (rounded up) down to a few words: 13, 7, 4. The first level looks at windows of the shortest length,
sampled so that every asked window holds a sampled window of each length at the same places in each of its occurrences: of its halves the
one of least hash, and so on down. Those that occur in one document only drop out. What is left is extended to about twice
its length and counted again, until the asked length. That settles what goes;
`longest_repeats` doubles further, windows whose two halves both repeat, until no candidate survives. Each level
moves packed hashes only; texts move once (once a level in `longest_repeats`), to the bucket of their key.

A window's last hash has 64 stored bits (40 at the levels before) beside the bits that choose its bucket (a bucket holds some MB at any
input size, so the bucket bits grow with the input).

Defined cases: null and empty texts have no words; null keys count as one document after all others; rows
that share a key never remove each other's words and are told apart by 64-bit hashes of their texts; repeated rows each give a row; other columns are ignored;
empty tables give no rows. Windows never cross documents. A document longer than a slice is taken whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm import packing
from spanloom.llm.arrays import U64, buffers, rows_of, run_hashes, slices, span_hashes, whole, words
from spanloom.llm.runtime import buckets_for, saved, small_batches

LAST = (1 << 63) - 1
#: Windows of so many words are not halved again.
SHORTEST = 4


def levels(width: int) -> list[int]:
    """Window lengths from the shortest up: each the half (rounded up) of the next."""
    out = [width]
    while out[0] > SHORTEST or len(out) < 2:
        out.insert(0, (out[0] + 1) // 2)
    return out


def least_parts(h: np.ndarray, width: int, part: int) -> np.ndarray:
    """For each window of `width` items the start of its part of least hash (leftmost of equals)."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    small = run_hashes(h, part)
    least, at = small[:n].copy(), np.arange(n)
    for j in range(1, width - part + 1):
        better = small[j : n + j] < least
        least[better] = small[j : n + j][better]
        at[better] = np.flatnonzero(better) + j
    return at


def sampled(h: np.ndarray, first: np.ndarray, lengths: list[int], level: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows of lengths[level] that are looked at, and of each one's part of the length before (level 0: themselves).

    Of the longest length these are all windows within a row; of each shorter one the least parts of those of the next.
    """
    starts = np.flatnonzero(whole(first, lengths[-1], len(h)))
    for k in range(len(lengths) - 1, level, -1):
        starts = np.unique(least_parts(h, lengths[k], lengths[k - 1])[starts])
    return starts, least_parts(h, lengths[level], lengths[level - 1])[starts] if level else starts


def keyed_documents(docs: DataFrame, mixed: bool = True) -> DataFrame:
    """k (the key, nulls last), doc_id, text and tag: a 64-bit hash of the text, which tells rows of one key apart; 0 where no key stands on different texts."""
    tag = F.xxhash64(docs["text"]) if mixed else F.lit(0).cast("bigint")
    return docs.select(F.coalesce(docs["doc_id"].cast("bigint"), F.lit(LAST)).alias("k"), docs["doc_id"].alias("doc_id"), docs["text"].alias("text"), tag.alias("tag"))


def measured(docs: DataFrame) -> tuple[int, bool]:
    """Bytes of all texts, and whether some key stands on different texts: only then notes carry tags."""
    small_batches(docs.sparkSession)
    by_key = keyed_documents(docs).groupBy("k").agg(F.sum(F.octet_length("text")).alias("n"), (F.min("tag") != F.max("tag")).alias("mixed"))
    found = by_key.agg(F.sum("n"), F.max("mixed")).first()
    return int(found[0] or 0), bool(found[1])


def at_home(docs: DataFrame, n_homes: int, mixed: bool) -> DataFrame:
    """The same with the bucket in which each document meets its notes: they go by key, so a hot source is no hot bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(packing.home_of(np.asarray(b.column(0)), n_homes)), *b.columns], ["bucket", "k", "doc_id", "text", "tag"])

    return keyed_documents(docs, mixed).mapInArrow(run, f"bucket int, k bigint, doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string, tag bigint")


def repeated(table: pa.Table, n_homes: int, first_too: bool) -> pa.Table:
    """Notes of the windows of one bucket that stand in several documents; those of the smallest key only if asked for."""
    h, keys, spots, tags = packing.unpack(table, 8)
    order, at = packing.groups(h)
    size = np.diff(at, append=len(order))
    least, most = (np.repeat(f.reduceat(keys[order], at), size) for f in (np.minimum, np.maximum))
    found = order[(least < most) if first_too else (keys[order] > least)]
    return packing.sent_home(n_homes, keys[found], tags[found], spots[found])


def removed_windows(docs: DataFrame, homes: DataFrame, n_homes: int, total: int, mixed: bool, width: int, first_too: bool = False) -> DataFrame:
    """Packed notes (key, tag, start in words) of the windows to remove; with first_too of all that repeat."""
    n_buckets, lengths = buckets_for(docs.sparkSession, 3 * total), levels(width)

    def shortest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = packing.Packer(5)
        for b in batches:
            keys, tags = np.asarray(b.column(0)), np.asarray(b.column(3))
            raw, offsets = buffers(b.column(2))
            for i, _, cut, cut_offsets in slices(raw, offsets):
                starts, ends, first = words(cut, cut_offsets)
                h = span_hashes(cut, starts, ends)
                at, _ = sampled(h, first, lengths, 0)
                small = run_hashes(h, lengths[0])[at] if len(at) else np.zeros(0, U64)
                row = np.searchsorted(first, at, "right") - 1
                yield from packer.add(packing.bucket_of(small, n_buckets), small, keys[i + row], at - first[row], tags[i + row])
        yield from packer.flush()

    def in_several(table: pa.Table) -> pa.Table:
        h, keys, spots, tags = packing.unpack(table, 5)
        order, at = packing.groups(h)
        k = keys[order]
        many = np.minimum.reduceat(k, at) < np.maximum.reduceat(k, at)
        kept = order[np.repeat(many, np.diff(at, append=len(k)))]
        return packing.sent_home(n_homes, keys[kept], tags[kept], spots[kept])

    def extended(level: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
        """Windows of a level whose part of the level before is among the notes."""
        last = level == len(lengths) - 1

        def run(texts: pa.Table, notes: pa.Table) -> pa.Table:
            keys, tags = np.asarray(texts.column("k")), np.asarray(texts.column("tag"))
            known, packer, out = packing.Notes(notes), packing.Packer(8 if last else 5), []
            raw, offsets = buffers(texts.column("text"))
            for i, j, cut, cut_offsets in slices(raw, offsets):
                starts, ends, first = words(cut, cut_offsets)
                h = span_hashes(cut, starts, ends)
                window, part = sampled(h, first, lengths, level)
                note, row = known.of(keys[i:j], tags[i:j])
                alive = np.zeros(len(h) + 1, bool)
                alive[known.spots[note] + first[row]] = True
                window = window[alive[part]]
                row = np.searchsorted(first, window, "right") - 1
                full, other = (run_hashes(h, lengths[level], f)[window] if len(window) else np.zeros(0, U64) for f in (0, 1))
                out += packer.add(packing.bucket_of(other if last else full, n_buckets), full, keys[i + row], window - first[row], tags[i + row])
            return pa.Table.from_batches([*out, *packer.flush()], packing.ARROW)

        return run

    found = keyed_documents(docs, mixed).mapInArrow(shortest, packing.SCHEMA)
    for level in range(1, len(lengths)):
        known = found.groupBy("bucket").applyInArrow(in_several, packing.SCHEMA)
        found = homes.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(extended(level), packing.SCHEMA)
    return found.groupBy("bucket").applyInArrow(lambda table: repeated(table, n_homes, first_too), packing.SCHEMA)


def without_repeats(docs: DataFrame, width: int = 13) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words left, joined by one space) per row.

    A word goes if a window of `width` words that covers it also starts in a document with a smaller key.
    """
    total, mixed = measured(docs)
    n_homes = buckets_for(docs.sparkSession, total)
    homes = at_home(docs, n_homes, mixed)
    gone = removed_windows(docs, homes, n_homes, total, mixed, width)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def apply(texts: pa.Table, notes: pa.Table) -> pa.Table:
        keys, tags, ids = np.asarray(texts.column("k")), np.asarray(texts.column("tag")), texts.column("doc_id").combine_chunks()
        known, out = packing.Notes(notes), []
        raw, offsets = buffers(texts.column("text"))
        for i, j, cut, cut_offsets in slices(raw, offsets):
            starts, ends, first = words(cut, cut_offsets)
            note, row = known.of(keys[i:j], tags[i:j])
            at = known.spots[note] + first[row]
            n = len(starts) + 1
            change = np.bincount(at, minlength=n) - np.bincount(np.minimum(at + width, n - 1), minlength=n)
            lost = np.cumsum(change[:-1]) > 0
            upto = np.concatenate([[0], np.cumsum(~lost)])[first]
            out.append(pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(np.diff(first)), pa.array(np.bincount(rows_of(first)[lost], minlength=j - i)), kept_texts(cut, starts[~lost], ends[~lost], upto)], ["doc_id", "n_words", "n_removed", "kept"]))
        return pa.Table.from_batches(out, pa.schema([("doc_id", ids.type), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())]))

    return homes.groupBy("bucket").cogroup(gone.groupBy("bucket")).applyInArrow(apply, f"doc_id {kind}, n_words bigint, n_removed bigint, kept string")


def longest_repeats(docs: DataFrame, width: int = 13) -> DataFrame:
    """k (the key, nulls last) and words: the longest of width, 2 width, 4 width, ... at which a window of the document also
    stands in another one. Documents without a repeat have no row."""
    total, mixed = measured(docs)
    n_homes = buckets_for(docs.sparkSession, total)
    homes = at_home(docs, n_homes, mixed)
    found, out = saved(removed_windows(docs, homes, n_homes, total, mixed, width, first_too=True)), None

    def doubled_at(half: int):
        def run(texts: pa.Table, notes: pa.Table) -> pa.Table:
            keys, tags = np.asarray(texts.column("k")), np.asarray(texts.column("tag"))
            known, packer, batches = packing.Notes(notes), packing.Packer(8), []
            raw, offsets = buffers(texts.column("text"))
            for i, j, cut, cut_offsets in slices(raw, offsets):
                starts, ends, first = words(cut, cut_offsets)
                h = span_hashes(cut, starts, ends)
                note, row = known.of(keys[i:j], tags[i:j])
                alive = np.zeros(len(h) + half + 1, bool)
                alive[known.spots[note] + first[row]] = True
                at = np.flatnonzero(alive[: len(h)] & alive[half : len(h) + half])
                row = np.searchsorted(first, at, "right") - 1
                inside = at + 2 * half <= first[row + 1]
                at, row = at[inside], row[inside]
                full, other = (run_hashes(h, 2 * half, f)[at] if len(at) else np.zeros(0, U64) for f in (0, 1))
                batches += packer.add(packing.bucket_of(other, n_homes), full, keys[i + row], at - first[row], tags[i + row])
            return pa.Table.from_batches([*batches, *packer.flush()], packing.ARROW)

        return run

    def keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for keys, n in zip(b.column("keys").to_pylist(), b.column("n").to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(packing.unpack_ints(keys, n)))], ["k"])

    while True:
        level = found.mapInArrow(keys_of, "k bigint").distinct().withColumn("words", F.lit(width))
        out = level if out is None else out.unionByName(level)
        if found.limit(1).count() == 0:
            return out.groupBy("k").agg(F.max("words").alias("words"))
        pairs = homes.groupBy("bucket").cogroup(found.groupBy("bucket")).applyInArrow(doubled_at(width), packing.SCHEMA)
        found, width = saved(pairs.groupBy("bucket").applyInArrow(lambda table: repeated(table, n_homes, True), packing.SCHEMA)), 2 * width


def kept_texts(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> pa.StringArray:
    """The given words of each row, joined by one space."""
    size = ends - starts + 1
    upto = np.concatenate([[0], np.cumsum(size)])
    out = np.append(raw, np.uint8(0x20))[np.repeat(starts - upto[:-1], size) + np.arange(upto[-1])] if len(starts) else np.zeros(0, np.uint8)
    out[upto[1:] - 1] = 0x20
    offsets = upto[first]
    has = np.diff(first) > 0
    keep = np.ones(len(out), bool)
    keep[offsets[1:][has] - 1] = False  # no space after a row's last word
    offsets = offsets - np.concatenate([[0], np.cumsum(has)])
    return pa.StringArray.from_buffers(len(first) - 1, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(out[keep].tobytes()))
