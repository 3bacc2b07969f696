"""Suffix-array dedup of long byte strings by linear grouping.

Every string of `length` bytes holds a block that hashes lowest among its blocks of `block` bytes; equal strings
hold it at the same place. Strings are gathered by that block, their anchor, so only those that can be equal
meet, and the block itself becomes one symbol. An anchor's neighbourhood (all strings that chose it, without the
block) then has about a hundred symbols. Equal neighbourhoods collapse into one counted copy; where several
different ones share a block, their suffixes are sorted by linear grouping (suffix_groups), and neighbours in the
order that agree over a whole string are repeats.

A block that very many different neighbourhoods share is dealt out over parts of bounded size; each part sorts
its own suffixes and passes on one entry per different string, and those meet by hash. Texts move once, to
the bucket of their document; everything else moves packed.

Defined cases: null and empty texts have 0 bytes; texts shorter than `length` lose nothing; rows may share a key
or be equal (the strings of an equal row count as elsewhere); null keys are allowed; other columns are
ignored; empty tables give no rows. Strings never cross documents. Any length of text is taken whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm import packing
from spanloom.llm.arrays import U64, buffers, mix, powers, slices, span_hashes, stream
from spanloom.llm.runtime import buckets_for, saved
from spanloom.llm.substrings import at_home, keyed_documents, measured
from spanloom.llm.suffix_groups import suffix_array

SLICE = 1 << 19
#: Different neighbourhoods of one block that are sorted together at most.
PART = 2000
#: Stage-1 notes: an anchor whose strings all repeat, or one whose neighbourhood is to be sent (times parts).
WHOLE, SEND, SEND_COUNTED = 0, 1, 2


def block_hashes(raw: np.ndarray, width: int, family: int = 50) -> np.ndarray:
    """Hashes of every run of `width` bytes."""
    n = len(raw) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    up, down = powers(family, len(raw) + 1)
    total = np.zeros(len(raw) + 1, U64)
    np.cumsum(stream(family, 256)[raw] * up[:-1], out=total[1:])
    return mix((total[width:] - total[:n]) * down[:n] + U64(width))


class Anchors:
    """The strings of a slice by anchor: for each anchor (in order) its place, its first and last string's start, its row and its block's hash."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, length: int, block: int):
        self.at = self.low = self.high = self.row = np.zeros(0, np.int64)
        self.hash = np.zeros(0, U64)
        choices, n = length - block + 1, len(raw) - length + 1
        sizes = np.diff(offsets)
        if n <= 0 or (sizes < length).all():
            return
        h = block_hashes(raw, block)
        least = (h & U64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=U64)  # of equal hashes the leftmost
        step = 1
        while 2 * step <= choices:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        if step < choices:
            least = np.minimum(least[: len(least) - (choices - step)], least[choices - step :])
        inside = np.arange(n) + length <= np.repeat(offsets[1:], sizes)[:n]
        start = np.flatnonzero(inside)
        chosen = (least[start] & U64(0xFFFFFFFF)).astype(np.int64)
        new = np.ones(len(start), bool)
        new[1:] = chosen[1:] != chosen[:-1]
        at = np.flatnonzero(new)
        self.at, self.low, self.high = chosen[at], start[at], start[np.append(at[1:], len(start)) - 1]
        self.row = np.searchsorted(offsets, self.at, "right") - 1
        self.hash = h[self.at]


def same_strings(texts: list[tuple[bytes, bytes]], block_gap: int, counted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which strings of the neighbourhoods (bytes left of the block, bytes right of it) occur in more than one of them or in a counted one.

    A string starts d bytes left of the block and ends block_gap - d bytes right of it. Returns neighbourhood, d and
    a class number (equal for equal strings) of every string, in suffix order; those alone in their class do not repeat.
    """
    symbols: list[int] = []
    owner, left_of = [], []
    for k, (left, right) in enumerate(texts):
        symbols += left
        symbols.append(256)
        symbols += right
        symbols.append(-1)
        n = len(left) + len(right) + 2
        owner += [k] * n
        left_of += range(len(left), len(left) - n, -1)
    owner, left_of = np.array(owner), np.array(left_of)
    size = block_gap + 1
    room = np.array([len(r) for _, r in texts])[owner]
    starts = (left_of >= 0) & (block_gap - left_of <= room) & (left_of <= block_gap)
    order = np.array(suffix_array(symbols))
    order = order[starts[order]]
    if len(order) < 2:
        return owner[order], left_of[order], np.zeros(len(order), np.int64)
    flat = np.array(symbols + [-2] * size, np.int16)
    same = np.ones(len(order) - 1, bool)
    for i in range(0, len(order) - 1, 1 << 14):
        a, b = order[i : i + (1 << 14)], order[i + 1 : i + 1 + (1 << 14)]
        a = a[: len(b)]
        span = np.arange(size)
        same[i : i + len(b)] = (flat[a[:, None] + span] == flat[b[:, None] + span]).all(axis=1)
    return owner[order], left_of[order], np.concatenate([[0], np.cumsum(~same)])


def without_repeats(docs: DataFrame, length: int = 200, block: int = 137) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (binary: the bytes left) per row.

    A byte goes if a string of `length` bytes that covers it also starts anywhere else.
    """
    spark = docs.sparkSession
    total, mixed = measured(docs)
    n_homes, n_buckets = buckets_for(spark, total), buckets_for(spark, total)
    gap = length - block  # bytes of a string outside its block
    homes = at_home(docs, n_homes, mixed)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # two entries' worth of hash: the block's in the hash column, the neighbourhood's in a column of its own
        for b in batches:
            keys, tags = np.asarray(b.column(0)), np.asarray(b.column(3))
            raw, offsets = buffers(b.column(2))
            held: list[tuple[np.ndarray, ...]] = []
            for i, _, cut, cut_offsets in slices(raw, offsets, SLICE):
                a = Anchors(cut, cut_offsets, length, block)
                if len(a.at):
                    around = mix(span_hashes(cut, a.low, a.high + length, 51) + (a.at - a.low).astype(U64))
                    held.append((packing.bucket_of(mix(a.hash), n_buckets), a.hash, keys[i + a.row], a.at - cut_offsets[a.row], tags[i + a.row], around))
            if held:
                bucket, h, key, spot, tag, around = (np.concatenate(x) for x in zip(*held, strict=True))
                order = np.argsort(bucket, kind="stable")
                packed = packing.pack(bucket, h, 8, key, spot, tag)
                cuts = np.cumsum(np.asarray(packed.column(1)))
                pieces = np.split(around[order], cuts[:-1])
                yield pa.RecordBatch.from_arrays([*packed.columns, pa.array([packing.pack_hashes(x, 8) for x in pieces], pa.binary())], [*packing.NAMES, "around"])

    def classes(table: pa.Table) -> pa.Table:
        h, keys, spots, tags = packing.unpack(table, 8)
        around = np.concatenate([packing.unpack_hashes(x, len(x) // 8, 8) for x in table.column("around").to_pylist()])
        order = np.lexsort((spots, tags, keys, around, h))
        h, keys, spots, tags, around = h[order], keys[order], spots[order], tags[order], around[order]
        new_block = np.append(True, h[1:] != h[:-1])
        new_copy = new_block | np.append(True, around[1:] != around[:-1])
        copy_at = np.flatnonzero(new_copy)
        copies = np.diff(copy_at, append=len(h))
        block_of_copy = (np.cumsum(new_block) - 1)[copy_at]
        different = np.bincount(block_of_copy)[block_of_copy]
        note = np.full(len(h), -1)
        note[np.repeat(copies > 1, copies)] = WHOLE
        parts = -(-different // PART)
        sent = different > 1
        kind_of = np.where(copies > 1, SEND_COUNTED, SEND)
        say = np.concatenate([np.flatnonzero(note == WHOLE), copy_at[sent]])
        code = np.concatenate([np.zeros((note == WHOLE).sum(), np.int64), (kind_of + 4 * parts)[sent]])
        return packing.sent_home(n_homes, keys[say], tags[say], spots[say], code.astype(U64))

    sent_names = ["bucket", "n", "hashes", "keys", "spots", "tags", "counted", "lefts", "rights", "texts"]
    sent_schema = pa.schema([*packing.ARROW, ("counted", pa.binary()), ("lefts", pa.binary()), ("rights", pa.binary()), ("texts", pa.binary())])

    def neighbourhoods(texts: pa.Table, notes: pa.Table) -> pa.Table:
        keys, tags = np.asarray(texts.column("k")), np.asarray(texts.column("tag"))
        known, out = packing.Notes(notes, 8), []
        raw, offsets = buffers(texts.column("text"))
        rows: dict[int, list[tuple]] = {}
        for i, j, cut, cut_offsets in slices(raw, offsets, SLICE):
            note, row = known.of(keys[i:j], tags[i:j])
            send = known.hashes[note] != WHOLE
            note, row = note[send], row[send]
            if not len(note):
                continue
            a = Anchors(cut, cut_offsets, length, block)
            spot = known.spots[note] + cut_offsets[row]
            which = np.minimum(np.searchsorted(a.at, spot), len(a.at) - 1)
            fine = a.at[which] == spot
            which, note = which[fine], note[fine]
            code = known.hashes[note].astype(np.int64)
            parts = code // 4
            part = packing.bucket_of(mix(known.keys[note].view(U64) + (known.spots[note].astype(U64) << U64(20))), 1 << 20).astype(np.int64) % parts
            many = np.where(parts > 1, part + 1, 0)
            bucket = packing.bucket_of(mix(a.hash[which] + many.astype(U64) * U64(0x9E3779B97F4A7C15)), n_buckets)
            whole = cut.tobytes()
            for x, b, m, c, n in zip(which.tolist(), bucket.tolist(), many.tolist(), code.tolist(), note.tolist(), strict=True):
                at, low, high = int(a.at[x]), int(a.low[x]), int(a.high[x])
                rows.setdefault(b, []).append((a.hash[x], known.keys[n], known.spots[n], known.tags[n], (c % 4 == SEND_COUNTED) + 2 * m, at - low, high + length - at - block, whole[low:at] + whole[at + block : high + length]))
        for b, found in sorted(rows.items()):
            h, k, s, t, c, left, right, text = zip(*found, strict=True)
            ints = [pa.array([packing.pack_ints(np.array(x, np.int64))], pa.binary()) for x in (k, s, t, c, left, right)]
            out.append(pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([len(h)], pa.int32()), pa.array([packing.pack_hashes(np.array(h, U64), 8)], pa.binary()), *ints, pa.array([b"".join(text)], pa.binary())], sent_names))
        return pa.Table.from_batches(out, sent_schema)

    def sort_suffixes(table: pa.Table) -> pa.Table:
        h, keys, spots, tags = packing.unpack(table, 8)
        more = [np.concatenate([packing.unpack_ints(x, n) for x, n in zip(table.column(c).to_pylist(), table.column("n").to_pylist(), strict=True)]) for c in ("counted", "lefts", "rights")]
        counted, left, right = more
        text = b"".join(table.column("texts").to_pylist())
        begin = np.concatenate([[0], np.cumsum(left + right)])
        many = counted // 2
        order = np.lexsort((spots, tags, keys, many, h))
        cut = np.flatnonzero(np.append(True, (h[order][1:] != h[order][:-1]) | (many[order][1:] != many[order][:-1])))
        hits: list[tuple[np.ndarray, np.ndarray]] = []
        open_strings: list[tuple[np.ndarray, ...]] = []
        for a, b in zip(cut, np.append(cut[1:], len(order)), strict=True):
            mine = order[a:b]
            split = many[mine[0]] > 0
            if len(mine) < 2 and not split:
                continue
            pieces = [(text[begin[x] : begin[x] + left[x]], text[begin[x] + left[x] : begin[x + 1]]) for x in mine.tolist()]
            owner, d, number = same_strings(pieces, gap, counted[mine] % 2)
            copies = np.bincount(number, minlength=1)
            repeated = copies[number] > 1
            unsure = counted[mine][owner] % 2 == 0
            hits.append((mine[owner[repeated & unsure]], d[repeated & unsure]))
            if split:  # one entry for each different string, that of a neighbourhood which still asks if there is one
                first = np.lexsort((repeated | ~unsure, number))
                first = first[np.append(True, number[first][1:] != number[first][:-1])]
                joined = np.frombuffer(b"".join(l[len(l) - e :] + r[: gap - e] for (l, r), e in ((pieces[o], e) for o, e in zip(owner[first].tolist(), d[first].tolist(), strict=True))), np.uint8)
                ends = np.arange(1, len(first) + 1) * gap
                hash_of = mix(span_hashes(joined, ends - gap, ends, 52) + h[mine[0]] + d[first].astype(U64) * U64(0xC2B2AE3D27D4EB4F))
                asks = (unsure & ~repeated)[first]
                open_strings.append((hash_of, mine[owner[first]], np.where(asks, d[first], -1)))
        who, d = (np.concatenate(x) for x in zip(*hits, strict=True)) if hits else (np.zeros(0, np.int64),) * 2
        home = packing.sent_home(n_homes, keys[who], tags[who], spots[who] - d, np.zeros(len(who), U64))
        rows = home.append_column("meet", pa.array([False] * home.num_rows, pa.bool_()))
        if open_strings:
            hash_of, who, d = (np.concatenate(x) for x in zip(*open_strings, strict=True))
            asks = d >= 0
            batch = packing.pack(packing.bucket_of(mix(hash_of), n_buckets), hash_of, 8, np.where(asks, keys[who], -1), np.where(asks, spots[who] - d, -1), np.where(asks, tags[who], 0))
            extra = pa.Table.from_batches([batch])
            rows = pa.concat_tables([rows, extra.append_column("meet", pa.array([True] * extra.num_rows, pa.bool_()))])
        return rows

    def meet(table: pa.Table) -> pa.Table:
        h, keys, spots, tags = packing.unpack(table, 8)
        order, at = packing.groups(h)
        copies = np.diff(at, append=len(h))
        found = order[np.repeat(copies > 1, copies)]
        found = found[spots[found] >= 0]
        return packing.sent_home(n_homes, keys[found], tags[found], spots[found], np.zeros(len(found), U64))

    def apply(texts: pa.Table, notes: pa.Table) -> pa.Table:
        keys, tags, ids = np.asarray(texts.column("k")), np.asarray(texts.column("tag")), texts.column("doc_id").combine_chunks()
        whole = np.asarray(notes.column("whole"), bool) if notes.num_rows else np.zeros(0, bool)
        known = packing.Notes(notes.filter(pa.array(whole)).select(packing.NAMES), 8)
        single = packing.Notes(notes.filter(pa.array(~whole)).select(packing.NAMES), 8)
        out = []
        raw, offsets = buffers(texts.column("text"))
        for i, j, cut, cut_offsets in slices(raw, offsets, SLICE):
            change = np.zeros(len(cut) + 1, np.int64)
            note, row = known.of(keys[i:j], tags[i:j])
            pick = known.hashes[note] == WHOLE
            if pick.any():
                a = Anchors(cut, cut_offsets, length, block)
                which = np.searchsorted(a.at, known.spots[note[pick]] + cut_offsets[row[pick]])
                np.add.at(change, a.low[which], 1)
                np.add.at(change, a.high[which] + length, -1)
            note, row = single.of(keys[i:j], tags[i:j])
            if len(note):
                at = single.spots[note] + cut_offsets[row]
                change += np.bincount(at, minlength=len(change)) - np.bincount(at + length, minlength=len(change))
            lost = np.cumsum(change[:-1]) > 0
            gone = np.concatenate([[0], np.cumsum(lost)])[cut_offsets]
            run = lost.copy()
            run[1:] &= ~lost[:-1]
            inner = cut_offsets[1:-1]
            inner = inner[inner < len(lost)]
            run[inner] |= lost[inner]
            runs = np.concatenate([[0], np.cumsum(run)])[cut_offsets]
            kept_offsets = cut_offsets - gone
            kept = pa.BinaryArray.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(kept_offsets.astype(np.int32).tobytes()), pa.py_buffer(cut[~lost].tobytes())])
            out.append(pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(np.diff(cut_offsets)), pa.array(np.diff(gone)), pa.array(np.diff(runs)), kept], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]))
        return pa.Table.from_batches(out, pa.schema([("doc_id", ids.type), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())]))

    first = keyed_documents(docs, mixed).mapInArrow(anchors, packing.SCHEMA + ", around binary")
    noted = saved(first.groupBy("bucket").applyInArrow(classes, packing.SCHEMA))
    sent = homes.groupBy("bucket").cogroup(noted.groupBy("bucket")).applyInArrow(neighbourhoods, packing.SCHEMA + ", counted binary, lefts binary, rights binary, texts binary")
    ordered = saved(sent.groupBy("bucket").applyInArrow(sort_suffixes, packing.SCHEMA + ", meet boolean"))
    met = ordered.where("meet").drop("meet").groupBy("bucket").applyInArrow(meet, packing.SCHEMA)
    notes = noted.withColumn("whole", F.lit(True)).unionByName(ordered.where("NOT meet").drop("meet").unionByName(met).withColumn("whole", F.lit(False)))
    return homes.groupBy("bucket").cogroup(notes.groupBy("bucket")).applyInArrow(apply, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
