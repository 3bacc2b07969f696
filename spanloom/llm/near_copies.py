"""Near copies of documents: every pair whose sets of word shingles have a Jaccard similarity of 0.8 or more.

A document is the set of 64-bit hashes of its `width`-word shingles (A-Z lower-cased). Equal sets count once.

1. SimHash (simhash.py): fingerprints of the shingles, segment popcounts as places in a grid, a range join of the grid's
   cells under Manhattan distance, the exact distance of `bits` bits. Sets of one fingerprint, and of fingerprints that are
   linked so, are candidates. But at Jaccard 0.8 fingerprints differ in 10 bits and more, so this reaches only the nearest.
2. An exact way for the rest: shingles are ordered by rarity (how many stand in their hash's bucket of 2^16), rarest
   first. Two sets of similarity t or more share a shingle within their first n - ceil(t n) + 1 (prefix filter); their sizes
   differ by a factor t at most; and their first common shingle leaves room for the overlap that t asks for. No pair is
   lost by these. Every set is held against the least set of each shared prefix shingle.
3. Candidates of both are verified, first by sketches, then on whole sets. A sketch has at least a bit for each shingle of
   its set, and each shingle flips one; two sketches, folded to one length, differ in no more bits than the sets in
   shingles. So no pair is lost, and few but the similar have their whole sets travel. Components of the links are contracted,
   and only sets of different components that share a prefix shingle are then paired and verified. So a dense group costs
   about its size.

Defined cases: null and empty texts have the empty set and are equal; a text with fewer words than a shingle is one
shingle; a null doc_id is not its component's name unless all are null; other columns are ignored; an empty table
gives no rows. Sets are named by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm import packing
from spanloom.llm.arrays import LOWER, U64, buffers, mix, rows_of, run_hashes, slices, span_hashes, whole, words
from spanloom.llm.components import components
from spanloom.llm.runtime import annotated, buckets_for, fresh, let_go, saved, small_batches, text_bytes
from spanloom.llm.simhash import fingerprints_of, links as print_links

#: Counts of shingles by the first 16 bits of their hash travel in so many parts.
PARTS = 64
#: Which sets are wanted for verification is told by a bit table of fixed size first, then by a join.
BITS = 1 << 24
LOW = U64((1 << 48) - 1)
DEALT = pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in ("token", "sid", "n", "spot"))])
KINDS = {"token": np.int64, "sid": np.int64, "n": np.int32, "spot": np.int32}


def shingles_of(raw: np.ndarray, offsets: np.ndarray, width: int, ranks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows and their distinct shingles' hashes in order; ranks puts the rank of a hash's bucket for the bucket."""
    raw = LOWER[raw]
    starts, ends, first = words(raw, offsets)
    h, n = span_hashes(raw, starts, ends, 70), np.diff(first)
    full = np.flatnonzero(whole(first, width, len(h)))
    row, out = [rows_of(first)[full]], [run_hashes(h, width, 1)[full]]
    for w in range(1, width):
        if len(short := np.flatnonzero(n == w)):
            row.append(short)
            out.append(run_hashes(h, w, 1)[first[short]])
    row, code = np.concatenate(row), np.concatenate(out)
    if ranks is not None:
        code = (ranks[(code >> U64(48)).astype(np.int64)] << U64(48)) | (code & LOW)
    order = np.lexsort((code, row))
    row, code = row[order], code[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (code[1:] != code[:-1])
    return row[new], code[new]


def names_of(row: np.ndarray, code: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's set as one hash (of an empty one 0), and its size."""
    n = np.bincount(row, minlength=rows)
    out = np.zeros(rows, U64)
    np.add.at(out, row, mix(code.copy()))
    return np.where(n > 0, mix(out + n.astype(U64)), U64(0)).view(np.int64), n


def sketches_of(row: np.ndarray, code: np.ndarray, n: np.ndarray) -> list[bytes]:
    """Each row's set as bits, of which each shingle flips one: as many as the next power of two from its size, 64 at least."""
    size = np.left_shift(1, np.ceil(np.log2(np.maximum(n, 64))).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(size)])
    spots = at[row] + (code & (size[row] - 1).astype(U64)).astype(np.int64)
    raw = np.packbits((np.bincount(spots, minlength=at[-1]) & 1).astype(np.uint8), bitorder="little").tobytes()
    return [raw[a:b] for a, b in zip((at[:-1] >> 3).tolist(), (at[1:] >> 3).tolist(), strict=True)]


def apart(x: bytes, y: bytes) -> int:
    """A lower bound of how many shingles two sets do not share, from their sketches."""
    a, b = sorted((np.frombuffer(x, U64), np.frombuffer(y, U64)), key=len)
    return int(np.bitwise_count(a ^ np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0)).sum())


def column_names(width: int, ranks: np.ndarray):
    """A function of an Arrow column that gives the names of its rows' sets."""

    def run(column: pa.Array) -> list[pa.Array]:
        raw, offsets = buffers(column)
        parts = [names_of(*shingles_of(cut, at, width, ranks), j - i)[0] for i, j, cut, at in slices(raw, offsets)]
        return [pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64))]

    return run


def rarity(docs: DataFrame, width: int, text: str) -> np.ndarray:
    """The rank of each hash bucket by how many shingles of documents fall into it: one packed table of fixed size per task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for b in batches:
            raw, offsets = buffers(b.column(0))
            for _, _, cut, at in slices(raw, offsets):
                total += np.bincount((shingles_of(cut, at, width)[1] >> U64(48)).astype(np.int64), minlength=1 << 16)
        yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([x.tobytes() for x in np.split(total, PARTS)])], ["part", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), np.int64) for x in table.column("counts"))
        return pa.table([table.column("part").slice(0, 1), pa.array([total.tobytes()])], ["part", "counts"])

    kind = "part int, counts binary"
    found = sorted(docs.select(text).mapInArrow(count, kind).groupBy("part").applyInArrow(add, kind).collect())  # PARTS rows
    ranks = np.zeros(1 << 16, U64)
    if found:
        ranks[np.argsort(np.concatenate([np.frombuffer(r["counts"], np.int64) for r in found]), kind="stable")] = np.arange(1 << 16, dtype=U64)
    else:
        ranks[:] = np.arange(1 << 16, dtype=U64)
    return ranks


def shared_prefixes(sets: DataFrame, n_buckets: int) -> DataFrame:
    """Of distinct sets (sid, n, prefix) the prefix shingles that several hold: token, sid, n, spot."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = buffers(b.column(2))
            token, size = raw.view(np.int64), np.diff(offsets) // 8
            spot = np.arange(len(token)) - np.repeat(np.cumsum(size) - size, size)
            values = {"token": token, "sid": np.repeat(np.asarray(b.column(0)), size), "n": np.repeat(np.asarray(b.column(1)), size), "spot": spot}
            bucket = packing.bucket_of(mix(token.view(U64).copy()), n_buckets)
            order = np.argsort(bucket, kind="stable")
            at = np.flatnonzero(np.diff(bucket[order], prepend=-1))
            cuts = list(zip(at.tolist(), [*at[1:].tolist(), len(order)], strict=True))
            packed = [pa.array([v[order[i:j]].astype(KINDS[c]).tobytes() for i, j in cuts], pa.binary()) for c, v in values.items()]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[order[at]].astype(np.int32)), *packed], schema=DEALT)

    def several(table: pa.Table) -> pa.Table:
        held = {c: np.frombuffer(b"".join(table.column(c).to_pylist()), k) for c, k in KINDS.items()}
        order = np.argsort(held["token"], kind="stable")
        token = held["token"][order]
        same = np.zeros(len(token) + 1, bool)
        same[1:-1] = token[1:] == token[:-1]
        kept = order[same[1:] | same[:-1]]
        return pa.table({c: v[kept] for c, v in held.items()})

    dealt = sets.select("sid", "n", "prefix").mapInArrow(deal, "bucket int, token binary, sid binary, n binary, spot binary")
    return saved(dealt.groupBy("bucket").applyInArrow(several, "token bigint, sid bigint, n int, spot int"))


def close_prints(sets: DataFrame, bits: int) -> DataFrame:
    """Pairs (u, v) of distinct sets (sid, fp): the least of each fingerprint with its others, and with the least of linked fingerprints."""
    least = saved(sets.groupBy("fp").agg(F.min("sid").alias("head")))
    stars, _, crossing = print_links(least.select("fp"), bits)
    linked = stars.unionByName(crossing.select(F.col("a_fp").alias("u"), F.col("b_fp").alias("v"))).toDF("a_fp", "b_fp").distinct()
    apart = linked.join(least.toDF("a_fp", "u"), "a_fp").join(least.toDF("b_fp", "v"), "b_fp").select("u", "v")
    equal = sets.select("sid", "fp").join(least, "fp").where("sid <> head").select(F.col("head").alias("u"), F.col("sid").alias("v"))
    return saved(apart.unionByName(equal).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())


def fits(up: int, down: int) -> Column:
    """Length and positional filters of a pair a, b at one shared shingle."""
    a, b, both = F.col("a_n").cast("bigint"), F.col("b_n").cast("bigint"), F.col("a_n").cast("bigint") + F.col("b_n")
    return (F.least(a, b) * down >= F.greatest(a, b) * up) & (F.least(a - F.col("a_spot"), b - F.col("b_spot")) * (up + down) >= both * up)


def by_sketch(pairs: DataFrame, every: DataFrame, up: int, down: int) -> DataFrame:
    """The distinct (u, v) pairs of sets whose sketches (of every: sid, n, sketch) allow the asked similarity."""
    of = lambda k: every.select(F.col("sid").alias(k), F.col("n").alias(f"{k}_n"), F.col("sketch").alias(f"{k}_sketch"))
    both = pairs.distinct().join(of("u"), "u").join(of("v"), "v").select("u", "v", (F.col("u_n").cast("bigint") + F.col("v_n")).alias("both"), "u_sketch", "v_sketch")

    def allowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = [apart(x.as_py(), y.as_py()) * (up + down) <= n.as_py() * (down - up) for n, x, y in zip(*b.columns[2:], strict=True)]
            yield pa.RecordBatch.from_arrays(b.columns[:2], ["u", "v"]).filter(pa.array(good, pa.bool_()))

    return saved(both.mapInArrow(allowed, "u bigint, v bigint"))


def verified(pairs: DataFrame, every: DataFrame, docs: DataFrame, width: int, ranks: np.ndarray, up: int, down: int, text: str) -> DataFrame:
    """The distinct (u, v) pairs of sets that have the asked similarity. every: sid, n, sketch of all sets."""
    pairs = by_sketch(pairs, every, up, down)
    wanted = pairs.select(F.col("u").alias("__sid")).unionByName(pairs.select(F.col("v").alias("__sid"))).distinct()
    spot = F.pmod("__sid", F.lit(BITS))
    bitmaps = wanted.groupBy(F.shiftright(spot, 15).alias("part")).agg(F.bitmap_construct_agg(spot.bitwiseAND(F.lit(32767))).alias("bits")).collect()  # BITS bits at most
    table = np.zeros(BITS // 8, np.uint8)
    for r in bitmaps:
        table[r["part"] << 12 : (r["part"] + 1) << 12] = np.frombuffer(r["bits"], np.uint8)
    if not bitmaps:
        return pairs
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sets whose bit is on; others are not wanted and need not travel."""
        for b in batches:
            raw, offsets = buffers(b.column(0))
            for i, j, cut, at in slices(raw, offsets):
                row, code = shingles_of(cut, at, width, ranks)
                sid, n = names_of(row, code, j - i)
                place = sid % BITS
                on = np.flatnonzero(shared.value[place >> 3] >> (place & 7).astype(np.uint8) & 1)
                upto = np.cumsum(n) - n
                yield pa.RecordBatch.from_arrays([pa.array(sid[on]), pa.array([code[upto[k] : upto[k] + n[k]].tobytes() for k in on.tolist()], pa.binary())], ["__sid", "codes"])

    sets = saved(docs.select(text).mapInArrow(sets_of, "__sid bigint, codes binary").groupBy("__sid").agg(F.min("codes").alias("codes")).join(wanted, "__sid", "left_semi"))
    let_go(docs.sparkSession)
    both = pairs.join(sets.toDF("u", "x"), "u").join(sets.toDF("v", "y"), "v").select("u", "v", "x", "y")

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), U64), np.frombuffer(y.as_py(), U64)
                good.append(len(np.intersect1d(x, y, assume_unique=True)) * (up + down) >= (len(x) + len(y)) * up)
            yield pa.RecordBatch.from_arrays(b.columns[:2], ["u", "v"]).filter(pa.array(good, pa.bool_()))

    return saved(both.mapInArrow(alike, "u bigint, v bigint"))


def by_set(docs: DataFrame, ranks: np.ndarray, width: int, up: int, down: int, text: str, bits: int) -> DataFrame:
    """The distinct sets of docs that stand in a row of their component's smallest doc_id: sid, root (the component's least sid) and component_id (that doc_id)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = buffers(b.column(1))
            for i, j, cut, at in slices(raw, offsets):
                row, code = shingles_of(cut, at, width, ranks)
                sid, n = names_of(row, code, j - i)
                upto = np.cumsum(n) - n
                most = np.where(n > 0, n - (n * up + down - 1) // down + 1, 0)
                packed = [code[a : a + m].tobytes() for a, m in zip(upto.tolist(), most.tolist(), strict=True)]
                prints = fingerprints_of(cut, at, width).view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(sid), pa.array(n.astype(np.int32)), pa.array(packed, pa.binary()), pa.array(sketches_of(row, code, n), pa.binary()), pa.array(prints)], ["doc_id", "sid", "n", "prefix", "sketch", "fp"])

    rows = docs.select("doc_id", text).mapInArrow(prefixes, f"doc_id {kind}, sid bigint, n int, prefix binary, sketch binary, fp bigint")
    sets = saved(rows.groupBy("sid").agg(F.min("doc_id").alias("least"), F.min("n").alias("n"), F.min("prefix").alias("prefix"), F.min("sketch").alias("sketch"), F.min("fp").alias("fp")))
    close = close_prints(sets, bits)
    let_go(docs.sparkSession)
    held = shared_prefixes(sets, buckets_for(docs.sparkSession, text_bytes(docs, text), 24 << 20)).toDF("token", "a", "a_n", "a_spot")
    # the prefixes are not read again
    every = saved(sets.select("sid", "least", "n", "sketch"))
    del rows, sets
    let_go(docs.sparkSession)
    lead = held.groupBy("token").agg(F.min(F.struct("a", "a_n", "a_spot")).alias("b"))
    met = held.join(lead, "token").select("a", "a_n", "a_spot", F.col("b.a").alias("b"), F.col("b.a_n").alias("b_n"), F.col("b.a_spot").alias("b_spot"))
    met = met.where("a <> b").where(fits(up, down)).select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
    stars = verified(met.unionByName(close), every, docs, width, ranks, up, down, text)
    let_go(docs.sparkSession)
    roots = saved(components(stars))
    size = roots.groupBy("root").agg(F.count("*").alias("size"))
    named = roots.join(size, "root").select(F.col("u").alias("a"), "root", "size")
    whose = held.join(named, "a", "left").withColumns({"root": F.coalesce("root", "a"), "size": F.coalesce("size", F.lit(1))})
    split = whose.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max(F.struct("size", "root")).alias("big")).where("lo <> hi")
    left = saved(whose.join(split.select("token", F.col("big.root").alias("big")), "token").drop("size"))
    others = left.select("token", F.col("a").alias("b"), F.col("a_n").alias("b_n"), F.col("a_spot").alias("b_spot"), F.col("root").alias("b_root"), (F.col("root") == F.col("big")).alias("main"))
    crossing = left.where("root <> big").join(others, "token").where((F.col("root") != F.col("b_root")) & (F.col("main") | (F.col("a") < F.col("b"))) & fits(up, down))
    links = verified(crossing.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")), every, docs, width, ranks, up, down, text)
    bridged = stars.unionByName(links)
    last = components(bridged).toDF("sid", "root")
    first = every.join(last, "sid", "left").select("sid", "least", F.coalesce("root", "sid").alias("root"))
    names = first.groupBy("root").agg(F.min("least").alias("component_id"))
    return saved(first.join(names, "root").where(F.col("least").eqNullSafe(F.col("component_id"))).select("sid", "root", "component_id"))


def one_of_each(docs: DataFrame, width: int = 5, up: int = 4, down: int = 5, text: str = "text", bits: int = 4) -> DataFrame:
    """The documents, all columns kept, that stand for their component: of those with its smallest doc_id the one with the least text."""
    small_batches(docs.sparkSession)
    ranks = rarity(docs, width, text)
    sid, root, component, rank, spread = (fresh(docs, c) for c in ("sid", "root", "component", "rank", "spread"))
    named = by_set(docs, ranks, width, up, down, text, bits).toDF(sid, root, component).withColumn(spread, F.xxhash64(component))
    # whole texts move once, by set and doc_id; only where a smallest doc_id stands on several sets they meet by component after that
    several = named.groupBy(root).count().where("count > 1").limit(1).count()
    let_go(docs.sparkSession)
    texts = annotated(docs, text, [(sid, "bigint")], lambda: column_names(width, ranks)).withColumn(spread, F.xxhash64("doc_id"))
    same = F.coalesce(F.col("doc_id") == F.col(component), F.col("doc_id").isNull() & F.col(component).isNull())  # as <=> it would become a key of the join
    held = texts.join(named, [sid, spread]).where(same)
    first = F.row_number().over(Window.partitionBy(*([root] if several else [sid, spread])).orderBy(text))
    return held.withColumn(rank, first).where(F.col(rank) == 1).select(*docs.columns)
