"""SimHash near-dedup: segment-popcount embedding, grid range-join under Manhattan distance, exact verification.

A 64-bit fingerprint is cut into 32 two-bit segments; their popcounts are its place in a 32-dimensional grid.
One differing bit moves one coordinate by one at most, so the Manhattan distance of two places is a lower
bound of the Hamming distance. The coordinates fall into g blocks. Within distance d at least g - d blocks
agree, so points meet in the grid cells of every choice of g - d blocks, none is lost, and pairs within
Manhattan distance d go to the exact test.

Copies share a fingerprint and count once. Inside a cell every point is first held against the cell's least
fingerprint only; connected components of those links are contracted, and only points of different components
are then paired (all points outside of the cell's largest component, with all). So a dense group costs about
its size, not its square, and no link between components is lost.

Coordinates are kept unary inside the segment (0, 01, 11), so the Manhattan distance is the popcount of an xor.

Defined cases: null and empty texts have fingerprint zero and link like any other; a text with fewer words
than a shingle is one shingle; repeated rows each give a row; a null doc_id is not its component's name unless
all are null; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.arrays import LOWER, U64, buffers, rows_of, slices, words
from spanloom.llm.components import components
from spanloom.llm.runtime import annotated, fresh, saved, small_batches

SEED = 42
SEGMENT_BITS = 1.415  # collision entropy of the popcount of two random bits


def joined_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray]:
    """All words, each followed by one space, and the byte where each begins (and the end)."""
    size = ends - starts + 1
    upto = np.concatenate([[0], np.cumsum(size)])
    out = np.append(raw, np.uint8(0x20))[np.repeat(starts - upto[:-1], size) + np.arange(upto[-1])] if len(starts) else raw[:0]
    if len(starts):
        out[upto[1:] - 1] = 0x20
    return out.tobytes(), upto


def fingerprints_of(raw: np.ndarray, offsets: np.ndarray, width: int) -> np.ndarray:
    """Bit b of a text's fingerprint is one if it is set in over half of its shingles' hashes."""
    raw = LOWER[raw]
    starts, ends, first = words(raw, offsets)
    text, at = joined_words(raw, starts, ends)
    n = np.diff(first)
    shingles = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    begin = np.repeat(first[:-1], shingles) + np.arange(shingles.sum()) - np.repeat(np.cumsum(shingles) - shingles, shingles)
    stop = begin + np.repeat(np.minimum(width, n), shingles)
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(text[a:b], SEED) for a, b in zip(at[begin].tolist(), (at[stop] - 1).tolist(), strict=True)), U64, len(begin))
    out = np.zeros(len(n), U64)
    if len(h):
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        has = shingles > 0
        counts = np.add.reduceat(bits, (np.cumsum(shingles) - shingles)[has], axis=0, dtype=np.int64)
        out[has] = np.packbits(2 * counts > shingles[has][:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, width: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) per row, in one narrow pass."""
    kind = docs.schema[key].dataType.simpleString()
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = buffers(b.column(1))
            for i, j, cut, cut_offsets in slices(raw, offsets):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(fingerprints_of(cut, cut_offsets, width).view(np.int64))], ["doc_id", "fp"])

    return docs.select(docs[key], docs[text]).mapInArrow(run, f"doc_id {kind}, fp bigint")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def place(fp: Column) -> Column:
    """The popcounts of the 32 two-bit segments, each in unary in its own two bits."""
    low, high = F.lit(0x5555555555555555), F.shiftrightunsigned(fp, 1)
    return fp.bitwiseOR(high).bitwiseAND(low).bitwiseOR(F.shiftleft(fp.bitwiseAND(high).bitwiseAND(low), 1))


def blocks_for(n: int, distance: int) -> int:
    """Blocks g that make cell rows and expected chance meetings together cheapest; any g > distance is exact."""
    cost = lambda g: comb(g, distance) * (1 + 0.05 * n * 2 ** (-SEGMENT_BITS * 32 * (g - distance) / g))
    return min(range(distance + 1, 17), key=cost)


def cell_masks(blocks: int, distance: int) -> list[int]:
    """For each choice of blocks - distance blocks, the fingerprint bits of their segments."""
    edges = [2 * round(32 * b / blocks) for b in range(blocks + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return [signed(sum(c)) for c in combinations(masks, blocks - distance)]


def near(a: str, b: str, distance: int) -> Column:
    """The Manhattan bound first, then the exact distance."""
    return (F.bit_count(F.col(f"{a}_place").bitwiseXOR(F.col(f"{b}_place"))) <= distance) & (F.bit_count(F.col(f"{a}_fp").bitwiseXOR(F.col(f"{b}_fp"))) <= distance)


def links(points: DataFrame, distance: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of distinct fingerprints (column fp, saved) links that together connect all within the distance.

    Links to the least of a cell (u, v); their components (u, root); links between these (a_fp, root, b_fp, b_root).
    """
    masks = cell_masks(blocks_for(points.count(), distance), distance)
    cells = points.select("fp", place(F.col("fp")).alias("place")).select(
        "fp", "place", F.posexplode(F.array(*[F.col("place").bitwiseAND(F.lit(m)) for m in masks])).alias("choice", "cell")
    )
    shared = cells.groupBy("choice", "cell").agg(F.count("*").alias("n"), F.min(F.struct("fp", "place")).alias("p")).where("n > 1")
    met = saved(cells.join(shared, ["choice", "cell"]).select("choice", "cell", F.col("fp").alias("a_fp"), F.col("place").alias("a_place"), F.col("p.fp").alias("b_fp"), F.col("p.place").alias("b_place")))
    stars = met.where("a_fp <> b_fp").where(near("a", "b", distance)).select(F.col("a_fp").alias("u"), F.col("b_fp").alias("v"))
    roots = saved(components(stars))
    size = roots.groupBy("root").agg(F.count("*").alias("size"))
    named = roots.join(size, "root").select(F.col("u").alias("a_fp"), "root", "size")
    held = met.select("choice", "cell", "a_fp", "a_place").join(named, "a_fp", "left").withColumns({"root": F.coalesce("root", "a_fp"), "size": F.coalesce("size", F.lit(1))})
    open_cells = held.groupBy("choice", "cell").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max(F.struct("size", "root")).alias("big")).where("lo <> hi")
    left = saved(held.join(open_cells.select("choice", "cell", F.col("big.root").alias("big")), ["choice", "cell"]).select("choice", "cell", "a_fp", "a_place", "root", "big"))
    others = left.select("choice", "cell", F.col("a_fp").alias("b_fp"), F.col("a_place").alias("b_place"), F.col("root").alias("b_root"), (F.col("root") == F.col("big")).alias("main"))
    crossing = left.where("root <> big").join(others, ["choice", "cell"]).where((F.col("root") != F.col("b_root")) & (F.col("main") | (F.col("a_fp") < F.col("b_fp"))) & near("a", "b", distance))
    return stars, roots, crossing


def linked(points: DataFrame, distance: int) -> DataFrame:
    """For distinct fingerprints (column fp, saved): fp and root, the least fingerprint reachable over links."""
    _, roots, crossing = links(points, distance)
    bridges = components(crossing.select(F.col("root").alias("u"), F.col("b_root").alias("v")))
    first = points.join(roots, points["fp"] == roots["u"], "left").select("fp", F.coalesce("root", "fp").alias("one"))
    return first.join(bridges.select(F.col("u").alias("one"), F.col("root").alias("two")), "one", "left").select("fp", F.coalesce("two", "one").alias("root"))


def near_duplicates(docs: DataFrame, width: int = 4, distance: int = 4) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id that links reach, itself included) per row."""
    prints = saved(fingerprints(docs, width))
    return prints.join(by_fingerprint(prints, distance), "fp").select("doc_id", "fp", "component_id")


def by_fingerprint(prints: DataFrame, distance: int) -> DataFrame:
    """For each fingerprint of (doc_id, fp) rows its component's root fingerprint and smallest doc_id: fp, root, component_id."""
    points = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = linked(points.select("fp"), distance)
    named = points.join(roots, "fp").select("fp", "least", "root")
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return named.join(names, "root").select("fp", "root", "component_id")


def one_of_each(docs: DataFrame, width: int = 5, distance: int = 4, text: str = "text") -> DataFrame:
    """The documents, all columns kept, that stand for their component: of those with its smallest doc_id the one with the least text."""

    def prints_of(column: pa.Array) -> list[pa.Array]:
        raw, offsets = buffers(column)
        parts = [fingerprints_of(cut, cut_offsets, width).view(np.int64) for _, _, cut, cut_offsets in slices(raw, offsets)]
        return [pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64))]

    fp, root, component, rank = (fresh(docs, c) for c in ("print", "root", "component", "rank"))
    named = by_fingerprint(saved(fingerprints(docs, width)), distance).toDF(fp, root, component)
    held = annotated(docs, text, [(fp, "bigint")], lambda: prints_of).join(named, fp).where(F.col("doc_id").eqNullSafe(F.col(component)))
    first = F.row_number().over(Window.partitionBy(root).orderBy(text))
    return held.withColumn(rank, first).where(F.col(rank) == 1).select(*docs.columns)
