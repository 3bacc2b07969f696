"""Approximate nearest neighbours with a hash-prefix forest, by largest inner product.

Equal vectors count once: a class is named by its smallest id. Classes are dealt by hash over index blocks of bounded
size; a block's forest holds, per tree, the sorted 64-bit hash strings of its vectors (signs of random
projections, of vectors lifted by one coordinate to equal length, so that inner product order is angle order).
A query descends each tree to its longest matching prefix, then all trees ascend together, one bit a level,
until the ranges under the common prefix length hold `share` of the block (at least `least` vectors). These
candidates are scored exactly. Query blocks meet every index block; per query and block the best k + 1 classes
go on. What runs is the stated query set against all rows, in blocks of bounded size.

Vectors in high dimensions without structure need a large share for a recall of 0.9; the default is measured on
such data (see README).

Defined cases: vectors that are null, zero, empty or hold null or non-finite components take no part;
vectors of different lengths never meet; null ids take no part; repeated rows count once; other columns are
ignored; a query has all candidates if fewer than k; empty tables give no rows.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.arrays import U64
from spanloom.llm.runtime import saved

BLOCK, QUERY_BLOCK, SALT = 16384, 4096, 64


class HashForest:
    """Sorted hash strings of a block's vectors."""

    def __init__(self, vectors: np.ndarray, trees: int, seed: int = 7):
        norms = np.linalg.norm(vectors, axis=1)
        self.vectors, self.rough, top = vectors, vectors.astype(np.float32), norms.max(initial=0)
        self.top = top
        lifted = np.column_stack([vectors, np.sqrt(np.maximum(top * top - norms * norms, 0))]).astype(np.float32)
        self.planes = np.random.default_rng(seed).standard_normal((trees, lifted.shape[1], 64), np.float32)
        self.trees = []
        for planes in self.planes:
            h = self.strings(lifted, planes)
            order = np.argsort(h)
            self.trees.append((h[order], order))

    @staticmethod
    def strings(lifted: np.ndarray, planes: np.ndarray) -> np.ndarray:
        return np.packbits(lifted @ planes > 0, axis=1).view(">u8").ravel().astype(U64)

    def ranges(self, queries: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Per tree and query string, the sorted positions that share the first `level` bits."""
        low = U64((1 << (64 - level)) - 1)
        lo = np.stack([np.searchsorted(h, q & ~low, "left") for (h, _), q in zip(self.trees, queries, strict=True)])
        hi = np.stack([np.searchsorted(h, q | low, "right") for (h, _), q in zip(self.trees, queries, strict=True)])
        return lo, hi

    def candidates(self, queries: np.ndarray, wanted: int) -> list[np.ndarray]:
        """For each query the vectors under the longest common prefix length that holds the wanted number."""
        n = len(self.vectors)
        lifted = np.column_stack([queries, np.zeros(len(queries))]).astype(np.float32)
        strings = np.stack([self.strings(lifted, planes) for planes in self.planes])
        out: list[np.ndarray | None] = [None] * len(queries)
        # descent: the longest prefix that any tree matches; nothing is found above that level
        longest = np.zeros(len(queries), np.int64)
        for (h, _), q in zip(self.trees, strings, strict=True):
            at = np.searchsorted(h, q)
            for side in (np.minimum(at, n - 1), np.maximum(at - 1, 0)):
                differ = h[side] ^ q
                longest = np.maximum(longest, 64 - np.where(differ > 0, np.floor(np.log2(np.maximum(differ, 1).astype(np.float64))) + 1, 0).astype(np.int64))
        active = np.arange(len(queries))
        for level in range(int(longest.max(initial=0)), -1, -1):
            lo, hi = self.ranges(strings[:, active], level)
            enough = np.flatnonzero(((hi - lo).sum(axis=0) >= wanted) & (longest[active] >= level))
            ended = []
            for a in enough.tolist():
                mark = np.zeros(n, bool)
                for t, (_, order) in enumerate(self.trees):
                    mark[order[lo[t, a] : hi[t, a]]] = True
                found = np.flatnonzero(mark)
                if len(found) >= wanted or level == 0:
                    out[active[a]] = found
                    ended.append(a)
            active = np.delete(active, ended)
            if not len(active):
                break
        everything = np.arange(n)
        return [everything if x is None else x for x in out]

    def nearest(self, queries: np.ndarray, k: int, wanted: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Positions and inner products (double) of the k best candidates of each query, best first."""
        out = []
        for i in range(0, len(queries), 512):
            part = queries[i : i + 512]
            for q, found in zip(part, self.candidates(part, wanted), strict=True):
                if len(found) > k:
                    # single precision first; all that its error leaves open go on to the double product
                    rough = self.rough[found] @ q.astype(np.float32)
                    error = len(q) * 2.0**-22 * self.top * np.linalg.norm(q)
                    found = found[~(rough < -np.partition(-rough, k - 1)[k - 1] - error)]
                exact = self.vectors[found] @ q
                best = np.lexsort((found, -exact))[:k]
                out.append((found[best], exact[best]))
        return out


def usable(vector: Column) -> Column:
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, fine) & F.exists(vector, lambda x: x != 0)


def nearest_neighbours(table: DataFrame, is_query: Column, k: int = 20, trees: int = 32, share: float = 0.45, least: int = 1024, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query row's k nearest found, ties to the smaller id.

    is_query: a condition on the key column.
    """
    spark = table.sparkSession
    rows = table.select(table[key].cast("bigint").alias(key), table[vector].alias("v")).where(F.col(key).isNotNull() & usable(F.col("v")))
    rows = rows.select(F.col(key).alias("id"), "v", is_query.alias("asks")).distinct()
    classes = saved(rows.groupBy("v").agg(F.min("id").alias("class"), F.max("asks").alias("asks")))
    named = saved(rows.join(classes.select("v", "class"), "v").select("id", "asks", "class"))
    counts = classes.agg(F.count("*"), F.sum(F.col("asks").cast("int"))).first()
    n_blocks, n_query_blocks = max(1, ceil(counts[0] / BLOCK)), max(1, ceil((counts[1] or 0) / QUERY_BLOCK))
    deal = lambda n: F.pmod(F.xxhash64("class"), F.lit(n)).cast("int")
    index = classes.select("class", "v", deal(n_blocks).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(n_query_blocks - 1))).alias("asked"))
    asking = classes.where("asks").select("class", "v", deal(n_query_blocks).alias("asked"), F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"))
    parts = [F.col("block"), F.col("asked"), F.size("v").alias("dim")]

    def search(own: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if own.num_rows and queries.num_rows:
            # by class, so that neither the forest nor equal scores depend on the order of arrival
            own, queries = own.sort_by("class"), queries.sort_by("class")
            ids, asked = np.asarray(own.column("class")), np.asarray(queries.column("class"))
            shape = lambda t: np.asarray(t.column("v").combine_chunks().flatten(), np.float64).reshape(t.num_rows, -1)
            forest = HashForest(shape(own), trees)
            for q, (at, score) in zip(asked, forest.nearest(shape(queries), k + 1, max(least, ceil(share * len(ids)))), strict=True):
                out[0].append(np.full(len(at), q))
                out[1].append(ids[at])
                out[2].append(score)
        kinds = (np.int64, np.int64, np.float64)
        return pa.table([pa.array(np.concatenate(x) if x else np.zeros(0, d)) for x, d in zip(out, kinds, strict=True)], ["asking", "class", "score"])

    def grouped(df: DataFrame):
        return df.select("class", "v", *parts).groupBy("block", "asked", "dim")

    found = grouped(index).cogroup(grouped(asking)).applyInArrow(search, "asking bigint, class bigint, score double")
    best = found.withColumn("r", F.row_number().over(Window.partitionBy("asking").orderBy(F.desc("score"), "class"))).where(F.col("r") <= k + 1).drop("r")
    # a class's k + 1 smallest ids are all that any list can need; salted, as one class may hold a third of all rows
    first = lambda df, *by: df.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("id"))).where(F.col("r") <= k + 1).drop("r")
    members = first(first(named.select("class", "id", F.pmod(F.xxhash64("id"), F.lit(SALT)).alias("salt")), "class", "salt"), "class").select("class", "id")
    listed = best.join(members, "class").withColumn("r", F.row_number().over(Window.partitionBy("asking").orderBy(F.desc("score"), "id"))).where(F.col("r") <= k + 1)
    lists = listed.groupBy("asking").agg(F.array_sort(F.collect_list(F.struct("r", "id", "score"))).alias("near"))
    asked_rows = named.where("asks").select(F.col("id").alias("query_id"), F.col("class").alias("asking"))
    others = F.slice(F.filter("near", lambda x: x["id"] != F.col("query_id")), 1, k)
    out = asked_rows.join(lists, "asking").select("query_id", F.posexplode(others).alias("p", "x"))
    return out.select("query_id", (F.col("p") + 1).alias("rank"), F.col("x.id").alias(key), F.col("x.score").alias("score"))
