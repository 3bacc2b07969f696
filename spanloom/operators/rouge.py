"""ROUGE of two texts per key: n-gram overlap as counts in DataFrames, longest common subsequences in bit-parallel words.

Both sides are words (lower case, letters and digits). Texts that are equal but for blanks at their ends score 1. A side without
n-grams scores 0. One text of each side stands in one row, where n-grams are counted.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import text as tx


def lcs_length(a: list[str], b: list[str]) -> int:
    """Length of a longest common subsequence: a bit for each token of a, one step for each token of b.

    A cleared bit is a token of a at which the length grows. The addition carries a match over to the next such token, through
    all machine words of the number, so a step costs a 64th of a's length.
    """
    places: dict[str, int] = {}
    for i, t in enumerate(a):
        places[t] = places.get(t, 0) | 1 << i
    every = (1 << len(a)) - 1
    row = every
    for t in b:
        if (here := row & places.get(t, 0)):
            row = (row + here | row - here) & every
    return len(a) - row.bit_count()


def shared_grams(a: list[str], b: list[str], n: int) -> tuple[int, int, int]:
    """How many n-grams either side has, and how many both have, repeats included."""
    sides = [Counter(zip(*(x[i:] for i in range(n)), strict=False)) for x in (a, b)]
    return sides[0].total(), sides[1].total(), (sides[0] & sides[1]).total()


def same(a: Column, b: Column) -> Column:
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    return strip(a) == strip(b)


def scores(same_: Column, both: Column, predicted: Column, reference: Column) -> list[Column]:
    """precision, recall, f1"""
    p, r = (F.when(same_, 1.0).otherwise(F.coalesce(F.try_divide(both, n), F.lit(0.0))) for n in (predicted, reference))
    return [p.alias("precision"), r.alias("recall"), tx.f_score(p, r).alias("f1")]


def rouge_n(pairs: DataFrame, key: str, sizes: tuple[int, ...] = (1, 2), predicted: str = "predicted", reference: str = "reference") -> DataFrame:
    """key, n, precision, recall, f1 for each n-gram size."""
    # a pair is one row and is counted there: no shuffle, and grams leave no row
    kind = pairs.schema[key].dataType.simpleString()
    words = pairs.select(key, same(F.col(predicted), F.col(reference)).alias("same"), tx.words(F.col(predicted)).alias("p"), tx.words(F.col(reference)).alias("r"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, n, *shared_grams(p or [], r or [], n)) for i, (p, r) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)) for n in sizes]
            at, *numbers = ([x[k] for x in rows] for k in range(5))
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(numbers[0], pa.int32()), *(pa.array(x, pa.int64()) for x in numbers[1:])], ["id", "same", "n", "p", "r", "both"])

    found = words.mapInArrow(run, f"id {kind}, same boolean, n int, p bigint, r bigint, both bigint").withColumnRenamed("id", key)
    return found.select(key, "n", *scores(F.col("same"), F.col("both"), F.col("p"), F.col("r")))


def rouge_l(pairs: DataFrame, key: str, predicted: str = "predicted", reference: str = "reference") -> DataFrame:
    """key, lcs, precision, recall, f1: one narrow pass."""
    kind = pairs.schema[key].dataType.simpleString()
    words = pairs.select(key, same(F.col(predicted), F.col(reference)).alias("same"), tx.words(F.col(predicted)).alias("p"), tx.words(F.col(reference)).alias("r"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sides = [(p.as_py() or [], r.as_py() or []) for p, r in zip(b.column(2), b.column(3), strict=True)]
            numbers = ([len(p) for p, _ in sides], [len(r) for _, r in sides], [lcs_length(p, r) for p, r in sides])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(x, pa.int64()) for x in numbers)], ["id", "same", "p", "r", "lcs"])

    found = words.mapInArrow(run, f"id {kind}, same boolean, p bigint, r bigint, lcs bigint").withColumnRenamed("id", key)
    return found.select(key, "lcs", *scores(F.col("same"), F.col("lcs"), F.col("p"), F.col("r")))
