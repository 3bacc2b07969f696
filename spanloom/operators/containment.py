"""Spans within spans, by a sweep over starts instead of a range condition.

Outer spans of a key are disjoint (paragraphs, segments, rows, chunks, passages of any kind that tile a text), so an inner span can
lie in one of them at most: the last that starts at or before it. One sort by place finds it. Long texts are cut in
bins of BIN characters, into which outer spans are entered wherever they reach, so that no task has to sort more of a text than that.

Outer spans without characters hold nothing; an inner span without characters belongs to the outer span in which it starts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BIN = 1 << 16


def contained(inner: DataFrame, outer: DataFrame, key: str = "chapter_idx", inner_span: tuple[str, str] = ("start_char", "end_char"), outer_span: tuple[str, str] = ("start_char", "end_char"), bin_size: int = BIN) -> DataFrame:
    """key, inner and outer (structs of all columns of both sides) for each inner span that lies in an outer one."""
    (s0, s1), (t0, t1) = inner_span, outer_span
    spot = lambda c: F.floor(c / bin_size).cast("bigint")
    whole = lambda df: F.struct(*[F.col(c) for c in df.columns])
    bins = F.explode(F.sequence(spot(F.col(t0)), spot(F.col(t1) - 1)))
    a = outer.where(F.col(t0) < F.col(t1)).select(F.col(key), bins.alias("bin"), F.col(t0).cast("bigint").alias("at"), F.lit(0).alias("turn"), whole(outer).alias("outer"))
    b = inner.select(F.col(key), spot(F.col(s0)).alias("bin"), F.col(s0).cast("bigint").alias("at"), F.lit(1).alias("turn"), whole(inner).alias("inner"))
    upto = Window.partitionBy(key, "bin").orderBy("at", "turn").rowsBetween(Window.unboundedPreceding, 0)
    swept = a.unionByName(b, allowMissingColumns=True).withColumn("outer", F.last("outer", ignorenulls=True).over(upto))
    return swept.where(F.col("inner").isNotNull() & (F.col(f"inner.{s0}") < F.col(f"outer.{t1}")) & (F.col(f"inner.{s1}") <= F.col(f"outer.{t1}"))).select(key, "inner", "outer")


def least_behind(points: DataFrame, places: DataFrame, value: str, key: str = "chapter_idx", at: str = "at", bin_size: int = BIN) -> DataFrame:
    """places(key, at) with `least`: the least value of the points of the same key at that place or behind it (null: none).

    Within a bin a running minimum from the end; over the bins behind it a running minimum of their minima.
    """
    spot = F.floor(F.col(at) / bin_size).cast("bigint")
    a = points.select(key, spot.alias("bin"), F.col(at).cast("bigint").alias("at"), F.col(value).alias("v"), F.lit(0).alias("turn"))
    b = places.select(key, spot.alias("bin"), F.col(at).cast("bigint").alias("at"), F.lit(1).alias("turn"), F.struct(*[F.col(c) for c in places.columns]).alias("place"))
    behind = Window.partitionBy(key, "bin").orderBy(F.desc("at"), "turn").rowsBetween(Window.unboundedPreceding, 0)
    swept = a.unionByName(b, allowMissingColumns=True).withColumn("here", F.min("v").over(behind)).where("turn = 1")
    later = Window.partitionBy(key).orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
    # a row for each bin, of points or places
    bins = a.select(key, "bin", "v").unionByName(b.select(key, "bin").distinct(), allowMissingColumns=True).groupBy(key, "bin").agg(F.min("v").alias("m"))
    carried = bins.select(key, "bin", F.min("m").over(later).alias("rest"))
    return swept.join(carried, [key, "bin"]).select("place.*", F.least("here", "rest").alias("least"))
