"""Connected components over an edge table, by alternating large-star and small-star rounds.

Each round only groups by one endpoint and takes minima, so no task sees more than one vertex's edges at a
time and nothing comes to the driver but a checksum. Rounds end in a checkpoint; they grow with the logarithm
of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.runtime import saved


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links each vertex's neighbours (large: the greater ones; else the smaller ones and itself) to the least of them."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if large:
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    out = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.unionByName(least.where("u <> m").select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """Distinct vertices of the (u, v) edges with the least vertex that each can reach: columns u, root."""
    now = saved(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    while True:
        total = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if tuple(total) == mark or total[0] == 0:
            break
        mark = tuple(total)
        now = saved(_star(_star(now, True), False))
    return now.groupBy("u").agg(F.min("v").alias("root")).unionByName(now.select(F.col("v").alias("u")).distinct().select("u", F.col("u").alias("root"))).groupBy("u").agg(F.min("root").alias("root"))
