"""Connected components by alternating large-star and small-star steps.

After Kiveris and others, "Connected Components in MapReduce and Beyond" (2014).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import forget, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links the larger (or smaller) neighbours of each vertex, and itself, to its least neighbour."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("least"))
    linked = both.join(least, "u")
    if large:
        out = linked.where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))
    else:
        out = linked.select(F.col("v").alias("u"), F.col("least").alias("v")).union(least.select("u", F.col("least").alias("v")))
    return out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, component) for each vertex of the edges (u, v) that isn't its component's least.

    Each round is written to the shared folder, so lost executors cost one round; the
    rounds' number grows with the logarithm of the vertices.
    """
    now = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    while True:
        after = written(_star(_star(now, True), False))
        forget(now)
        now = after
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state:
            return now.select("u", F.col("v").alias("component"))
        state = seen
