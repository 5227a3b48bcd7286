"""Connected components of an edge table by alternating large-star and
small-star steps (Kiveris et al., 2014), on Spark joins and aggregates.

Every step keeps only a minimum per node, so a hub is pre-aggregated before the
shuffle; each round is written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslens.llm.common import stage


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(low.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) of longs -> (node, root): each node of an edge with the
    smallest node of its component. No edge: no row. Self-loops are dropped."""
    now = stage(edges.where("a <> b").select("a", "b").distinct(), "edges")
    mark = F.xxhash64("a", "b").cast("decimal(38,0)")

    def state(e):
        return tuple(e.agg(F.count("*"), F.sum(mark)).first())

    seen = state(now)
    while seen[0]:
        now = stage(_small_star(_large_star(now)), "edges")
        after = state(now)
        if after == seen:
            break
        seen = after
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionAll(stars.select("root", "root").distinct().toDF("node", "root"))
