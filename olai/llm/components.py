"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from olai.llm.common import materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of longs to ``(node, root)``, root being the least node of each component.

    Large and small stars in turn hang every node on its least neighbour; the
    edges are stars on their roots once a round changes nothing, after about
    log(nodes) rounds. Minima are pre-aggregated and joined back to edges that
    were written, so a hub's edges never meet in one group, nor in one task of
    the join where Spark splits skewed joins. Each round is written to the shared folder.
    Roots themselves are in the result; nodes without an edge are not. Loops
    and repeated edges don't matter; rows with a null are ignored.
    """
    now = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, before = materialise(now, "edges"), None
    while True:
        mark = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if mark == before:
            break
        before = mark
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Written, so that both sides of the join are scans and Spark can split a hub's edges.
        least = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = materialise(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-stars")
        least = materialise(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        # The smaller neighbours of u hang on the least of them, and so does u.
        down = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialise(down.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
