"""Connected components of an edge table, with no driver holding a component. Minima are
combined before they are shuffled; the edges of a node with very many meet its minimum in a
join, whose hot keys adaptive execution splits (spark.sql.adaptive.skewJoin)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import discard, stash


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v: long) -> (doc, root): each node with the least node of its component.

    Large-star and small-star steps in turn (Kiveris et al. 2014) until nothing changes:
    a logarithmic number of rounds, each a pre-aggregated minimum and an equi-join. Each
    round is written out, so a lost executor repeats a round at most.
    """
    now = stash(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _least(both).select("u", F.least("m", "u").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        lowest = _least(down)
        small = down.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lowest.select("u", F.col("m").alias("v"))).distinct()
        last, now = now, stash(small, "edges")
        discard(last)
        found = now.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long"))).first()
        if tuple(found) == mark:
            break
        mark = tuple(found)
    nodes = now.select(F.col("u").alias("doc"), F.col("v").alias("root"))
    return nodes.unionByName(now.select(F.col("v").alias("doc"), F.col("v").alias("root")).distinct())
