"""Connected components of a link table, without gathering links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardpanel.llm.common import stage


def _lowest(links: DataFrame) -> DataFrame:
    """(u, v, m): both directions of every link, with the smallest neighbour of u (or u itself)."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    return both.join(least.hint("merge"), F.col("u") == F.col("k")).select("u", "v", "m")


def _mark(links: DataFrame):
    return links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()


def components(links: DataFrame, first: str, second: str) -> DataFrame:
    """(node, component): the smallest node reachable over links; nodes without a link are left out.

    Alternating star contraction: every round hangs larger neighbours, then smaller ones, on the smallest node in sight,
    until nothing changes.  Each round is staged, so a lost executor costs one round at most.
    """
    now = stage(links.select(F.greatest(first, second).alias("u"), F.least(first, second).alias("v")).where("u > v").distinct())
    mark = _mark(now)
    while mark[0]:
        large = _lowest(now).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        large = stage(large)
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        joined = large.join(least.hint("merge"), F.col("u") == F.col("k"))
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("k").alias("u"), F.col("m").alias("v")))
        now = stage(small.where("u > v").distinct())
        before, mark = mark, _mark(now)
        if before == mark:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
