"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Work, joined_by_size


def components(links: DataFrame, work: Work, name: str = "components") -> DataFrame:
    """links (a, b) to one row (id, component) for each linked id: component is the smallest id reachable.

    Each step sends every id's larger, then smaller neighbours to the least neighbour. Minima are
    taken by partial aggregation; those of ids with more than one in HOT of the links are broadcast
    (fewer than HOT of them at any size), so an id with very many links costs no single task. Steps
    end when the links no longer change; each is written to the shared folder.
    """
    now = work.table(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), f"{name}-0")
    step, before = 0, None
    while True:
        sums = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sums[0] == 0 or sums == before:
            break
        before = sums
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count(F.when(F.col("v") > F.col("u"), 1)).alias("size"))
        large = joined_by_size(both.filter("v > u"), least, "u", "size", sums[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        large = work.table(large, f"{name}-{step}-large")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("size"))
        joined = joined_by_size(large, least, "u", "size", sums[0])
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
        step += 1
        after = work.table(small.filter("u > v").distinct(), f"{name}-{step}")
        work.drop(f"{name}-{step - 1}", f"{name}-{step - 1}-large")
        now = after
    members = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return members.unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
