"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.shared import cut


def components(links: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) of every node of ``links`` (a long, b long).

    Each step is a minimum per node and a join with it, so a hub of any degree is pre-aggregated and its join can be
    split; a few steps suffice for long chains too. Links to oneself or to null say nothing.
    """
    edges = cut(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == state:
            break
        state = now
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
        # every larger neighbour of a node points to the least of its neighbourhood
        large = (both.join(least, "a").filter(F.col("b") > F.col("a"))
                 .select(F.col("b").alias("a"), F.col("least").alias("b")).filter("a <> b").distinct())
        # a node and its smaller neighbours point to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("least"))
        small = (large.join(low, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
                 .union(low.select("a", "least")).filter("a <> b").distinct())
        edges = cut(small)
    return (edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
            .union(edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct())
