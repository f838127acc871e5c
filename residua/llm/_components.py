"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residua.llm._common import durable, let_go


def components(edges: DataFrame) -> DataFrame:
    """Edges (a long, b long) to rows (node, component) for every node that has an edge to another; component is the smallest node reachable.

    Self loops, repeated and null edges do not count; no edges give no rows. Each round is two aggregations and two
    joins on node keys, so no adjacency list or whole component meets in one row; the least neighbours are kept as
    tables, so that AQE can split the joins at a node that many others hang on. The number of rounds grows with the logarithm of the longest path.
    """
    a, b = F.col("a"), F.col("b")
    now = durable(edges.where(a != b).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct())
    before = None
    while (state := now.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())[0] and tuple(state) != before:
        before = tuple(state)
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = durable(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = durable(both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct())
        parent = durable(large.groupBy("hi").agg(F.min("lo").alias("m")))
        joined = large.join(parent, "hi")
        small = parent.select("hi", F.col("m").alias("lo")).unionByName(joined.where("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")))
        after = durable(small.distinct())
        let_go(now, least, large, parent)
        now = after
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(now.select(F.col("lo").alias("node"), F.col("lo").alias("component"))).distinct()
