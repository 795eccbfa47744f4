"""Connected components of a table of edges, with no step that depends on the size of one component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmweave.session import staged


def components(edges: DataFrame) -> DataFrame:
    """``u``, ``root`` for every node of ``edges`` (u, v) that isn't the smallest of its component, which is the root.

    Alternating large and small stars. Minima are combined before the shuffle and joined back, so that a node with
    very many neighbours is only a skewed join key. Each round is written to the shared folder.
    """
    now = staged(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        now = staged(small.select("u", F.col("m").alias("v")).union(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct())
        state = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if state == before:
            return now.withColumnRenamed("v", "root")
        before = state
