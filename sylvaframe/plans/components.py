"""Connected components by alternating star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import shuffled, written


def components(links: DataFrame) -> DataFrame:
    """(node, root): root is the smallest node of the connected component, for every node that has a link. Columns of links: a, b.

    Alternating large-star and small-star rounds; each is written, so that a lost executor costs one round at most."""
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(shuffled(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(shuffled(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        after = written(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "links")
        # Stars can't change any more: no node has two roots, or is a root and a leaf at once.
        ends = after.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("leaf"), F.lit(0).alias("root")), F.struct(F.col("v").alias("node"), F.lit(0).alias("leaf"), F.lit(1).alias("root")))).alias("e")).select("e.*")
        if ends.groupBy("node").agg(F.sum("leaf").alias("leaf"), F.max("root").alias("root")).filter("leaf > 1 or leaf = 1 and root = 1").isEmpty():
            return after.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(after.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        edges = after
