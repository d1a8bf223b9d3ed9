"""Connected components of an edge list by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeatlas.llm.common import written


def connected_components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(id, root) of every id in edges (a, b); root is the smallest id of the component.

    Each round points every node's neighbours at the smallest of them, first the larger ones, then
    the smaller ones; edges shrink to stars in a number of rounds that grows with the logarithm of
    the component. Each round is a written table. Self-loops and repeats do no harm.
    """
    now = written(spark, edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select("u", "v", "m")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        after = written(spark, small, "edges")
        changed = after.join(now, ["u", "v"], "left_anti").limit(1).count() or now.join(after, ["u", "v"], "left_anti").limit(1).count()
        now = after
        if not changed:
            break
    return now.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("root"))).distinct()
