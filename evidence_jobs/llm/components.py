"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidence_jobs.llm.common import saved


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for edges (a, b) of longs: the smallest node that links reach.

    Large-star and small-star steps turn by turn, until nothing changes: each hooks a
    node's neighbours to the smallest one, so a chain of n links takes about log n
    rounds. Steps are joins and minimums by node; the edges never leave the executors.
    """
    now = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    sign = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = None
    while (after := sign(now)) != before:
        before = after
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
        now = saved(small.select("e.u", F.col("e.m").alias("v")).where("u <> v").distinct())
    out = now.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return saved(out.unionByName(out.select(F.col("component").alias("node"), "component").distinct()))
