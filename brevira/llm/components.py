"""Connected components of an edge table by alternating large-star and small-star steps, all in Spark.

Every step is a pre-aggregated minimum per node and a join of it back to the edges, so a node with very many
edges is reduced map-side and its join is split by skew handling; each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, stash


def _stats(e: DataFrame) -> tuple:
    r = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(r)


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``edges`` (u, v); comp is the least node of the component. Edges with equal
    ends or nulls are ignored; no edges give no rows."""
    e = stash(spark, edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    before = _stats(e)
    while before[0]:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: every larger neighbour is hung under the least node around u
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: the smaller neighbours of u, and u, go under the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        new = stash(spark, small, "cc")
        now = _stats(new)
        discard(e)
        e = new
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
