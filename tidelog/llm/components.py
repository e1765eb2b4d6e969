"""Connected components of a graph of links, as a sequence of joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import keep


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(spark: SparkSession, edges: DataFrame, path: str) -> DataFrame:
    """`edges` (u, v: long) to stars (node, root), root being the smallest node of the component, itself included.

    Alternates large-star and small-star steps until nothing changes. Each step aggregates before it shuffles;
    joins on a node with very many links are left to the skew handling of adaptive execution. Every round is
    written to the shared folder.
    """
    now = keep(spark, edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{path}/round=0")
    state, number = _state(now), 0
    while state[0]:
        number += 1
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = keep(spark, small.filter("u <> v").distinct(), f"{path}/round={number}")
        before, state = state, _state(now)
        if state == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
