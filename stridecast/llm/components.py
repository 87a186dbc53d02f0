"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridecast.llm.common import ensure_checkpoint_dir


def connected_components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """node, component (the smallest node reachable) for every node that has a link; a self link or a null has no effect.

    Each round replaces the links by stars around smaller nodes, which keeps the components and needs about log n
    rounds; a round is two aggregations and two joins by node and ends in a checkpoint, so that lost executors only
    cost the round. The minimum is aggregated before the join, so the links of a node are never gathered in one row; those of
    a node with very many links meet it in one sorted run, which Spark's adaptive plan may split. Joins are merges, also of small
    tables: a broadcast takes some megabytes of the driver, and there would be two a round.
    """
    ensure_checkpoint_dir(links.sparkSession)
    edges = links.select(F.least(a, b).alias("low"), F.greatest(a, b).alias("high"))
    edges = edges.filter(F.col("low") < F.col("high")).distinct().checkpoint()
    for _ in range(most_rounds):
        both = edges.select(F.col("low").alias("u"), F.col("high").alias("v")).union(edges.select(F.col("high").alias("u"), F.col("low").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = edges.withColumnRenamed("low", "u").join(least.hint("merge"), "u").select("high", F.col("m").alias("low")).distinct()
        least = large.groupBy("high").agg(F.min("low").alias("m"))
        small = large.join(least.hint("merge"), "high")
        small = small.select(F.col("m").alias("low"), "high").union(small.select(F.col("m").alias("low"), F.col("low").alias("high")))
        edges = small.filter(F.col("low") < F.col("high")).distinct().checkpoint()
        # done when no node has two smaller ones and none is both a smaller and a larger one
        ends = edges.select(F.col("high").alias("u"), F.lit(1).alias("ups"), F.lit(0).alias("downs")).union(edges.select("low", F.lit(0), F.lit(1)))
        ends = ends.groupBy("u").agg(F.sum("ups").alias("ups"), F.max("downs").alias("downs"))
        if ends.filter((F.col("ups") > 1) | (F.col("ups") > 0) & (F.col("downs") > 0)).isEmpty():
            break
    else:
        raise RuntimeError(f"components still changed after {most_rounds} rounds")
    return edges.select(F.col("high").alias("node"), F.col("low").alias("component")).union(edges.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct())
