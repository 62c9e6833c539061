"""Connected components of a distributed link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelumen.llm.common import PART_ROWS, cut_few, shuffle_partitions


def state_of(edges: DataFrame) -> tuple:
    """The number of links and the sum of their hashes."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(links: DataFrame, left: str = "a", right: str = "b", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``links``; component is the smallest node that can be reached.

    Alternating large-star and small-star rounds: each round only groups and joins the links on a node, so links stay
    distributed, and each round's links are checkpointed, in a few parts for each core (one where they are few). A round deals
    links out by node in as many partitions as their number asks for, not all shuffle partitions: rounds are many, and the
    driver keeps what it knows of every task. The rounds needed grow with the logarithm of the longest chain. Loops and
    links with a null end are ignored; repeated and reversed links count once; no links give no rows.
    """
    edges = links.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))
    edges = cut_few(edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").distinct())
    seen = state_of(edges)
    spark = edges.sparkSession
    for _ in range(max_rounds):
        parts = min(shuffle_partitions(spark), max(spark.sparkContext.defaultParallelism, -(-2 * seen[0] // PART_ROWS)))
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).repartition(parts, "u")
        smallest = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(smallest, "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).repartition(parts, "u").distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(smallest, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut_few(small.union(smallest.select("u", F.col("m").alias("v"))).distinct(), seen[0])
        state = state_of(edges)
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    centres = edges.select("v").distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(centres.select(F.col("v").alias("node"), F.col("v").alias("component")))
