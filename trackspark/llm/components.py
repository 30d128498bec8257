"""Connected components of a table of links, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import staged


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """node and component (the least node reachable) for each node of ``links``.

    Alternates large stars and small stars: each round points every neighbour at the least one around, until no
    link changes. Rounds grow with the logarithm of the component, rows stay about the number of links.
    """
    edges = staged(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = both.join(least, "u").where("v > u and v <> low").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        large = large.where("u <> v")
        down = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(down, "u").select(F.when(F.col("v") == F.col("low"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("low").alias("v")).where("u <> v").distinct()
        after = staged(small, "edges")
        same = [x.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).collect()[0] for x in (edges, after)]
        edges = after
        if same[0] == same[1]:
            break
    nodes = edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    return nodes.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
