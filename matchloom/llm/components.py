"""Connected components of links that no single machine could hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import Scratch, written


def connected_components(links: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(id, component) of every id in links (a, b): the least id that its links reach.

    Alternates large-star and small-star: each id's greater neighbours, then its lesser ones and itself, are linked to the least one. A star's
    rows are as many as the links, the least of a group is found by a combined aggregation, and a popular id is a join key whose
    partition Spark can split. Each round ends in a written table; it needs about log(n) rounds. Null ids and links of an id to itself say nothing."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    edges = written(edges, "links", scratch)
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        edges = written(small, "links", scratch)
        state = edges.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
        if state == before:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        before = state
