"""Connected components of a link table, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(links: DataFrame, rounds: int = 50) -> DataFrame:
    """node, component (its smallest reachable node) for every node of links(a, b), numbers or structs of them.

    Repeated links and links of a node with itself count for nothing, as do links with a null end; no links, no rows.

    Alternating large and small stars (Kiveris et al. 2014): each round points neighbours at the
    smallest known node. Neighbourhoods are only ever reduced to their minimum, so a node with any
    number of links is no burden for one task. Rounds are written to the shared folder.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())

    def state(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()

    before = state(edges)
    for _ in range(rounds):
        if not before[0]:
            break
        both = edges.union(edges.select("v", "u"))
        small = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(small, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        edges = materialize(large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m"))).distinct())
        now = state(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle; raise rounds")
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))
