"""Connected components of a large graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetloom.operators.lookups import lookup
from facetloom.session import pin


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("_least"))
    found = lookup(both.where("v > u"), least, ["u"], "inner", spread_by=["v"], pinned=True)
    return found.select(F.col("v").alias("u"), F.least("_least", "u").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v")
    least = down.groupBy("u").agg(F.min("v").alias("_least"))
    found = lookup(down, least, ["u"], "inner", spread_by=["v"], pinned=True)
    stars = found.where("v > _least").select(F.col("v").alias("u"), F.col("_least").alias("v"))
    return stars.unionByName(least.select("u", F.col("_least").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of the edges ``u, v`` (whole numbers); the smallest node names a component.

    Alternates large and small stars (Kiveris et al., 2014) until the edges stay as they are: then
    every node is linked to the smallest one it can reach. Rounds grow with the logarithm of the
    nodes, not with the longest path. Each round is written, so lineage stays short.
    """

    def state(table: DataFrame) -> tuple:
        return tuple(
            table.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        )

    plain = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"))
    alone = plain.where("u = v").select("u").distinct()
    links = pin(plain.where("u != v").distinct())
    seen = state(links)
    while seen[0]:
        links = pin(_small_star(_large_star(links)))
        now = state(links)
        if now == seen:
            break
        seen = now
    linked = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    known = linked.unionByName(roots)
    apart = alone.join(known, alone["u"] == known["node"], "left_anti")
    return known.unionByName(apart.select(F.col("u").alias("node"), F.col("u").alias("component")))
