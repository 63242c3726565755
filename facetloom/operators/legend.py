"""Cluster colours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetloom.operators.lookups import lookup
from facetloom.operators.ordering import global_index
from facetloom.operators.profiles import cluster_sizes
from facetloom.palette import CLUSTER_PALETTE, NAMED_COLORS, NOISE_COLOR


def _rgb(code: str) -> str:
    red, green, blue = (int(code[i : i + 2], 16) for i in (0, 2, 4))
    return f"named_struct('r', {red}, 'g', {green}, 'b', {blue})"


def nearest_color_name(color: str) -> Column:
    """The named colour closest to an RGB struct column; the first of equals in name order."""
    names = ", ".join(
        f"named_struct('at', {i}, 'name', '{name}', 'c', {_rgb(code)})"
        for i, (name, code) in enumerate(NAMED_COLORS)
    )
    gap = " + ".join(f"(n.c.{p} - {color}.{p}) * (n.c.{p} - {color}.{p})" for p in "rgb")
    return F.expr(
        f"array_min(transform(array({names}), n -> named_struct('gap', {gap}, 'at', n.at,"
        " 'name', n.name))).name"
    )


def cluster_legend(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    """``cluster, count, color_name``: palette colours in cluster order, noise (-1) grey.

    The palette starts again after 20 clusters.
    """
    sizes = cluster_sizes(df.where(F.col(cluster).isNotNull()), cluster)
    noise = F.col(cluster) == -1
    # Noise sorts last, so it uses up no colour.
    placed = global_index(sizes, [noise.cast("int"), F.col(cluster)], "_at")
    palette = F.expr(f"array({', '.join(_rgb(code) for code in CLUSTER_PALETTE)})")
    turn = (F.col("_at") % F.lit(len(CLUSTER_PALETTE))).cast("int")
    color = F.when(noise, F.expr(_rgb(NOISE_COLOR))).otherwise(F.get(palette, turn))
    colored = placed.withColumn("_color", color)
    return colored.select(cluster, "count", nearest_color_name("_color").alias("color_name"))


def add_cluster_colors(
    df: DataFrame, legend: DataFrame, cluster: str = "cluster", out: str = "cluster_color_name"
) -> DataFrame:
    """Add the legend colour of each row's cluster."""
    names = legend.select(cluster, F.col("color_name").alias(out))
    return lookup(df, names, [cluster], "left")
