"""Density clusters of vectors by Euclidean distance, in any number of dimensions.

Rows near each other are found by an epsilon join: vectors are projected on a few perpendicular
directions and dealt to cells of the projections. A projection never lengthens a distance, so near
vectors lie in the same or in touching cells, and the few directions bound the neighbours of a
cell whatever the width of the vectors. A cell with many vectors is cut into pairs of blocks. Only counts,
stars of local components and the few links of border points leave a task, not the pairs.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetloom import constants as C
from facetloom.operators.components import connected_components
from facetloom.operators.grouped import Columns, each_sorted_group
from facetloom.operators.lookups import lookup
from facetloom.operators.ordering import global_index
from facetloom.session import pin

#: Directions that vectors are projected on, and the side of a cell in radii.
DIRECTIONS = 3
CELL_RADII = 2
#: Vectors in a block, and compared with others at a time.
BLOCK = 4096
STEP = 512
#: Vectors that the directions are fitted on; the result does not depend on them.
SAMPLE = 20_000
#: Slack of the cells for rounding in the projections.
SLACK = 1e-6

_LEFT, _RIGHT, _VISITOR = 0, 1, 2


def near(x: np.ndarray, y: np.ndarray, radius: float) -> np.ndarray:
    """Which rows of two matrices are at most ``radius`` apart.

    Distances come from one product of matrices; where rounding could decide, from the differences.
    """
    xx, yy = (x * x).sum(axis=1), (y * y).sum(axis=1)
    size = xx[:, None] + yy
    squared = size - 2.0 * (x @ y.T)
    limit = radius * radius
    found = squared <= limit
    i, j = np.nonzero(np.abs(squared - limit) <= 1e-9 * (size + limit))
    if len(i):
        found[i, j] = ((x[i] - y[j]) ** 2).sum(axis=1) <= limit
    return found


def local_components(x: np.ndarray, radius: float) -> np.ndarray:
    """For each row of a matrix the first row that it is connected to by steps of ``radius``.

    Rows that were reached are not compared again, so a crowd costs one step.
    """
    first = np.arange(len(x))
    todo = np.arange(len(x))
    while len(todo):
        seed, todo = todo[0], todo[1:]
        frontier = np.array([seed])
        while len(frontier) and len(todo):
            now, frontier = frontier[:STEP], frontier[STEP:]
            reached = near(x[now], x[todo], radius).any(axis=0)
            found, todo = todo[reached], todo[~reached]
            first[found] = seed
            frontier = np.concatenate([frontier, found])
    return first


def _array(df: DataFrame, features: str) -> Column:
    if isinstance(df.schema[features].dataType, T.ArrayType):
        return F.col(features).cast("array<double>")
    return F.when(F.col(features).isNotNull(), vector_to_array(features))


def _directions(nodes: DataFrame) -> np.ndarray:
    """The widest perpendicular directions of a bounded sample, as columns."""
    count = nodes.count()
    share = max(1, -(-count // SAMPLE))
    sample = nodes.where(F.pmod(F.xxhash64("_vector"), F.lit(share)) == 0).select("_vector").limit(2 * SAMPLE)
    rows = [r[0] for r in sample.collect()] or [r[0] for r in nodes.select("_vector").limit(1).collect()]
    x = np.array(rows)
    x = x - x.mean(axis=0)
    _, wide = np.linalg.eigh(x.T @ x)
    return wide[:, ::-1][:, :DIRECTIONS]


def _with_cells(nodes: DataFrame, directions: np.ndarray, radius: float) -> DataFrame:
    """Add ``home``, the cell of a vector, and ``visits``, later touching cells within reach.

    Of two touching cells the vectors of the smaller one visit the other.
    """
    m = directions.shape[1]

    @F.pandas_udf("array<double>")
    def projected(vectors: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack(vectors.to_list()) @ directions))

    reach = radius * (1 + SLACK)
    side = CELL_RADII * reach
    at = [f"_p{i}" for i in range(m)]
    placed = nodes.withColumn("_p", projected("_vector"))
    placed = placed.select("*", *[(F.col("_p")[i] / side).alias(a) for i, a in enumerate(at)])
    cells = [F.floor(a) for a in at]
    inside = [F.col(a) - c for a, c in zip(at, cells, strict=True)]
    visits = []
    for step in product((-1, 0, 1), repeat=m):
        if step <= (0,) * m:
            continue
        gaps = [(1 - f if d > 0 else f) for d, f in zip(step, inside, strict=True) if d]
        squared = sum(((g * side) * (g * side) for g in gaps), F.lit(0.0))
        there = F.array(*[c + F.lit(d) for c, d in zip(cells, step, strict=True)])
        visits.append(F.when(squared <= reach * reach, there))
    return placed.select(
        *nodes.columns, F.array(*cells).alias("home"),
        F.filter(F.array(*visits), lambda v: v.isNotNull()).alias("visits"),
    )


def _in_cells(nodes: DataFrame, *columns: str) -> DataFrame:
    """A row for each cell that a vector is in or visits: ``cell``, ``visitor``."""
    home = F.array(F.struct(F.col("home").alias("cell"), F.lit(False).alias("visitor")))
    visits = F.transform("visits", lambda v: F.struct(v.alias("cell"), F.lit(True).alias("visitor")))
    return nodes.select("node", *columns, F.inline(F.concat(home, visits)))


def _sizes(nodes: DataFrame) -> DataFrame:
    """Blocks of each cell that is some vector's home: own, of visitors (0: they come to the only block)."""
    visitor = F.col("visitor").cast("long")
    sized = _in_cells(nodes).groupBy("cell").agg(
        F.sum(1 - visitor).alias("own"), F.sum(visitor).alias("others")
    ).where("own > 0")
    small = F.col("own") + F.col("others") <= 2 * BLOCK
    return sized.select(
        "cell",
        F.when(small, 1).otherwise(F.ceil(F.col("own") / BLOCK)).cast("long").alias("own_blocks"),
        F.when(small, 0).otherwise(F.ceil(F.col("others") / BLOCK)).cast("long").alias("other_blocks"),
    )


def _dealt(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """Rows of cells dealt to pairs of blocks: ``task, first, second, role``."""
    found = lookup(rows, sizes, ["cell"], "inner", spread_by=["node"])
    own, others = F.col("own_blocks"), F.col("other_blocks")
    mine = F.pmod(F.xxhash64("node"), own)
    theirs = own + F.pmod(F.xxhash64("node"), F.greatest(others, F.lit(1).cast("long")))

    def pair(first: Column, second: Column, role: int) -> Column:
        return F.struct(first.alias("first"), second.alias("second"), F.lit(role).alias("role"))

    none = F.array().cast("array<struct<first: bigint, second: bigint, role: int>>")
    later = F.transform(F.sequence(mine, own + others - 1), lambda b: pair(mine, b, _LEFT))
    before = F.when(
        mine > 0, F.transform(F.sequence(F.lit(0).cast("long"), mine - 1), lambda a: pair(a, mine, _RIGHT))
    ).otherwise(none)
    visited = F.when(others == 0, F.array(pair(F.lit(0).cast("long"), F.lit(0).cast("long"), _VISITOR))).otherwise(
        F.transform(F.sequence(F.lit(0).cast("long"), own - 1), lambda a: pair(a, theirs, _VISITOR))
    )
    tasks = F.when(F.col("visitor"), visited).otherwise(F.concat(later, before))
    keep = [c for c in rows.columns if c not in ("visitor",)]
    each = found.select(*keep, F.inline(tasks))
    return each.withColumn("task", F.xxhash64("cell", "first", "second")).drop("cell")


def _count_near(radius: float):
    """For each vector of a task the weight of the others near it; full ones only count for others."""

    def work(c: Columns) -> Columns:
        x, weight, open_ = c["_vector"], c["weight"], ~c["full"]
        left, right = np.flatnonzero(c["role"] == _LEFT), np.flatnonzero(c["role"] != _LEFT)
        inside = c["first"][0] == c["second"][0]
        total = np.zeros(len(x), dtype=np.int64)

        def add(rows: np.ndarray, others: np.ndarray) -> None:
            for low in range(0, len(rows), STEP):
                some = rows[low : low + STEP]
                total[some] += near(x[some], x[others], radius) @ weight[others]

        if inside:
            mine = left[open_[left]]
            add(mine, left)
            total[mine] -= weight[mine]
        if len(right):
            add(left[open_[left]], right)
            add(right[open_[right]], left)
        said = total > 0
        return {"node": c["node"][said], "near": total[said]}

    return work


def _link_near(radius: float):
    """Stars of the local components of core vectors, and the links of border vectors to core ones."""

    def work(c: Columns) -> Columns:
        core = c["core"].astype(bool)
        nodes, x = c["node"][core], c["_vector"][core]
        first = local_components(x, radius)
        moved = first != np.arange(len(first))
        u, v = [nodes[moved]], [nodes[first[moved]]]
        edge = np.flatnonzero(~core)
        for low in range(0, len(edge), STEP):
            some = edge[low : low + STEP]
            i, j = np.nonzero(near(c["_vector"][some], x, radius))
            u.append(c["node"][some[i]])
            v.append(nodes[j])
        border = np.zeros(sum(map(len, u)), dtype=bool)
        border[len(u[0]) :] = True
        return {"u": np.concatenate(u), "v": np.concatenate(v), "border": border}

    return work


def _core_nodes(nodes: DataFrame, sizes: DataFrame, radius: float, min_points: int) -> DataFrame:
    """Nodes with at least ``min_points`` rows within the radius, themselves included.

    Blocks are first compared with themselves. Vectors that have their points then are full and
    not counted again; only cells with several blocks and a vector that is not full are compared across blocks.
    """
    said = "node long, near long"
    counted = _count_near(radius)
    start = nodes.withColumn("full", F.col("weight") >= min_points)
    dealt = _dealt(_in_cells(start, "weight", "full", "_vector"), sizes)
    own = pin(
        each_sorted_group(dealt.where("first = second"), "task", counted, said)
        .groupBy("node").agg(F.sum("near").alias("near"))
    )
    many = pin(sizes.where("own_blocks > 1 OR other_blocks > 0"))
    found = own
    if not many.isEmpty():
        known = lookup(start.drop("full"), own, ["node"], "left").withColumn(
            "full", F.col("weight") + F.coalesce("near", F.lit(0)) >= min_points
        ).drop("near")
        known = pin(known)
        opened = _in_cells(known.where("NOT full")).select("cell").distinct().join(many, "cell")
        across = _dealt(_in_cells(known, "weight", "full", "_vector"), pin(opened)).where("first < second")
        found = own.unionByName(each_sorted_group(across, "task", counted, said))
    near_ = found.groupBy("node").agg(F.sum("near").alias("near"))
    return (
        lookup(nodes.select("node", "weight"), near_, ["node"], "left", pinned=True)
        .where(F.col("weight") + F.coalesce("near", F.lit(0)) >= min_points)
        .select("node", F.lit(True).alias("core"))
    )


def distance_clusters(
    df: DataFrame,
    radius: float,
    min_points: int = 5,
    min_size: int = C.DENSITY_MIN_SIZE,
    features: str = "reduced",
    row_id: str | None = "row_id",
    out: str = "cluster",
) -> DataFrame:
    """Add density clusters of the vectors in ``features``; noise is -1.

    A row is a core row if at least ``min_points`` rows, itself included, are at most ``radius`` away.
    Core rows that near form a cluster, through any number of steps. Another row next to a core row
    joins the cluster of those it touches whose smallest core ``row_id`` is least. Clusters below
    ``min_size`` rows are noise, the others are numbered from 0 by that id. Null vectors, and those
    with a component that is no finite number, are noise; all others have the same width. Without a
    ``row_id``, clusters go by a hash of their vectors.

    Equal vectors are one node with a weight, so copies are never compared.
    """
    if not radius > 0:
        raise ValueError("the radius must be positive")
    rows = df.withColumn("_vector", _array(df, features))
    usable = F.coalesce(
        F.forall("_vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False)
    )
    rows = rows.withColumn("_vector", F.when(usable, F.col("_vector")))
    equal = pin(
        rows.where("_vector IS NOT NULL").groupBy("_vector")
        .agg(F.count(F.lit(1)).alias("weight"), F.min(row_id or F.xxhash64("_vector")).alias("first_row"))
    )
    if equal.isEmpty():
        return df.withColumn(out, F.lit(-1))
    named = equal.withColumn("node", F.monotonically_increasing_id())
    nodes = pin(_with_cells(named, _directions(equal), radius))
    sizes = pin(_sizes(nodes))

    core = pin(_core_nodes(nodes, sizes, radius, min_points))
    marked = pin(
        lookup(nodes, core, ["node"], "left").withColumn("core", F.coalesce("core", F.lit(False)))
    )
    dealt = _dealt(_in_cells(marked, "core", "_vector"), sizes)
    links = pin(each_sorted_group(dealt, "task", _link_near(radius), "u long, v long, border boolean"))

    itself = core.select(F.col("node").alias("u"), F.col("node").alias("v"))
    parts = connected_components(links.where("NOT border").select("u", "v").unionByName(itself))
    begun = lookup(parts, nodes.select("node", "first_row"), ["node"], "inner")
    least = begun.groupBy("component").agg(F.min("first_row").alias("label"))
    labels = pin(lookup(parts, least, ["component"], "inner", spread_by=["node"], pinned=True).select("node", "label"))
    touched = lookup(
        links.where("border").select(F.col("u"), F.col("v").alias("node")), labels, ["node"], "inner", spread_by=["u"]
    )
    border = touched.groupBy(F.col("u").alias("node")).agg(F.min("label").alias("label"))
    placed = pin(
        lookup(labels.unionByName(border), nodes.select("node", "weight", "_vector"), ["node"], "inner")
    )
    kept = placed.groupBy("label").agg(F.sum("weight").alias("size")).where(F.col("size") >= min_size)
    numbered = global_index(kept.select("label"), ["label"], "_number")
    final = lookup(placed, numbered, ["label"], "inner", spread_by=["node"], pinned=True).select(
        "_vector", F.col("_number").cast("int").alias("_cluster")
    )
    joined = lookup(rows, final, ["_vector"], "left", spread_by=[row_id or "_vector"], pinned=True)
    return joined.select(
        *[F.col(f"`{c}`") for c in df.columns if c != out], F.coalesce("_cluster", F.lit(-1)).alias(out)
    )
