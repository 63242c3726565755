"""Clusters of feature vectors and the choice of their number."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import product

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetloom import constants as C
from facetloom.operators.kmeans import Centres, fit_many
from facetloom.operators.lookups import lookup
from facetloom.operators.ordering import global_index
from facetloom.session import pin


def kmeans(
    df: DataFrame,
    k: int = C.MAP_CLUSTERS,
    features: str = "reduced",
    out: str = "cluster",
    seed: int = 42,
) -> DataFrame:
    """Add the K-means cluster of each row."""
    return fit_kmeans(df, k, features, out, seed).transform(df)


def fit_kmeans(
    df: DataFrame, k: int = C.MAP_CLUSTERS, features: str = "reduced", out: str = "cluster", seed: int = 42
) -> KMeansModel:
    """The K-means model of the rows."""
    return KMeans(k=k, seed=seed, featuresCol=features, predictionCol=out).fit(df)


def silhouette(df: DataFrame, features: str = "features", cluster: str = "cluster") -> float:
    """Mean silhouette by squared Euclidean distance; linear in the rows."""
    return ClusteringEvaluator(
        featuresCol=features, predictionCol=cluster, distanceMeasure="squaredEuclidean"
    ).evaluate(df)


@dataclass(frozen=True)
class ChosenK:
    """The winning model, its silhouette, and (k, silhouette) of all k tried."""

    k: int
    score: float
    model: Centres
    tried: tuple[tuple[int, float], ...]


def choose_k(
    df: DataFrame,
    kmax: int = 10,
    restarts: int = 10,
    features: str = "features",
    out: str = "persona_id",
    seed: int = 42,
) -> ChosenK:
    """Fit each k from 2 to ``kmax`` and keep the one with the best silhouette.

    Each k takes the restart with the least cost. The smallest k wins ties; a k whose
    rows fall into one cluster is passed over; k = 2 with score -1 is the last resort.
    All models of all k share each pass over the rows.
    """
    ks = list(range(2, max(3, kmax + 1)))
    fits = fit_many(df, ks, restarts, features, seed)
    if not fits:
        raise ValueError("there is no vector to cluster")
    tried = tuple((k, fits[k][3]) for k in ks if fits[k][2] > 1)
    k, score = max(tried, key=lambda t: (t[1], -t[0]), default=(2, -1.0))
    if score <= -1.0:
        k, score = 2, -1.0
    return ChosenK(k, score, Centres(fits[k][0], features, out), tried)


def assign_personas(df: DataFrame, chosen: ChosenK) -> DataFrame:
    """Add ``persona_id`` by the chosen model."""
    return chosen.model.transform(df)


def density_clusters(
    df: DataFrame,
    coordinates: Sequence[str],
    eps: float,
    min_points: int = 5,
    min_size: int = C.DENSITY_MIN_SIZE,
    out: str = "cluster",
    spread_by: Sequence[str] = (),
) -> DataFrame:
    """Add density clusters over a few coordinates, such as ``x2d, y2d``; noise is -1.

    Space is cut into cells of side ``eps``. A cell is dense if it and its neighbours hold
    ``min_points`` rows or more; dense neighbour cells form a cluster, and a cell next to
    a dense one joins the lowest cluster it touches. Clusters below ``min_size`` rows are
    noise, the others are numbered from 0 by their first cell.

    Rows are only counted per cell and joined to their cell once. All comparing is among
    cells, over the fixed set of neighbour offsets, so a crowded spot costs no more than
    an empty one and no pairs of rows are made. ``spread_by`` may name a row id, by which
    rows of a crowded cell are spread in the last join.
    """
    axes = [f"_c{i}" for i in range(len(coordinates))]
    known = F.lit(True)
    for c in coordinates:
        known = known & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    celled = df.select(
        "*",
        *[
            F.when(known, F.floor(F.col(c) / F.lit(eps))).alias(a)
            for c, a in zip(coordinates, axes, strict=True)
        ],
    )
    cells = pin(
        celled.where(F.col(axes[0]).isNotNull())
        .groupBy(*axes)
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    cell_id = F.struct(*[F.col(a) for a in axes])
    steps = list(product((-1, 0, 1), repeat=len(axes)))
    around = F.array(
        *[
            F.struct(*[(F.col(a) + F.lit(d)).alias(a) for a, d in zip(axes, step, strict=True)])
            for step in steps
        ]
    )
    # Each cell tells its 3^dims neighbours about itself; only cells that exist listen.
    told = cells.select(cell_id.alias("source"), "rows", F.explode(around).alias("cell"))
    present = cells.select(cell_id.alias("cell"))
    links = told.join(present, "cell")
    density = links.groupBy("cell").agg(F.sum("rows").alias("near"))
    dense = density.where(F.col("near") >= min_points).select("cell")
    edges = pin(
        links.select("source", "cell")
        .join(dense, "cell")
        .join(dense.withColumnRenamed("cell", "source"), "source")
    )
    label = dense.withColumn("label", F.col("cell"))
    while True:
        lowest = pin(
            edges.join(label.withColumnRenamed("cell", "source"), "source")
            .groupBy("cell")
            .agg(F.min("label").alias("label"))
        )
        # Jump: take over the label of the cell that the label points to.
        jumped = lowest.alias("a").join(
            lowest.select(F.col("cell").alias("label"), F.col("label").alias("further")), "label"
        )
        following = pin(jumped.select("cell", F.least("label", "further").alias("label")))
        changed = (
            following.alias("n")
            .join(label.alias("o"), "cell")
            .where(F.col("n.label") != F.col("o.label"))
        )
        settled = changed.isEmpty()
        label = following
        if settled:
            break
    border = (
        links.select("source", "cell")
        .join(label.select(F.col("cell").alias("source"), "label"), "source")
        .groupBy("cell")
        .agg(F.min("label").alias("label"))
    )
    home = border.alias("b").join(label.alias("l"), "cell", "left").select(
        "cell", F.coalesce("l.label", "b.label").alias("label")
    )
    sized = home.join(cells.select(cell_id.alias("cell"), "rows"), "cell")
    kept = (
        sized.groupBy("label")
        .agg(F.sum("rows").alias("size"))
        .where(F.col("size") >= min_size)
        .select("label")
    )
    numbered = global_index(kept, ["label"], "_number")
    final = sized.join(numbered, "label").select(
        *[F.col(f"cell.{a}").alias(a) for a in axes], F.col("_number").cast("int").alias(out)
    )
    joined = lookup(celled, final, axes, "left", spread_by=[*spread_by, *coordinates])
    return joined.select(*df.columns, F.coalesce(F.col(out), F.lit(-1)).alias(out))
