"""Enriched rows to a cluster map, cluster profiles, personas and their cards."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from facetloom import constants as C
from facetloom.operators import clustering, profiles, ranking
from facetloom.operators.cards import persona_cards, run_summary
from facetloom.operators.columns import ensure_columns, select_categoricals, select_numerics
from facetloom.operators.density import distance_clusters
from facetloom.operators.features import (
    feature_blocks,
    persona_features,
    project_2d,
    reduce_pca,
)
from facetloom.operators.legend import add_cluster_colors, cluster_legend
from facetloom.operators.ordering import limit_then_filter
from facetloom.operators.scoring import embed
from facetloom.operators.terms import fit_tfidf
from facetloom.schemas import CLUSTERED
from facetloom.session import pin


def map_clusters(
    df: DataFrame,
    encoder: PipelineModel | Callable,
    k: int = C.MAP_CLUSTERS,
    limit: int | None = None,
    row_id: str = "row_id",
    dimensions: int = C.MAP_DIMENSIONS,
    keep: Sequence[str] = (),
    density: float | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The clustered table and its legend, from the rows of the cohort.

    ``limit`` takes the first rows before the cohort filter. ``keep`` names further
    columns to carry, such as the row id. With ``density``, a radius, density clusters of the
    reduced vectors take the place of the ``k`` clusters; noise is -1.
    """
    first = limit_then_filter(df, limit, row_id) if limit else df
    if not limit and "is_genz" in df.columns:
        first = df.where(F.col("is_genz") == 1)
    # Several passes follow; the encoder runs once.
    vectors = pin(embed(first, "text", encoder, "_vector"))
    blocks = feature_blocks(vectors, "_vector").drop("_vector")
    reduced = reduce_pca(blocks, dimensions).drop("features")
    if density is None:
        # Many passes go over the vectors alone; the rows with their texts are read once, for the result.
        narrow = reduced.select("reduced").persist(StorageLevel.DISK_ONLY)
        model = clustering.fit_kmeans(narrow, k)
        placed = project_2d(model.transform(reduced), of=narrow)
        legend = cluster_legend(model.transform(narrow))
    else:
        reduced = reduced.persist(StorageLevel.DISK_ONLY)
        known = row_id if row_id in reduced.columns else None
        placed = project_2d(distance_clusters(reduced, density, row_id=known))
        legend = cluster_legend(placed)
    colored = add_cluster_colors(placed, legend)
    table = ensure_columns(colored, CLUSTERED)
    if keep:
        table = colored.select(
            *[F.col(c) for c in keep],
            *[
                (F.col(f.name) if f.name in colored.columns else F.lit(None))
                .cast(f.dataType)
                .alias(f.name)
                for f in CLUSTERED.fields
            ],
        )
    return table, legend


@dataclass(frozen=True)
class ClusterProfiles:
    """Profile tables of a clustered table."""

    sizes: DataFrame
    values: DataFrame
    tests: DataFrame
    numbers: DataFrame | None


def profile_clusters(
    df: DataFrame,
    cluster: str = "cluster",
    max_cardinality: int | None = None,
    zeros: bool = False,
) -> ClusterProfiles:
    """Sizes, value percentages, tests and numeric summaries of every cluster.

    ``zeros`` also lists the values that a cluster lacks. The crosstab is counted once for percentages and tests.
    """
    categories = select_categoricals(df, cluster, max_cardinality=max_cardinality)
    numbers = select_numerics(df, cluster)
    cells = pin(profiles.crosstab(df, categories, cluster)) if categories else None
    return ClusterProfiles(
        profiles.cluster_sizes(df, cluster).orderBy(cluster),
        profiles.order_profiles(profiles.value_profiles(df, categories, cluster, zeros, cells)),
        profiles.order_tests(profiles.chi_square(df, categories, cluster, cells)),
        profiles.numeric_summary(df, numbers, cluster).orderBy("cluster") if numbers else None,
    )


@dataclass(frozen=True)
class PersonaRun:
    """Assignments (the given columns and ``persona_id``), cards and the run summary."""

    assignments: DataFrame
    cards: DataFrame
    summary: DataFrame


def discover_personas(
    df: DataFrame,
    source: str,
    row_id: str = "row_id",
    text: str = "text",
    kmax: int = 10,
    min_df: int = 1,
    restarts: int = 10,
    trees: int = 250,
    repeats: int = 8,
) -> PersonaRun:
    """Personas of a clustered table, with cards and feature rankings."""
    featured, names = persona_features(df, text, min_df=min_df)
    featured = featured.persist(StorageLevel.MEMORY_AND_DISK)
    chosen = clustering.choose_k(featured, kmax, restarts)
    assigned = clustering.assign_personas(featured, chosen)
    cards = persona_cards(assigned, fit_tfidf(df, text, min_df=min_df), row_id=row_id)
    information = ranking.vector_information(assigned, names)
    importance = ranking.permutation_importance(
        assigned, names, row_id=row_id, trees=trees, repeats=repeats
    )
    summary = run_summary(cards, source, chosen.score, information, importance)
    return PersonaRun(assigned.select(*df.columns, "persona_id"), cards, summary)
