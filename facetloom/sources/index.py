"""Vector tables, one folder per persona."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetloom.functions.numeric import l2_normalize
from facetloom.operators.scoring import embed


def build_index(
    df: DataFrame,
    encoder: PipelineModel | Callable | None = None,
    text: str = "text",
    vector: str = "vector",
    persona: str = "persona_id",
) -> DataFrame:
    """Rows with a persona and their unit vector.

    The encoder makes the vector from the text (a missing text is empty); without one the
    given vector column is scaled to length one.
    """
    rows = df.where(F.col(persona).isNotNull())
    if encoder is not None:
        return embed(rows, text, encoder, vector)
    return rows.withColumn(vector, l2_normalize(F.col(vector)))


def write_persona_index(index: DataFrame, path: str, persona: str = "persona_id") -> None:
    """Write the index partitioned by persona, so that a search reads one folder.

    Rebalancing gives each persona files of a good size, and the largest many of them.
    """
    even = index.hint("rebalance", persona)
    even.write.mode("overwrite").partitionBy(persona).parquet(path)


def read_persona_index(
    spark: SparkSession, path: str, persona_id: int | None = None, persona: str = "persona_id"
) -> DataFrame:
    """The index, or one persona of it; FileNotFoundError for a persona it lacks."""
    index = spark.read.parquet(path)
    if persona_id is None:
        return index
    one = index.where(F.col(persona) == persona_id)
    if one.select(persona).isEmpty():
        raise FileNotFoundError(f"no index for persona {persona_id} in {path}")
    return one
