"""Persona cards as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetloom.schemas import RUN_SUMMARY


def write_cards(summary: DataFrame, path: str) -> None:
    """Write the one-row run summary."""
    summary.write.mode("overwrite").json(path, ignoreNullFields=False)


def read_cards(spark: SparkSession, path: str) -> DataFrame:
    """``persona_id`` (text) and the card fields; ValueError without ``personas``."""
    summary = spark.read.schema(RUN_SUMMARY).json(path, multiLine=True)
    if summary.where(F.col("personas").isNotNull()).isEmpty():
        raise ValueError(f"no personas in {path}")
    return summary.select(F.explode("personas").alias("persona_id", "card")).select(
        "persona_id", "card.*"
    )
