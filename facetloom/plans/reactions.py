"""Persona rows to an index, query texts to match records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from facetloom import constants as C
from facetloom.operators.matching import match_records
from facetloom.operators.scoring import Model, embed
from facetloom.sources.cards import read_cards
from facetloom.sources.index import build_index, read_persona_index, write_persona_index


def build_and_save(
    df: DataFrame, encoder: PipelineModel | Callable[[], Model], path: str
) -> None:
    """Embed the rows of every persona and write their index."""
    write_persona_index(build_index(df, encoder), path)


def react(
    spark: SparkSession,
    text: str,
    index_path: str,
    cards_path: str,
    encoder: PipelineModel | Callable[[], Model],
    persona_id: int = C.DEFAULT_PERSONA,
    threshold: float = C.SIMILARITY_MIN,
    make_generator: Callable[[], Model] | None = None,
) -> DataFrame:
    """The match record of one text against one persona; an unknown persona is an error."""
    cards = read_cards(spark, cards_path)
    index = read_persona_index(spark, index_path, persona_id)
    asked = spark.createDataFrame(
        [(0, text, persona_id)], "query_id bigint, text string, persona_id int"
    )
    return match_records(
        embed(asked, "text", encoder),
        index,
        cards,
        threshold=threshold,
        make_generator=make_generator,
    )
