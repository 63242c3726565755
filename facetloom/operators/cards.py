"""Persona cards and the run summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetloom.functions.labels import sentiment_score
from facetloom.operators.emotions import emotion_slots, persona_emotions
from facetloom.operators.terms import TfidfModel, ranked_array, top_terms
from facetloom.schemas import RANKING


def with_sentiment_score(df: DataFrame) -> DataFrame:
    """Add ``sentiment_score``; a table without ``reddit_sentiment`` scores 0."""
    if "sentiment_score" in df.columns:
        return df
    known = "reddit_sentiment" in df.columns
    score = sentiment_score(F.col("reddit_sentiment")) if known else F.lit(0.0)
    return df.withColumn("sentiment_score", score)


def persona_base(df: DataFrame, group: str = "persona_id") -> DataFrame:
    """``group, size, share, avg_sentiment_score`` of each persona."""
    sized = (
        with_sentiment_score(df)
        .where(F.col(group).isNotNull())
        .groupBy(group)
        .agg(
            F.count(F.lit(1)).alias("size"),
            F.avg("sentiment_score").alias("avg_sentiment_score"),
        )
    )
    total = sized.select(F.sum("size").alias("total")).scalar()
    return sized.select(
        group, "size", (F.col("size") / total).alias("share"), "avg_sentiment_score"
    )


def most_common(
    df: DataFrame,
    column: str,
    group: str = "persona_id",
    top: int = 5,
    row_id: str = "row_id",
) -> DataFrame:
    """``group, value, count, rank``: the most frequent values of each group.

    Equal counts go to the value seen first by ``row_id``. A missing value counts as the
    text ``nan``.
    """
    value = F.coalesce(F.col(column).cast("string"), F.lit("nan")).alias("value")
    counted = (
        df.where(F.col(group).isNotNull())
        .groupBy(group, value)
        .agg(F.count(F.lit(1)).alias("count"), F.min(row_id).alias("_first"))
    )
    # The rank filter lets each task keep only its own best before the shuffle.
    best = Window.partitionBy(group).orderBy(F.desc("count"), "_first")
    return (
        counted.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= top)
        .select(group, "value", "count", "rank")
    )


def persona_cards(
    df: DataFrame,
    terms: TfidfModel,
    group: str = "persona_id",
    row_id: str = "row_id",
    words: int = 12,
    emotions: int = 8,
    values: int = 5,
) -> DataFrame:
    """One row per persona: ``group`` and the fields of a card.

    Each list is at most ``words``, ``emotions`` or ``values`` long; lists whose columns
    the table lacks are empty.
    """

    def empty(kind: str) -> Column:
        return F.array().cast(kind)

    cards = persona_base(df, group)
    listed = top_terms(df, terms, group, words)
    cards = cards.join(
        listed.groupBy(group).agg(ranked_array(F.col("term")).alias("top_words")), group, "left"
    )
    pair = "array<struct<emotion: string, avg_conf: double>>"
    if emotion_slots(df):
        best = persona_emotions(df, group, emotions)
        cards = cards.join(
            best.groupBy(group).agg(
                ranked_array(F.struct("emotion", "avg_conf")).alias("top_emotions")
            ),
            group,
            "left",
        )
    else:
        cards = cards.withColumn("top_emotions", empty(pair))
    for column, name in (("horoscope", "horoscope_top"), ("job", "job_top")):
        if column in df.columns:
            top = most_common(df, column, group, values, row_id)
            top = top.groupBy(group).agg(ranked_array(F.col("value")).alias(name))
            cards = cards.join(top, group, "left")
        else:
            cards = cards.withColumn(name, empty("array<string>"))
    return cards.select(
        group,
        "size",
        "share",
        F.coalesce("top_words", empty("array<string>")).alias("top_words"),
        "avg_sentiment_score",
        F.coalesce("top_emotions", empty(pair)).alias("top_emotions"),
        "horoscope_top",
        "job_top",
    )


def run_summary(
    cards: DataFrame,
    source: str,
    silhouette: float,
    mutual_information: DataFrame | None = None,
    permutation_importance: DataFrame | None = None,
    group: str = "persona_id",
) -> DataFrame:
    """One row: run fields, both feature rankings, and the cards by persona id.

    Rankings are tables ``feature, score, rank`` that end at their top 30.
    """
    card = F.struct(*[F.col(c) for c in cards.columns if c != group])
    # One entry per persona, so the map is as small as the choice of k.
    merged = cards.agg(
        F.sum("size").alias("n_rows"),
        F.count(F.lit(1)).cast("int").alias("n_personas"),
        F.map_from_entries(
            F.sort_array(F.collect_list(F.struct(F.col(group).cast("string").alias("key"), card.alias("value"))))
        ).alias("personas"),
    )

    def ranking(table: DataFrame | None) -> Column:
        if table is None:
            return F.array().cast(RANKING)
        listed = table.agg(ranked_array(F.struct("feature", "score")).alias("r"))
        return listed.scalar().cast(RANKING)

    return merged.select(
        F.lit(source).alias("source_csv"),
        "n_rows",
        "n_personas",
        F.lit(float(silhouette)).alias("silhouette"),
        F.struct(
            ranking(mutual_information).alias("mutual_information_top30"),
            ranking(permutation_importance).alias("permutation_importance_top30"),
        ).alias("feature_importance"),
        "personas",
    )
