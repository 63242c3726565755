"""Emotion slots as columns, and their means per persona."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetloom.functions.text import sql_text, strip

MAX_LABELS = 1000


def emotion_slots(df: DataFrame) -> list[tuple[str, str]]:
    """(label, confidence) columns found by name: ``emo<n>_label`` with ``emo<n>_conf``."""
    found = []
    for name in df.columns:
        match = re.fullmatch(r"emo(\d+)_label", name)
        if match and f"emo{match[1]}_conf" in df.columns:
            found.append((name, f"emo{match[1]}_conf"))
    return found


def _pairs(slots: Sequence[tuple[str, str]]) -> Column:
    return F.array(
        *[
            F.struct(
                strip(F.col(label)).alias("emotion"), F.col(conf).try_cast("double").alias("conf")
            )
            for label, conf in slots
        ]
    )


def emotion_labels(df: DataFrame, most: int = MAX_LABELS) -> list[str]:
    """The labels that occur with a confidence, in name order.

    They are the classes of one model; a column with more than ``most`` values is
    no label column and raises ValueError.
    """
    slots = emotion_slots(df)
    if not slots:
        return []
    labels = (
        df.select(F.inline(_pairs(slots)))
        .where(F.col("emotion").isNotNull() & F.col("conf").isNotNull())
        .select("emotion")
        .distinct()
        .orderBy("emotion")
        .limit(most + 1)
        .collect()
    )
    if len(labels) > most:
        raise ValueError(f"more than {most} emotion labels")
    return [r["emotion"] for r in labels]


def emotion_wide(df: DataFrame, labels: Sequence[str] | None = None) -> DataFrame:
    """Add ``emotion_<label>``: the highest confidence of the label in the row, else 0.

    Every slot lies in the row itself, so this is a projection without a shuffle. Without
    ``labels`` one aggregate finds them first.
    """
    slots = emotion_slots(df)
    names = emotion_labels(df) if labels is None else list(labels)

    if not slots:
        return df
    clean = df.select(
        "*",
        *[
            column
            for i, (label, conf) in enumerate(slots)
            for column in (
                strip(F.col(label)).alias(f"_label{i}"),
                F.col(conf).try_cast("double").alias(f"_conf{i}"),
            )
        ],
    )

    def best(label: str) -> Column:
        hits = [
            f"CASE WHEN _label{i} = {sql_text(label)} THEN _conf{i} END" for i in range(len(slots))
        ]
        # The added null lets one slot be compared like many.
        return F.expr(f"coalesce(greatest({', '.join(hits)}, NULL), 0D)")

    found = [best(label).alias(f"emotion_{label}") for label in names]
    added = {f"emotion_{label}" for label in names}
    return clean.select(*[c for c in df.columns if c not in added], *found)


def emotion_columns(df: DataFrame) -> list[str]:
    """The ``emotion_<label>`` columns added by ``emotion_wide``."""
    return [c for c in df.columns if re.fullmatch(r"emotion_.+", c) and c not in _OTHER]


_OTHER = ("emotion_conf", "emotion_sentiment")


def persona_emotions(
    df: DataFrame, group: str = "persona_id", top: int = 8, labels: Sequence[str] | None = None
) -> DataFrame:
    """``group, emotion, avg_conf, rank``: the emotions with the highest mean confidence.

    Rows without an emotion count as 0; equal means go by name.
    """
    names = emotion_labels(df) if labels is None else list(labels)
    wide = emotion_wide(df.where(F.col(group).isNotNull()), names)
    means = wide.groupBy(group).agg(
        *[F.avg(f"emotion_{label}").alias(f"emotion_{label}") for label in names]
    )
    listed = F.array(
        *[
            F.struct(F.lit(label).alias("emotion"), F.col(f"emotion_{label}").alias("avg_conf"))
            for label in names
        ]
    )
    best = Window.partitionBy(group).orderBy(F.desc("avg_conf"), "emotion")
    return (
        means.select(group, F.inline(listed))
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= top)
    )
