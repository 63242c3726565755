"""Expressions over label scores, emotions and sentiments.

``scores`` is ``array<struct<label, score>>`` in the order the scorer gives it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from facetloom import constants as C
from facetloom.functions.text import strip


def _ranked(scores: Column) -> Column:
    """Scores highest first; equal scores keep the scorer's order."""
    keyed = F.transform(
        scores, lambda s, i: F.struct((-s["score"]).alias("key"), i.alias("pos"), s.alias("s"))
    )
    return F.transform(F.sort_array(keyed), lambda k: k["s"])


def top_k_labels(scores: Column, k: int = C.EMOTION_SLOTS) -> Column:
    """The ``k`` best entries, highest first. Read slots with ``get``: null when short."""
    return F.slice(_ranked(scores), 1, k)


def top_label(scores: Column) -> Column:
    """Label of the first highest score, null without scores."""
    best = F.array_max(F.transform(scores, lambda s: s["score"]))
    return F.get(F.filter(scores, lambda s: s["score"] == best), F.lit(0))["label"]


def slot_columns(ranked: Column, slots: int = C.EMOTION_SLOTS) -> list[Column]:
    """``emo1_label, emo1_conf, ...`` from a ranked score array."""
    out = []
    for i in range(slots):
        entry = F.get(ranked, F.lit(i))
        out.append(entry["label"].alias(f"emo{i + 1}_label"))
        out.append(entry["score"].cast("double").alias(f"emo{i + 1}_conf"))
    return out


def emotion_to_sentiment(label: Column) -> Column:
    """Coarse sentiment of an emotion; null stays null."""
    return (
        F.when(label.isNull(), None)
        .when(label.isin(*C.POSITIVE_EMOTIONS), "positive")
        .when(label.isin(*C.NEGATIVE_EMOTIONS), "negative")
        .otherwise("neutral")
    )


def map_sentiment_label(label: Column) -> Column:
    """Name of a sentiment class; unknown classes are neutral, null stays null."""
    named = F.lit(None).cast("string")
    for code, name in C.SENTIMENT_CLASSES.items():
        named = F.when(label == code, name).otherwise(named)
    return F.when(label.isNotNull(), F.coalesce(named, F.lit("neutral")))


def masking(emotion_sentiment: Column, text_sentiment: Column) -> Column:
    """1 if the two sentiments differ, else 0."""
    return (emotion_sentiment != text_sentiment).cast("int")


def sentiment_score(sentiment: Column) -> Column:
    """+1 for positive, -1 for negative, else 0, also for null."""
    word = F.lower(strip(sentiment))
    return F.when(word == "positive", 1.0).when(word == "negative", -1.0).otherwise(0.0)


def tone(average: Column) -> Column:
    """Words for an average sentiment score; a missing one counts as 0."""
    value = F.coalesce(average, F.lit(0.0))
    return (
        F.when(value > 0.2, "positive").when(value < -0.2, "negative").otherwise("mixed/neutral")
    )


def slot_is_sure(slot: int, threshold: float = C.ATTRIBUTE_MIN_CONFIDENCE) -> Column:
    """Whether emotion slot ``slot`` has a label and enough confidence; never null."""
    sure = F.col(f"emo{slot}_label").isNotNull() & (F.col(f"emo{slot}_conf") >= threshold)
    return F.coalesce(sure, F.lit(False))


def high_conf_emotions(
    threshold: float = C.ATTRIBUTE_MIN_CONFIDENCE, slots: int = C.ATTRIBUTE_SLOTS
) -> Column:
    """Slots with enough confidence as ``array<struct<label, confidence>>``, in slot order."""
    entries = [
        F.when(
            slot_is_sure(i, threshold),
            F.struct(
                F.col(f"emo{i}_label").alias("label"),
                F.col(f"emo{i}_conf").cast("double").alias("confidence"),
            ),
        )
        for i in range(1, slots + 1)
    ]
    return F.array_compact(F.array(*entries))
