"""Declared schemas of the tables that go through files."""

from __future__ import annotations

from pyspark.sql import types as T

_TEXT, _INT, _LONG, _DOUBLE = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


def _slots(count: int) -> list[tuple[str, T.DataType]]:
    return [
        field
        for i in range(1, count + 1)
        for field in ((f"emo{i}_label", _TEXT), (f"emo{i}_conf", _DOUBLE))
    ]


_BLOG_FIELDS: list[tuple[str, T.DataType]] = [
    ("text", _TEXT), ("date", _TEXT), ("gender", _TEXT), ("age", _INT), ("job", _TEXT),
    ("horoscope", _TEXT),
]

BLOG_LINES = _struct(*_BLOG_FIELDS)

ENRICHED = _struct(
    *_BLOG_FIELDS,
    ("birth_year_est", _INT), ("is_genz", _INT), ("top_emotion", _TEXT),
    ("emotion_conf", _DOUBLE), ("emotion_sentiment", _TEXT), ("reddit_sentiment", _TEXT),
    ("reddit_conf", _DOUBLE), *_slots(5), ("masking", _INT),
)

CLUSTERED = _struct(
    ("text", _TEXT), ("top_emotion", _TEXT), ("reddit_sentiment", _TEXT), *_slots(4),
    ("horoscope", _TEXT), ("job", _TEXT), ("masking", _INT), ("cluster", _INT),
    ("x2d", _DOUBLE), ("y2d", _DOUBLE), ("cluster_color_name", _TEXT),
)

CLUSTER_LEGEND = _struct(("cluster", _INT), ("count", _LONG), ("color_name", _TEXT))

SCORES = T.ArrayType(_struct(("label", _TEXT), ("score", _DOUBLE)))

CARD = _struct(
    ("size", _LONG),
    ("share", _DOUBLE),
    ("top_words", T.ArrayType(_TEXT)),
    ("avg_sentiment_score", _DOUBLE),
    ("top_emotions", T.ArrayType(_struct(("emotion", _TEXT), ("avg_conf", _DOUBLE)))),
    ("horoscope_top", T.ArrayType(_TEXT)),
    ("job_top", T.ArrayType(_TEXT)),
)

RANKING = T.ArrayType(_struct(("feature", _TEXT), ("score", _DOUBLE)))

RUN_SUMMARY = _struct(
    ("source_csv", _TEXT),
    ("n_rows", _LONG),
    ("n_personas", _INT),
    ("silhouette", _DOUBLE),
    (
        "feature_importance",
        _struct(
            ("mutual_information_top30", RANKING), ("permutation_importance_top30", RANKING)
        ),
    ),
    ("personas", T.MapType(_TEXT, CARD)),
)
