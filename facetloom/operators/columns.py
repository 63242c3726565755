"""Column checks, column selection and row predicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetloom import constants as C
from facetloom.functions.labels import masking, slot_is_sure
from facetloom.functions.text import to_number


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df`` unchanged; ValueError if a column is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {', '.join(missing)}")
    return df


def ensure_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the columns of ``schema``, in order; absent ones are null."""
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def with_settled(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column that is computed once per row.

    As the output of a generator over one element, its expression is not copied into
    filters and projections that come later.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def select_categoricals(
    df: DataFrame,
    cluster: str = "cluster",
    forced: Sequence[str] = C.PROFILE_CATEGORICAL,
    max_cardinality: int | None = None,
) -> list[str]:
    """Categorical columns: the forced ones present, then the other string columns.

    ``max_cardinality`` leaves out unforced columns with more distinct values, such as
    free text; the check is one approximate aggregate over the table.
    """
    first = [c for c in forced if c in df.columns]
    rest = [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.StringType) and f.name != cluster and f.name not in first
    ]
    if max_cardinality is not None and rest:
        counts = df.agg(*[F.approx_count_distinct(c).alias(c) for c in rest]).first()
        rest = [c for c in rest if counts[c] <= max_cardinality]
    return first + rest


def select_numerics(df: DataFrame, cluster: str = "cluster") -> list[str]:
    """Numeric and boolean columns but for the cluster."""
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, (T.NumericType, T.BooleanType)) and f.name != cluster
    ]


def gate_predicate(min_confidence: float = C.GATE_MIN_CONFIDENCE) -> Column:
    """Whether both models gave a label and enough confidence; never null."""
    good = (
        F.col("top_emotion").isNotNull()
        & F.col("emotion_sentiment").isNotNull()
        & F.col("reddit_sentiment").isNotNull()
        & (to_number(F.col("emotion_conf")) >= min_confidence)
        & (to_number(F.col("reddit_conf")) >= min_confidence)
    )
    return F.coalesce(good, F.lit(False))


def confidence_gate(df: DataFrame, min_confidence: float = C.GATE_MIN_CONFIDENCE) -> DataFrame:
    """Rows that both models are sure about."""
    return df.where(gate_predicate(min_confidence))


def add_masking(df: DataFrame) -> DataFrame:
    """The masking flag of gated rows."""
    return df.withColumn(
        "masking", masking(F.col("emotion_sentiment"), F.col("reddit_sentiment"))
    )


def quality_metrics(min_confidence: float = C.GATE_MIN_CONFIDENCE) -> list[Column]:
    """Aggregates over scored, not yet gated rows: loaded, kept, dropped, masking rate."""
    good = gate_predicate(min_confidence)
    masked = masking(F.col("emotion_sentiment"), F.col("reddit_sentiment"))
    return [
        F.count(F.lit(1)).alias("rows_loaded"),
        F.count_if(good).alias("rows_kept"),
        F.count_if(~good).alias("rows_dropped"),
        F.coalesce(F.avg(F.when(good, masked)), F.lit(0.0)).alias("masking_rate"),
    ]


def quality_report(df: DataFrame, min_confidence: float = C.GATE_MIN_CONFIDENCE) -> DataFrame:
    """The quality metrics as one row."""
    return df.agg(*quality_metrics(min_confidence))


def drop_text_and_low_conf(
    df: DataFrame, threshold: float = C.ATTRIBUTE_MIN_CONFIDENCE, text_col: str = "text"
) -> DataFrame:
    """Drop the text; null the label and confidence of unsure slots 1 to 4.

    A slot with only one of its two columns is never sure. Slot 5 passes through.
    """
    out = []
    for name in df.columns:
        if name == text_col:
            continue
        column = F.col(name)
        for slot in range(1, C.ATTRIBUTE_SLOTS + 1):
            both = {f"emo{slot}_label", f"emo{slot}_conf"}
            if name in both:
                sure = slot_is_sure(slot, threshold) if both <= set(df.columns) else F.lit(False)
                column = F.when(sure, column).alias(name)
        out.append(column)
    return df.select(*out)
