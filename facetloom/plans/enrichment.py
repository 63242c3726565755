"""Blog lines to enriched, gated rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from facetloom import constants as C
from facetloom.functions.text import birth_year, generation_flag
from facetloom.operators.columns import (
    add_masking,
    confidence_gate,
    quality_metrics,
    require_columns,
    with_settled,
)
from facetloom.operators.ordering import global_index, row_range
from facetloom.operators.scoring import Scorer, score_emotions, score_sentiment
from facetloom.sources.blogs import build_dataset
from facetloom.sources.tables import write_dataset


def add_cohort(
    df: DataFrame,
    date_is_birthdate: bool = True,
    start: int = C.COHORT_START,
    end: int = C.COHORT_END,
) -> DataFrame:
    """Add ``birth_year_est, is_genz``.

    The date counts as the date of birth; with ``date_is_birthdate=False`` as the date of
    the post, from whose year the age is taken.
    """
    age = None if date_is_birthdate else F.col("age") if "age" in df.columns else F.lit(None)
    year = birth_year(F.col("date"), age)
    dated = with_settled(df, "birth_year_est", year)
    return dated.withColumn("is_genz", generation_flag(F.col("birth_year_est"), start, end))


def score_rows(
    df: DataFrame,
    emotions: Scorer,
    sentiment: Scorer,
    text: str = "text",
    max_tokens: int | None = None,
    date_is_birthdate: bool = True,
) -> DataFrame:
    """Cohort (see ``add_cohort``), emotion and sentiment columns, before the gate."""
    rows = add_cohort(require_columns(df, [text, "date"]), date_is_birthdate)
    scored = score_emotions(rows, text, emotions)
    return score_sentiment(scored, text, sentiment, max_tokens)


def enrich_blogs(
    spark: SparkSession,
    directory: str,
    out: str,
    emotions: Scorer,
    sentiment: Scorer,
    min_confidence: float = C.GATE_MIN_CONFIDENCE,
    start: int | None = None,
    end: int | None = None,
    limit: int | None = None,
    max_tokens: int | None = None,
    date_is_birthdate: bool = True,
) -> DataFrame:
    """Blog files to a published dataset with its splits; gives the quality report.

    ``start, end`` or ``limit`` choose rows of each split by their place in file order.
    The report is observed while the rows are written, so each row is scored once.
    """
    lines = build_dataset(spark, directory)
    if start is not None or end is not None or limit:
        parts = []
        for split in ("train", "validation"):
            rows = lines.where(F.col("split") == split)
            placed = global_index(rows, ["file_idx", "post_no", "line_no"], "_place")
            parts.append(row_range(placed, start, end, "_place", limit).drop("_place"))
        lines = parts[0].unionByName(parts[1])
    scored = score_rows(
        lines, emotions, sentiment, max_tokens=max_tokens, date_is_birthdate=date_is_birthdate
    )
    seen = Observation("quality")
    observed = scored.observe(seen, *quality_metrics(min_confidence))
    write_dataset(add_masking(confidence_gate(observed, min_confidence)), out)
    return spark.createDataFrame(
        [(seen.get["rows_loaded"], seen.get["rows_kept"], seen.get["rows_dropped"], seen.get["masking_rate"])],
        "rows_loaded bigint, rows_kept bigint, rows_dropped bigint, masking_rate double",
    )


def enrich(
    df: DataFrame,
    emotions: Scorer,
    sentiment: Scorer,
    min_confidence: float = C.GATE_MIN_CONFIDENCE,
    text: str = "text",
    max_tokens: int | None = None,
    date_is_birthdate: bool = True,
) -> DataFrame:
    """Scored rows that pass the confidence gate, with the masking flag."""
    scored = score_rows(df, emotions, sentiment, text, max_tokens, date_is_birthdate)
    return add_masking(confidence_gate(scored, min_confidence))
