"""Feature vectors: numeric, categorical, text and emotion blocks, reduction, projection."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.feature import (
    ElementwiseProduct,
    Imputer,
    Normalizer,
    StandardScaler,
    VectorAssembler,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from facetloom import constants as C
from facetloom.functions.labels import sentiment_score
from facetloom.functions.text import category_text, to_number
from facetloom.operators.blocks import blocks_of, projected, slot_batch, summed, unpacked
from facetloom.operators.emotions import emotion_labels, emotion_wide
from facetloom.operators.lookups import fits_broadcast, lookup
from facetloom.operators.ordering import global_index
from facetloom.operators.terms import fit_tfidf
from facetloom.session import pin

#: Rows with up to so many columns get their whole matrix of products, wider ones a basis of a few columns.
EXACT_WIDTH = 512
#: Passes over wide rows for singular vectors, and the seed of their first basis.
SVD_PASSES = 5
SVD_SEED = 42
#: Terms whose sums travel together.
TERM_GROUP = 64


def vector_width(df: DataFrame, column: str) -> int:
    """Width of a vector column, from its metadata or its first row."""
    meta = df.schema[column].metadata.get("ml_attr", {})
    if "num_attrs" in meta:
        return int(meta["num_attrs"])
    first = df.select(column).where(F.col(column).isNotNull()).first()
    return 0 if first is None else len(first[0])


def numeric_block(
    df: DataFrame, columns: Sequence[str], out: str = "numeric_block", impute: bool = True
) -> DataFrame:
    """Add the numeric columns standardised and scaled to length one per row.

    Text that is no number, and a missing column, count as missing. Missing values become
    the column mean, or 0 in a column without any value; with ``impute=False`` they fail.
    """
    numbers = [f"_num{i}" for i in range(len(columns))]
    work = df.select(
        "*",
        *[
            (to_number(F.col(c)) if c in df.columns else F.lit(None).cast("double")).alias(n)
            for c, n in zip(columns, numbers, strict=True)
        ],
    )
    counts = work.agg(*[F.count(n).alias(n) for n in numbers], F.count(F.lit(1)).alias("all")).first()
    if not impute and any(counts[n] < counts["all"] for n in numbers):
        raise ValueError("numeric columns hold missing values")
    known = [n for n in numbers if counts[n] > 0]
    empty = [n for n in numbers if counts[n] == 0]
    work = work.fillna(0.0, subset=empty) if empty else work
    stages = [Imputer(strategy="mean", inputCols=known, outputCols=known)] if known else []
    stages += [
        VectorAssembler(inputCols=numbers, outputCol="_raw"),
        StandardScaler(withMean=True, withStd=True, inputCol="_raw", outputCol="_scaled"),
        Normalizer(p=2.0, inputCol="_scaled", outputCol=out),
    ]
    return Pipeline(stages=stages).fit(work).transform(work).select(*df.columns, out)


def category_positions(df: DataFrame, texts: Sequence[str]) -> DataFrame:
    """``column, value, position`` for every value of the text columns, in order of column and value."""
    pairs = F.array(*[F.struct(F.lit(i).alias("column"), F.col(t).alias("value")) for i, t in enumerate(texts)])
    return pin(global_index(df.select(F.inline(pairs)).distinct(), ["column", "value"], "position"))


def one_hot(df: DataFrame, texts: Sequence[str], positions: DataFrame, out: str, unit: bool = False) -> DataFrame:
    """Add a sparse vector with a one (with ``unit``, length one in all) at the position of each column's value.

    The positions are joined to the rows: by broadcast if they are few, else by a shuffle with hot values spread. No list of
    the values reaches the driver.
    """
    width, few = positions.count(), fits_broadcast(positions)
    share = 1.0 / math.sqrt(len(texts)) if unit else 1.0
    placed = df
    for i, t in enumerate(texts):
        own = positions.where(F.col("column") == i).select(
            F.col("value").alias(t), F.col("position").cast("int").alias(f"{t}_at")
        )
        others = [x for x in texts if x != t] or [t]
        placed = placed.join(F.broadcast(own), t) if few else lookup(placed, own, [t], "inner", spread_by=others)

    @F.pandas_udf(VectorUDT())
    def vector(at: pd.Series) -> pd.DataFrame:
        n = len(at)
        return pd.DataFrame({
            "type": np.zeros(n, dtype="int8"), "size": np.full(n, width, dtype="int32"),
            "indices": at, "values": [np.full(len(x), share) for x in at],
        })

    made = vector(F.array(*[F.col(f"{t}_at") for t in texts]))
    return placed.select(*df.columns, made.alias(out, metadata={"ml_attr": {"num_attrs": width}}))


def categorical_block(
    df: DataFrame, columns: Sequence[str], out: str = "categorical_block"
) -> DataFrame:
    """Add the categories one-hot encoded (sparse) and scaled to length one per row.

    Missing values, and a missing column, are the category ``NA``. Categories may be many: they
    are numbered by a range sort, and never listed on the driver.
    """
    texts = [f"_cat{i}" for i in range(len(columns))]
    work = df.select(
        "*",
        *[
            (category_text(F.col(c)) if c in df.columns else F.lit("NA")).alias(t)
            for c, t in zip(columns, texts, strict=True)
        ],
    )
    return one_hot(work, texts, category_positions(work, texts), out, unit=True).select(*df.columns, out)


def feature_blocks(
    df: DataFrame,
    vector: str,
    numeric: Sequence[str] = C.MAP_NUMERIC,
    categorical: Sequence[str] = C.MAP_CATEGORICAL,
    weights: tuple[float, float, float] = (1.0, 1.0, 1.0),
    out: str = "features",
) -> DataFrame:
    """Add text vector, numeric block and categorical block side by side, each weighted.

    ``vector`` is an ``array<float>`` column with the text vector.
    """
    work = df.withColumn("_text_raw", array_to_vector(F.col(vector).cast("array<double>")))
    work = Normalizer(p=2.0, inputCol="_text_raw", outputCol="_text").transform(work)
    parts = ["_text"]
    if numeric:
        work = numeric_block(work, numeric, "_numeric")
        parts.append("_numeric")
    if categorical:
        work = categorical_block(work, categorical, "_categorical")
        parts.append("_categorical")
    by_part = dict(zip(("_text", "_numeric", "_categorical"), weights, strict=True))
    weighted = []
    for part in parts:
        if by_part[part] == 1.0:
            weighted.append(part)
            continue
        scale = ElementwiseProduct(
            scalingVec=Vectors.dense([by_part[part]] * vector_width(work, part)),
            inputCol=part,
            outputCol=part + "_weighted",
        )
        work = scale.transform(work)
        weighted.append(part + "_weighted")
    assembled = VectorAssembler(inputCols=weighted, outputCol=out).transform(work)
    return assembled.select(*df.columns, out)


def reduce_pca(
    df: DataFrame, dimensions: int = C.MAP_DIMENSIONS, features: str = "features", out: str = "reduced"
) -> DataFrame:
    """Add the first principal components, centred; vectors that are narrow enough stay.

    The rows are projected as they are, sparse, and the few components are centred
    afterwards, which gives the same numbers.
    """
    if vector_width(df, features) <= dimensions:
        return df.withColumn(out, F.col(features))
    return _components(df, dimensions, features, out)


def _components(df: DataFrame, k: int, features: str, out: str, of: DataFrame | None = None) -> DataFrame:
    vectors, mean = principal_directions(df if of is None else of, k, features)
    return projected(df, features, vectors, mean @ vectors, out)


def project_2d(df: DataFrame, features: str = "reduced", of: DataFrame | None = None) -> DataFrame:
    """Add ``x2d, y2d``, the first two principal components, of these rows or of those of ``of``."""
    flat = _components(df, 2, features, "_flat", of).withColumn("_xy", vector_to_array("_flat"))
    return flat.select(
        *df.columns, F.col("_xy")[0].alias("x2d"), F.col("_xy")[1].alias("y2d")
    )


def _gram_times(rows: DataFrame, matrix: np.ndarray) -> np.ndarray:
    """(transposed rows x rows) x matrix in one pass; tasks send only their sums, some terms together."""
    sent = rows.sparkSession.sparkContext.broadcast(matrix)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros_like(sent.value)
        seen = np.zeros(len(total), dtype=bool)
        for batch in batches:
            for _, block in blocks_of(batch):
                block.add_turned(block.times(sent.value), total)
                seen[slice(None) if block.at is None else block.at] = True
        groups = np.unique(np.flatnonzero(seen) // TERM_GROUP).tolist()
        yield slot_batch({g: total[g * TERM_GROUP : (g + 1) * TERM_GROUP] for g in groups})

    # One line for each group of terms.
    found = summed(rows.select("indices", "values").mapInArrow(sums, "slot int, total array<double>")).collect()
    sent.destroy()
    out = np.zeros_like(matrix)
    for r in found:
        part = np.array(r["total"]).reshape(-1, matrix.shape[1])
        out[r["slot"] * TERM_GROUP : r["slot"] * TERM_GROUP + len(part)] = part
    return out


def _mean(rows: DataFrame, width: int) -> tuple[float, np.ndarray]:
    """Number and mean of the rows."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((1, width)), 0
        for batch in batches:
            for _, block in blocks_of(batch):
                block.add_by_label(np.zeros(block.rows, dtype=np.int64), total)
                count += block.rows
        yield slot_batch({0: np.append(total[0], count)})

    found = summed(rows.select("indices", "values").mapInArrow(sums, "slot int, total array<double>")).collect()
    total = np.array(found[0]["total"]) if found else np.zeros(width + 1)
    return total[-1], total[:-1] / max(total[-1], 1.0)


def _leading(
    rows: DataFrame, width: int, k: int, passes: int, seed: int, centre: tuple[float, np.ndarray] | None
) -> np.ndarray:
    """The leading eigenvectors of the rows' inner products, as columns; around their mean with ``centre``.

    Up to ``EXACT_WIDTH`` columns the matrix of products is made as it is. Wider rows go through subspace
    iteration (Halko, Martinsson and Tropp, 2011): the basis is a few columns, and the mean is a
    correction of rank one, so that sparse rows stay sparse. The sign of a vector is set so that its largest
    entry is positive.
    """

    def times(basis: np.ndarray) -> np.ndarray:
        found = _gram_times(rows, basis)
        if centre is None:
            return found
        count, mean = centre
        return found - count * np.outer(mean, mean @ basis)

    if width <= EXACT_WIDTH:
        basis = np.eye(width)
    else:
        rng = np.random.default_rng(seed)
        basis = np.linalg.qr(rng.standard_normal((width, min(width, k + 10))))[0]
        for _ in range(passes):
            basis = np.linalg.qr(times(basis))[0]
    small = basis.T @ times(basis)
    _, rotation = np.linalg.eigh((small + small.T) / 2)
    vectors = basis @ rotation[:, ::-1][:, :k]
    top = np.abs(vectors).argmax(axis=0)
    return vectors * np.where(vectors[top, np.arange(vectors.shape[1])] < 0, -1.0, 1.0)


def singular_vectors(
    df: DataFrame, dimensions: int, features: str, passes: int = SVD_PASSES, seed: int = SVD_SEED
) -> np.ndarray:
    """The leading right singular vectors of the rows, as columns; ``passes`` + 1 passes over wide rows."""
    width = vector_width(df, features)
    # On disk: of large tables most would go there anyway, and what is kept in memory is missing elsewhere.
    rows = unpacked(df, features).persist(StorageLevel.DISK_ONLY)
    try:
        return _leading(rows, width, min(dimensions, width), passes, seed, None)
    finally:
        rows.unpersist()


def principal_directions(
    df: DataFrame, dimensions: int, features: str, passes: int = 8, seed: int = 42
) -> tuple[np.ndarray, np.ndarray]:
    """The leading principal directions of the rows, as columns, and the mean of the rows."""
    width = vector_width(df, features)
    rows = unpacked(df, features).persist(StorageLevel.DISK_ONLY)
    try:
        centre = _mean(rows, width)
        return _leading(rows, width, min(dimensions, width), passes, seed, centre), centre[1]
    finally:
        rows.unpersist()


def svd(
    df: DataFrame, dimensions: int = C.SVD_DIMENSIONS, features: str = "tfidf", out: str = "svd"
) -> DataFrame:
    """Add the coordinates of each row on the leading right singular vectors, not centred.

    The singular vectors are a terms x dimensions matrix, bounded by the vocabulary.
    """
    factors = singular_vectors(df, dimensions, features)
    return projected(df, features, factors, np.zeros(factors.shape[1]), out)


def persona_features(
    df: DataFrame,
    text: str = "text",
    categorical: Sequence[str] = C.PERSONA_CATEGORICAL,
    min_df: int = 1,
    dimensions: int = C.SVD_DIMENSIONS,
    max_features: int = C.VOCABULARY_SIZE,
    out: str = "features",
) -> tuple[DataFrame, list[str]]:
    """Add the scaled persona features; also gives the name of each position.

    Text SVD, one-hot categories present in the table, sentiment score, emotion columns,
    each divided by its standard deviation and not centred.
    """
    if text not in df.columns:
        raise ValueError(f"text column not found: {text}")
    labels = emotion_labels(df)
    sentiment = (
        sentiment_score(F.col("reddit_sentiment"))
        if "reddit_sentiment" in df.columns
        else F.lit(0.0)
    )
    work = emotion_wide(df, labels).withColumn("sentiment_score", sentiment)
    tfidf = fit_tfidf(work, text, max_features, (1, 2), min_df)
    k = min(dimensions, len(tfidf.terms))
    names = [f"text_svd_{i}" for i in range(k)]
    present = [c for c in categorical if c in df.columns]
    texts = [f"_cat{i}" for i in range(len(present))]
    numbers = ["sentiment_score", *[f"emotion_{label}" for label in labels]]
    work = tfidf.entries(work, "_tfidf").select(
        "*", *[category_text(F.col(c)).alias(t) for c, t in zip(present, texts, strict=True)]
    )
    # All passes go over the entries; the text is read once more, for the result.
    held = work.select("_tfidf", *texts, *numbers).persist(StorageLevel.DISK_ONLY)
    try:
        factors = _leading(unpacked(held, "_tfidf"), len(tfidf.terms), k, SVD_PASSES, SVD_SEED, None)
        positions = category_positions(held, texts) if present else None
        if present:
            # A name for each position of the vectors is part of the result.
            for r in positions.orderBy("position").toLocalIterator():
                names.append(f"{present[r['column']]}_{r['value']}")
        parts = ["_svd", "_hot"] if present else ["_svd"]
        assembler = VectorAssembler(inputCols=[*parts, *numbers], outputCol="_all")

        def assembled(rows: DataFrame) -> DataFrame:
            placed = projected(rows, "_tfidf", factors, np.zeros(k), "_svd")
            return assembler.transform(one_hot(placed, texts, positions, "_hot") if present else placed)

        scaler = StandardScaler(withMean=False, withStd=True, inputCol="_all", outputCol=out).fit(assembled(held).select("_all"))
    finally:
        held.unpersist()
    keep = [*df.columns, "sentiment_score", *[f"emotion_{label}" for label in labels]]
    return scaler.transform(assembled(work)).select(*keep, out), names + numbers
