"""Blocks of feature vectors inside a task: dense matrices, or sparse rows in compressed form."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetloom.session import small_batches

#: Rows of a dense block, and stored entries of a sparse one, that are worked on at a time.
DENSE_ROWS = 2048
SPARSE_ENTRIES = 1 << 16
#: Numbers that are written out at a time where sparse rows are worked on, and places per entry up to which it pays to write them out.
WRITTEN = 1 << 21
SPARSEST = 64


@F.pandas_udf(
    T.StructType(
        [
            T.StructField("indices", T.ArrayType(T.IntegerType())),
            T.StructField("values", T.ArrayType(T.DoubleType())),
        ]
    )
)
def _unpacked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for vectors in batches:
        yield vectors[["indices", "values"]]


def unpacked(df: DataFrame, features: str, *others: str) -> DataFrame:
    """The other columns, and ``indices, values`` of a vector column or of a struct of them; dense vectors have no indices."""
    ready = isinstance(df.schema[features].dataType, T.StructType)
    plain = small_batches(df).where(F.col(features).isNotNull()).select(
        *others, (F.col(features) if ready else _unpacked(features)).alias("_v")
    )
    return plain.select(*others, "_v.indices", "_v.values")


@dataclass
class Block:
    """Some rows: a dense matrix, or entries with their place, row and the rows' first entries."""

    rows: int
    values: np.ndarray
    at: np.ndarray | None = None
    starts: np.ndarray | None = None

    def norms(self) -> np.ndarray:
        """Squared length of each row."""
        if self.at is None:
            return (self.values * self.values).sum(axis=1)
        return self._by_row((self.values * self.values)[:, None])[:, 0]

    def _by_row(self, entries: np.ndarray) -> np.ndarray:
        out = np.zeros((self.rows, entries.shape[1]))
        full = np.flatnonzero(np.diff([*self.starts, len(self.values)]))
        if len(full):
            out[full] = np.add.reduceat(entries, self.starts[full], axis=0)
        return out

    def row_of(self) -> np.ndarray:
        """The row of each stored entry."""
        return np.repeat(np.arange(self.rows), np.diff([*self.starts, len(self.values)]))

    def _written(self, width: int) -> Iterator[tuple[slice, np.ndarray]]:
        """The rows with all their places, some at a time."""
        step, row = max(1, WRITTEN // width), self.row_of()
        for low in range(0, self.rows, step):
            part = slice(low, min(self.rows, low + step))
            own = slice(*np.searchsorted(row, [part.start, part.stop]))
            out = np.zeros((part.stop - part.start, width))
            out[row[own] - low, self.at[own]] = self.values[own]
            yield part, out

    def times(self, matrix: np.ndarray) -> np.ndarray:
        """rows x matrix."""
        if self.at is None:
            return self.values @ matrix
        out = np.empty((self.rows, matrix.shape[1]))
        if self.rows * len(matrix) <= SPARSEST * len(self.at):
            for part, rows in self._written(len(matrix)):
                out[part] = rows @ matrix
            return out
        # A few columns at a time: an entry takes part in each.
        step = max(1, WRITTEN // max(1, len(self.at)))
        for low in range(0, matrix.shape[1], step):
            out[:, low : low + step] = self._by_row(matrix[self.at, low : low + step] * self.values[:, None])
        return out

    def add_turned(self, weights: np.ndarray, total: np.ndarray) -> None:
        """Add (transposed rows) x weights to ``total``; weights has a line for each row."""
        if self.at is None:
            total += self.values.T @ weights
        elif self.rows * len(total) <= SPARSEST * len(self.at):
            for part, rows in self._written(len(total)):
                total += rows.T @ weights[part]
        elif len(self.at):
            order = np.argsort(self.at, kind="stable")
            at, row = self.at[order], self.row_of()[order]
            starts = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
            step = max(1, WRITTEN // len(at))
            for low in range(0, weights.shape[1], step):
                entries = weights[row, low : low + step] * self.values[order, None]
                total[at[starts], low : low + step] += np.add.reduceat(entries, starts, axis=0)

    def add_by_label(self, label: np.ndarray, total: np.ndarray) -> None:
        """Add each row to the line of ``total`` that its label names."""
        if self.at is None:
            hot = np.zeros((self.rows, len(total)))
            hot[np.arange(self.rows), label] = 1.0
            total += hot.T @ self.values
        else:
            place = label[self.row_of()] * total.shape[1] + self.at
            total += np.bincount(place, self.values, total.size).reshape(total.shape)


def blocks_of(batch: pa.RecordBatch) -> Iterator[tuple[slice, Block]]:
    """Blocks of a batch with ``indices`` and ``values``, and the rows that each holds.

    A batch is dense if no row has indices; otherwise dense rows in it are written out.
    """
    indices, values = batch.column("indices"), batch.column("values")
    n = batch.num_rows
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    if indices.null_count == n and n:
        matrix = flat.reshape(n, -1)
        for low in range(0, n, DENSE_ROWS):
            part = matrix[low : low + DENSE_ROWS]
            yield slice(low, low + len(part)), Block(len(part), part)
        return
    sizes = values.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    at = np.empty(len(flat), dtype=np.int64)
    plain = indices.is_null().to_numpy(zero_copy_only=False)
    inside = np.repeat(plain, sizes)
    at[~inside] = indices.flatten().to_numpy(zero_copy_only=False)
    at[inside] = (np.arange(len(flat)) - np.repeat(starts, sizes))[inside]
    low = 0
    while low < n:
        # At least one row, else as many as hold a bounded number of entries.
        high = max(low + 1, int(np.searchsorted(ends, starts[low] + SPARSE_ENTRIES, side="right")))
        cut = slice(starts[low], ends[high - 1])
        yield slice(low, high), Block(high - low, flat[cut], at[cut], starts[low:high] - starts[low])
        low = high


def _pieces(vectors: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """A batch of vectors cut into pieces with a bounded number of stored entries, of a row at least."""
    ends = np.cumsum([len(v) for v in vectors["values"]])
    low = 0
    while low < len(vectors):
        done = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, done + SPARSE_ENTRIES, side="right")))
        yield vectors.iloc[low:high]
        low = high


def block_of_vectors(vectors: pd.DataFrame) -> Block:
    """One block of a piece of vectors as a pandas function gets them; none of them is null."""
    values = [np.asarray(v, dtype=np.float64) for v in vectors["values"]]
    if vectors["indices"].isna().all():
        return Block(len(values), np.stack(values))
    at = [
        np.arange(len(v)) if i is None else np.asarray(i, dtype=np.int64)
        for i, v in zip(vectors["indices"], values, strict=True)
    ]
    ends = np.cumsum([len(v) for v in values])
    return Block(len(values), np.concatenate(values), np.concatenate(at), np.concatenate(([0], ends[:-1])))


def projected(df: DataFrame, features: str, matrix: np.ndarray, shift: np.ndarray, out: str) -> DataFrame:
    """Add the vector column ``rows x matrix - shift``; null stays null."""

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for vectors in batches:
            known = vectors["values"].notna()
            placed = pd.Series([None] * len(vectors), dtype="object")
            if known.any():
                # A whole batch of wide rows times the matrix would be gigabytes.
                found = [
                    row
                    for piece in _pieces(vectors[known.to_numpy()])
                    for row in block_of_vectors(piece).times(matrix) - shift
                ]
                placed[known.to_numpy()] = pd.Series(found, index=placed.index[known.to_numpy()], dtype="object")
            yield placed

    project.__annotations__ = {"batches": Iterator[pd.DataFrame], "return": Iterator[pd.Series]}
    coordinates = F.pandas_udf(project, T.ArrayType(T.DoubleType()))
    placed = small_batches(df).withColumn("_placed", coordinates(features))
    vector = F.when(F.col("_placed").isNotNull(), array_to_vector("_placed"))
    # With its width known, no row has to be made to find it.
    sized = vector.alias(out, metadata={"ml_attr": {"num_attrs": matrix.shape[1]}})
    return placed.select(*[F.col(f"`{c}`") for c in placed.columns if c not in (out, "_placed")], sized)


def summed(parts: DataFrame) -> DataFrame:
    """Rows ``slot int, total array<double>`` summed by slot, entry by entry.

    The parts of a slot meet in one task, which holds one sum for each of its slots.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            totals = batch.column("total")
            flat = totals.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(totals.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            low = 0
            for slot, high in zip(batch.column("slot").to_pylist(), ends.tolist(), strict=True):
                if slot in held:
                    held[slot] += flat[low:high]
                else:
                    held[slot] = flat[low:high].astype(np.float64)
                low = high
        yield slot_batch(held)

    return parts.repartition("slot").mapInArrow(run, "slot int, total array<double>")


def slot_batch(held: dict[int, np.ndarray]) -> pa.RecordBatch:
    """Numbered sums as a batch ``slot, total``."""
    return pa.RecordBatch.from_arrays(
        [pa.array(list(held), pa.int32()), pa.array([v.ravel() for v in held.values()], pa.list_(pa.float64()))],
        names=["slot", "total"],
    )
