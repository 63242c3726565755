"""Numpy work on groups of rows that stream through sorted partitions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

Columns = dict[str, np.ndarray]


def matrix_of(lists: pa.Array) -> np.ndarray:
    """A column of equally long arrays of numbers, as the rows of a matrix."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(lists), -1) if len(lists) else flat.reshape(0, 0)


def _columns(batch: pa.RecordBatch) -> Columns:
    return {
        name: matrix_of(column) if pa.types.is_list(column.type) else column.to_numpy(zero_copy_only=False)
        for name, column in zip(batch.schema.names, batch.columns, strict=True)
    }


def each_sorted_group(
    df: DataFrame, key: str, work: Callable[[Columns], Columns], schema: str
) -> DataFrame:
    """``work`` on the columns of every group of ``key``, a whole number.

    One shuffle brings a group together; the groups of a partition stream by in order of the key and only
    one is held at a time, so many small ones cost little. Array columns arrive as matrices.
    """
    names = [part.split()[0] for part in schema.split(", ")]

    def whole(parts: list[Columns]) -> Columns:
        if len(parts) == 1:
            return parts[0]
        return {name: np.concatenate([p[name] for p in parts]) for name in parts[0]}

    def made(found: list[Columns]) -> pa.RecordBatch:
        joined = whole(found)
        return pa.RecordBatch.from_arrays([pa.array(joined[n]) for n in names], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Columns] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = _columns(batch)
            keys = columns[key]
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            found = []
            for low, high in zip(cuts, cuts[1:], strict=False):
                if held and keys[low] != last:
                    found.append(work(whole(held)))
                    held = []
                held.append({name: values[low:high] for name, values in columns.items()})
                last = keys[low]
            if found:
                yield made(found)
        if held:
            yield made([work(whole(held))])

    return df.repartition(key).sortWithinPartitions(key).mapInArrow(run, schema)
