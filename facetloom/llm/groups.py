"""Python work on sorted groups of rows, streamed through a partition; tables between steps."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from facetloom.session import ensure_checkpoint_dir

Columns = dict[str, np.ndarray]

_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
TEXT_ROWS = 2000


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, with Arrow batches of ``TEXT_ROWS`` rows unless the session sets another number.

    Whole texts are large; a batch of the usual ten thousand would fill a worker's memory.
    """
    conf = df.sparkSession.conf
    if conf.get(_BATCH) == "10000":
        conf.set(_BATCH, str(TEXT_ROWS))
    return df


def whole_row(df: DataFrame) -> Column:
    """All columns as one, so that their names cannot clash with those of an operator."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


class Shelf:
    """Tables between the steps of a job, written in the shared folder and deleted when no step reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{ensure_checkpoint_dir(spark)}/shelf-{uuid.uuid4().hex}"

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        """Write ``df`` and go on from the written rows."""
        path = f"{self.folder}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables, and have Spark's cleaner delete the shuffle files that no DataFrame refers to any more.

        The cleaner acts on what the collections of Python and of the driver's JVM find unused. Without these
        calls the files of all steps stay on the executors' disks until the JVM collects by itself.
        """
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        gc.collect()
        self.spark._jvm.System.gc()


def each_group(
    df: DataFrame, keys: Sequence[str], work: Callable[[Columns], Columns | None], schema: str
) -> DataFrame:
    """``work`` on the columns of every group of ``keys`` (whole numbers).

    One shuffle brings a group together; groups stream by in key order, so that small ones cost
    little and only one is held at a time. ``work`` returns columns, or None for no row.
    """
    keys = list(keys)
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def cut(columns: Columns, low: int, high: int) -> Columns:
            return {k: v[low:high] for k, v in columns.items()}

        def made(parts: list[Columns]) -> pd.DataFrame:
            return pd.DataFrame({n: np.concatenate([p[n] for p in parts]) for n in names})

        held: list[Columns] = []
        last = None
        for pdf in batches:
            if not len(pdf):
                continue
            columns = {c: pdf[c].to_numpy() for c in pdf.columns}
            change = np.zeros(len(pdf), dtype=bool)
            for k in keys:
                change[1:] |= columns[k][1:] != columns[k][:-1]
            starts = [0, *np.flatnonzero(change).tolist(), len(pdf)]
            out = []
            for low, high in zip(starts, starts[1:], strict=False):
                part = cut(columns, low, high)
                key = tuple(part[k][0] for k in keys)
                if held and key != last:
                    whole = {c: np.concatenate([h[c] for h in held]) for c in held[0]} if len(held) > 1 else held[0]
                    if (found := work(whole)) is not None:
                        out.append(found)
                    held = []
                held.append(part)
                last = key
            if out:
                yield made(out)
        if held:
            whole = {c: np.concatenate([h[c] for h in held]) for c in held[0]}
            if (found := work(whole)) is not None:
                yield made([found])

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, schema)
