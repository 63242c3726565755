"""Positions, ranges and carry-forward over an explicit order.

Spark tables have no order of their own, so each operator names the key it goes by.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetloom import constants as C
from facetloom.session import pin

RANK_BUCKETS = 4096
CARRY_CHUNK = 100_000
_POSITION_BITS = 33


def key_at_rank(df: DataFrame, key: str, rank: int) -> int | None:
    """The ``rank``-th smallest value (from 1) of a unique integer key, or None if there
    are fewer rows.

    Counts rows per key interval and goes on inside the interval that holds the rank, so
    each pass reads one column and returns at most ``RANK_BUCKETS`` numbers.
    """
    ids = df.select(F.col(key).cast("bigint").alias("k")).where(F.col("k").isNotNull())
    low, high, rows = ids.agg(F.min("k"), F.max("k"), F.count("k")).first()
    if rank > rows:
        return None
    below = 0
    while low < high:
        width = -(-(high - low + 1) // RANK_BUCKETS)
        kind = "bigint" if high - low < 2**62 else "decimal(38,0)"
        offset = F.col("k").cast(kind) - F.lit(low).cast(kind)
        counts = (
            ids.where(F.col("k").between(low, high))
            .groupBy(F.floor(offset / F.lit(width).cast(kind)).cast("bigint").alias("bucket"))
            .count()
            .orderBy("bucket")
            .collect()
        )
        for bucket, count in counts:
            if below + count >= rank:
                low, high = low + bucket * width, min(high, low + (bucket + 1) * width - 1)
                break
            below += count
    return low


def row_range(
    df: DataFrame,
    start: int | None = None,
    end: int | None = None,
    order_by: str = "row_id",
    limit: int | None = None,
) -> DataFrame:
    """Rows ``start`` to ``end`` (from 1, both included) by a unique integer key.

    Either side may be open. Without a range, the first ``limit`` rows; 0 or None means
    all. The result is a filter on the key, which goes down to the scan.
    """
    if start is None and end is None:
        end = limit or None
    out = df
    if start is not None and start > 1:
        first = key_at_rank(df, order_by, start)
        out = out.where(F.lit(False) if first is None else F.col(order_by) >= first)
    if end is not None:
        if end < 1:
            return out.where(F.lit(False))
        last = key_at_rank(df, order_by, end)
        if last is not None:
            out = out.where(F.col(order_by) <= last)
    return out


def limit_then_filter(
    df: DataFrame, limit: int, order_by: str = "row_id", flag: str = "is_genz"
) -> DataFrame:
    """The first ``limit`` rows, and of these the flagged ones (all, without the column)."""
    first = row_range(df, order_by=order_by, limit=limit)
    return first.where(F.col(flag) == 1) if flag in df.columns else first


def global_index(df: DataFrame, order_by: Sequence[str | Column], name: str) -> DataFrame:
    """Add the position (from 0) of each row in the given order.

    One range shuffle sorts the table over all tasks. The sorted rows are pinned, and the
    position is the number of rows in earlier parts plus the place within the part.
    """
    order = list(order_by)
    placed = pin(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_order_at", F.monotonically_increasing_id())
    )
    part = F.shiftright("_order_at", _POSITION_BITS).cast("int")
    sizes = placed.groupBy(part.alias("part")).count().orderBy("part").collect()
    if not sizes:
        return placed.withColumn(name, F.col("_order_at")).drop("_order_at")
    starts = list(accumulate((r["count"] for r in sizes), initial=0))
    # One row per shuffle part.
    offsets = df.sparkSession.createDataFrame(
        [(r["part"], start) for r, start in zip(sizes, starts, strict=False)],
        "_order_part int, _order_start bigint",
    )
    place = F.col("_order_at").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1))
    return (
        placed.withColumn("_order_part", part)
        .join(F.broadcast(offsets), "_order_part")
        .withColumn(name, F.col("_order_start") + place)
        .drop("_order_part", "_order_start", "_order_at")
    )


def split_by_index(
    files: DataFrame, every: int = C.VALIDATION_EVERY, order_by: str = "path"
) -> DataFrame:
    """Number the files in path order; each ``every``-th, from the first on, is validation."""
    indexed = global_index(files, [order_by], "file_idx")
    return indexed.withColumn(
        "split", F.when(F.col("file_idx") % every == 0, "validation").otherwise("train")
    )


def carry_forward(
    df: DataFrame,
    partition: Sequence[str],
    order: str,
    value: Column,
    name: str,
    chunk: int = CARRY_CHUNK,
) -> DataFrame:
    """Add the last non-null ``value`` up to each row of its partition.

    ``order`` is an integer position. A long partition is cut into chunks of the order:
    the value is carried inside each chunk, and the last value of every chunk is carried
    over the chunks, so that no task has to hold a whole partition.
    """
    # A struct is never null itself, so one shuffle serves the window and the join.
    rows = df.select(
        "*",
        value.alias("_value"),
        F.struct(*partition).alias("_group"),
        F.expr(f"`{order}` div {chunk}").alias("_chunk"),
    )
    inside = Window.partitionBy("_group", "_chunk").orderBy(order)
    so_far = F.last("_value", ignorenulls=True).over(
        inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    carried = rows.withColumn("_here", so_far).withColumn(
        "_ends", F.lead(F.lit(True)).over(inside).isNull()
    )
    earlier = Window.partitionBy("_group").orderBy("_chunk")
    ends = carried.where("_ends").select(
        "_group",
        "_chunk",
        F.last("_here", ignorenulls=True)
        .over(earlier.rowsBetween(Window.unboundedPreceding, -1))
        .alias("_before"),
    )
    joined = carried.join(ends, ["_group", "_chunk"], "left")
    return joined.select(*df.columns, F.coalesce("_here", "_before").alias(name))
