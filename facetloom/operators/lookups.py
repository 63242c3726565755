"""Joins of a large table to a lookup table of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetloom.session import pin

BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 * 1024 * 1024
HOT_ROWS = 2_000_000
HOT_KEYS = 1024
SALTS = 64


def fits_broadcast(
    table: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES
) -> bool:
    """Whether the table, counted and weighed, is small enough to copy to every executor."""
    if table.count() > max_rows:
        return False
    row = F.octet_length(F.to_json(F.struct(*[F.col(c) for c in table.columns])))
    return (table.agg(F.sum(row).alias("bytes")).first()["bytes"] or 0) <= max_bytes


def lookup(
    df: DataFrame,
    table: DataFrame,
    on: Sequence[str],
    how: str = "left",
    spread_by: Sequence[str] | None = None,
    max_rows: int = BROADCAST_ROWS,
    pinned: bool = False,
) -> DataFrame:
    """Join ``df`` to ``table`` on equal keys.

    A table that passes the size check is broadcast: no shuffle, no skew. A larger one
    is joined by shuffle, and the most frequent keys of ``df`` (up to ``HOT_KEYS`` keys with
    ``HOT_ROWS`` rows or more) are salted: their rows are spread over ``SALTS`` parts by
    ``spread_by`` (a row id), and only their rows in ``table`` are repeated. ``pinned`` writes a table that is costly to
    compute once, before its size is checked.
    """
    keys = list(on)
    table = pin(table) if pinned else table
    if fits_broadcast(table, max_rows):
        return df.join(F.broadcast(table), keys, how)
    if spread_by is None:
        return df.join(table, keys, how)

    # Keys of the many rows, the most frequent first; a shorter list would do no harm.
    hot = (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") >= HOT_ROWS)
        .orderBy(F.desc("_n"))
        .limit(HOT_KEYS)
        .select(*keys, F.lit(True).alias("_hot"))
    )
    hot = pin(hot)

    def marked(side: DataFrame) -> DataFrame:
        return side.join(F.broadcast(hot), keys, "left")

    unknown = F.lit(False)
    for key in keys:
        unknown = unknown | F.col(key).isNull()
    spread = F.pmod(F.xxhash64(*spread_by), F.lit(SALTS))
    salted = marked(df).withColumn(
        "_salt", F.when(F.col("_hot") | unknown, spread).otherwise(F.lit(0))
    )
    every = F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))
    repeated = marked(table).withColumn(
        "_salt", F.explode(F.when(F.col("_hot"), every).otherwise(F.array(F.lit(0).cast("bigint"))))
    )
    joined = salted.drop("_hot").join(repeated.drop("_hot"), [*keys, "_salt"], how)
    return joined.drop("_salt")
