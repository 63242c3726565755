"""CSV records with line breaks inside quotes, cut by many tasks of one file.

A task sees a piece of a file and cannot know whether it begins inside quotes, so it follows both
cases: a piece maps each to the state at its end. These maps are small; put one after the other, by file
and place, they give the state that every piece begins in, and with it the lines where records begin. Lines that are whole
records stay where they are; only records of several lines are put together by a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetloom.operators.lookups import lookup
from facetloom.session import pin

_PIECE = ["_file", "_from", "_size"]


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a quoted field is open after the line; quotes inside unquoted fields do not count."""
    at = 0
    while True:
        if not inside:
            if at == 0 and line.startswith('"'):
                at = 1
            else:
                at = line.find(',"', max(0, at - 1)) + 2
                if at == 1:
                    return False
        close = line.find('"', at)
        while close >= 0 and line.startswith('"', close + 1):
            close = line.find('"', close + 2)
        if close < 0:
            return True
        inside, at = False, close + 1


def _follow(lines: DataFrame, kept: list[T.StructField]) -> DataFrame:
    """Number the lines of each piece, and follow both cases of its start.

    ``_in0`` and ``_in1`` tell whether a line begins inside quotes, if the piece begins outside or inside;
    ``_at0`` and ``_at1`` are the last line up to it that begins outside, or null; ``_out0`` and ``_out1`` the states after it.
    """
    names = [f.name for f in kept]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        piece, no = None, 0
        state, start = [False, True], [None, None]
        for pdf in batches:
            out = []
            for file, begin, size, line in zip(pdf["_file"], pdf["_from"], pdf["_size"], pdf["value"], strict=True):
                if (file, begin, size) != piece:
                    piece, no = (file, begin, size), 0
                    state, start = [False, True], [None, None]
                before = list(state)
                for case in (0, 1):
                    if not before[case]:
                        start[case] = no
                if '"' in line:
                    state = [ends_inside(line, s) for s in before]
                out.append((*before, *start, *state, no))
                no += 1
            made = pd.DataFrame(out, columns=marks, dtype=object)
            yield pd.concat([pdf[[*_PIECE, "value", *names]].reset_index(drop=True), made], axis=1)

    marks = ["_in0", "_in1", "_at0", "_at1", "_out0", "_out1", "_no"]
    types = [T.BooleanType()] * 2 + [T.LongType()] * 2 + [T.BooleanType()] * 2 + [T.LongType()]
    fields = [
        T.StructField("_file", T.StringType()), T.StructField("_from", T.LongType()),
        T.StructField("_size", T.LongType()), T.StructField("value", T.StringType()), *kept,
        *[T.StructField(n, t) for n, t in zip(marks, types, strict=True)],
    ]
    return lines.mapInPandas(run, T.StructType(fields))


def _starts(followed: DataFrame) -> DataFrame:
    """Per piece its true state at the start, and the line that began the record open there."""
    last = F.max_by(F.struct("_at0", "_at1", "_out0", "_out1"), "_no").alias("end")
    pieces = followed.groupBy(*_PIECE).agg(last).select(*_PIECE, "end.*")
    along = Window.partitionBy("_file").orderBy("_from")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    # A piece that ends alike in both cases fixes the state; the others keep or turn it.
    fixes = F.col("_out0") == F.col("_out1")
    anchor = F.last(F.when(fixes, F.struct(F.col("_from").alias("at"), F.col("_out0").alias("is"))), True)
    turns = F.sum(F.when(~fixes & F.col("_out0"), 1).otherwise(0))
    told = (
        pieces.withColumn("_anchor", anchor.over(earlier))
        .withColumn("_turns", F.coalesce(turns.over(earlier), F.lit(0)))
        .withColumn("_own", F.coalesce(turns.over(along), F.lit(0)))
    )
    fixed = told.where(fixes).select("_file", F.col("_from").alias("_fixed"), F.col("_own").alias("_base"))
    told = (
        told.withColumn("_fixed", F.col("_anchor.at"))
        .join(fixed, ["_file", "_fixed"], "left")
        .withColumn("_turned", (F.col("_turns") - F.coalesce("_base", F.lit(0))) % 2 == 1)
    )
    inside = F.coalesce("_anchor.is", F.lit(False)) != F.col("_turned")
    told = told.withColumn("_inside", inside)
    begun = F.when(F.col("_inside"), F.col("_at1")).otherwise(F.col("_at0"))
    opened = F.when(begun.isNotNull(), F.struct(F.col("_from").alias("at"), begun.alias("no")))
    return told.withColumn("_open", F.last(opened, True).over(earlier)).select(*_PIECE, "_inside", "_open")


def csv_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per CSV record, as ``value``, without the header of each file; partition columns are kept.

    Lines end with a line feed, with or without a carriage return before it, which is kept inside quotes. Blank
    lines between records are left out, as are empty files. A quoted field that is never closed takes the rest of its file. The text is read
    twice; should a file be cut in other pieces the second time, the job fails and does not mix them up.
    """
    text = spark.read.text(path, lineSep="\n")
    kept = [f for f in text.schema.fields if f.name != "value"]
    lines = text.select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_from"),
        F.col("_metadata.file_block_length").alias("_size"), "value", *[f"`{f.name}`" for f in kept],
    )
    followed = _follow(lines, kept)
    starts = pin(_starts(followed))
    told = lookup(followed, starts, _PIECE, spread_by=["_no"])
    inside = F.coalesce("_inside", F.raise_error(F.lit("the files were cut in other pieces")).cast("boolean"))

    def case(name: str) -> Column:
        return F.when(F.col("_inside"), F.col(f"{name}1")).otherwise(F.col(f"{name}0"))

    mine = F.struct(F.col("_from").alias("at"), case("_at").alias("no"))
    told = told.withColumns({"_inside": inside}).withColumns(
        {"_begins": ~case("_in"), "_ends": ~case("_out"), "_record": F.when(case("_at").isNull(), F.col("_open")).otherwise(mine)}
    )
    rest = [f"`{f.name}`" for f in kept]
    whole = told.where(F.col("_begins") & F.col("_ends")).select("_file", "_record", "value", *rest)
    parts = F.sort_array(F.collect_list(F.struct("_from", "_no", "value")))
    joined = F.array_join(F.transform(parts, lambda p: p["value"]), "\n").alias("value")
    several = (
        told.where(~(F.col("_begins") & F.col("_ends")))
        .groupBy("_file", "_record")
        .agg(joined, *[F.first(f.name).alias(f.name) for f in kept])
        .select("_file", "_record", "value", *rest)
    )
    first = F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("no"))
    records = whole.unionByName(several).where(F.col("_record") != first)
    clean = F.regexp_replace("value", "\r$", "").alias("value")
    return records.select(clean, *rest).where(F.col("value") != "")
