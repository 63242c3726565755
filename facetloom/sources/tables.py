"""CSV, parquet and dataset tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetloom.sources.publish import is_ready, publish
from facetloom.sources.records import csv_records

# White space in fields is kept. A field without quotes and content is null, ``""`` is empty.
_EXACT = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
_NO_VALUE = "\0"


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | str | None = None,
    null_values: Sequence[str] = (),
    multi_line: bool = True,
) -> DataFrame:
    """CSV with a header, quoted fields and line breaks inside quotes.

    Several tasks share a large file. Without line breaks inside fields, ``multi_line=False`` saves the
    pass that looks for the quotes; the line breaks of other files would be wrong with it.

    Columns are found by header name. With a schema the types are declared, a column the
    file lacks is null, and text that is no number becomes null in a number column. Words
    in ``null_values`` become null in every column.
    """
    form = {"quote": '"', "escape": '"', "nullValue": _NO_VALUE, **_EXACT}
    raw = spark.read.csv(path, header=True, multiLine=multi_line, inferSchema=False, **form)
    if multi_line:
        # Spark gives a file with line breaks in fields to one task, so only the header is taken from it.
        records = csv_records(spark, path)
        own = [c for c in raw.columns if c not in records.columns[1:]]
        fields = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(own))])
        options = {k: str(v).lower() if isinstance(v, bool) else v for k, v in form.items()}
        raw = records.withColumn("value", F.from_csv("value", fields.simpleString()[7:-1].replace(":", " "), options))
        others = [F.col(f"`{c}`") for c in raw.columns[1:]]
        raw = raw.select(*[F.col(f"value.c{i}").alias(c) for i, c in enumerate(own)], *others)

    def cleaned(name: str):
        value = F.col(f"`{name}`")
        return F.when(value.isin(*null_values), None).otherwise(value) if null_values else value

    if schema is None:
        return raw.select(*[cleaned(c).alias(c) for c in raw.columns])
    declared = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    out = []
    for field in declared.fields:
        value = cleaned(field.name) if field.name in raw.columns else F.lit(None).cast("string")
        if isinstance(field.dataType, T.IntegralType):
            # Whole numbers may be written as 1997.0; other fractions are no whole numbers.
            real = value.try_cast("double")
            whole = F.when(real == F.floor(real), real.try_cast(field.dataType))
            value = F.coalesce(value.try_cast(field.dataType), whole)
        elif not isinstance(field.dataType, T.StringType):
            value = value.try_cast(field.dataType)
        out.append(value.alias(field.name))
    return raw.select(*out)


def write_csv(df: DataFrame, path: str, order_by: Sequence[str] = ()) -> None:
    """CSV with a header; ``order_by`` sorts the whole table over the part files."""
    ordered = df.orderBy(*order_by) if order_by else df
    ordered.write.mode("overwrite").csv(
        path, header=True, quote='"', escape='"', emptyValue='""', **_EXACT
    )


def materialize_parquet(
    spark: SparkSession, csv_path: str, parquet_path: str, schema: T.StructType | str
) -> DataFrame:
    """The parquet table if it is complete, else the CSV table converted once.

    A folder without the commit mark, left by a job that ended early, is moved aside and converted again.
    """
    if not is_ready(spark, parquet_path):
        publish(read_csv(spark, csv_path, schema), parquet_path)
    return spark.read.parquet(parquet_path)


def write_dataset(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Publish a table with a ``split`` column, one folder per split.

    ``overwrite`` replaces a dataset once the new one is complete; ``errorifexists`` leaves one that is there and
    fails, ``ignore`` leaves it. ``append`` adds files in place.
    """
    if mode == "append":
        df.write.mode(mode).partitionBy("split").parquet(path)
        return
    if mode not in ("overwrite", "errorifexists", "error", "ignore"):
        raise ValueError(f"unknown mode: {mode}")
    if mode != "overwrite" and is_ready(df.sparkSession, path):
        if mode == "ignore":
            return
        raise FileExistsError(f"there is a dataset at {path}")
    if not publish(df, path, ["split"], replace=mode == "overwrite") and mode != "ignore":
        raise FileExistsError(f"there is a dataset at {path}")


def read_dataset(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """A published dataset, or one split of it, of which only the folder is read; it must be complete."""
    if not is_ready(spark, path):
        raise FileNotFoundError(f"no complete dataset at {path}")
    data = spark.read.parquet(path)
    return data if split is None else data.where(F.col("split") == split)


def newest_file(spark: SparkSession, pattern: str, explicit: str | None = None) -> str:
    """``explicit`` if it exists, else the newest file that matches ``pattern``."""

    def newest(path: str) -> str | None:
        try:
            files = spark.read.format("binaryFile").load(path)
        except AnalysisException:
            return None
        return files.agg(F.max_by("path", "modificationTime").alias("path")).first()["path"]

    found = newest(explicit) if explicit else None
    found = found or newest(pattern)
    if found is None:
        raise FileNotFoundError(f"no file matches {pattern}")
    return found


def resolve_file(
    spark: SparkSession, name: str, directories: Sequence[str], explicit: str | None = None
) -> str:
    """``explicit`` (an error if it is missing), else ``name`` in the first directory with it."""
    candidates = [explicit] if explicit else [f"{d.rstrip('/')}/{name}" for d in directories]
    for path in candidates:
        try:
            if not spark.read.format("binaryFile").load(path).select("path").isEmpty():
                return path
        except AnalysisException:
            continue
    raise FileNotFoundError(f"not found: {', '.join(candidates)}")
