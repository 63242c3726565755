"""Blog files: one row per text line."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from facetloom import constants as C
from facetloom.functions.text import strip
from facetloom.operators.lookups import lookup
from facetloom.operators.ordering import split_by_index

# A line start before a line that holds a date tag.
_DATE_LINE = r"(?md)^(?=[^\n]*<date>)"


def list_blog_files(spark: SparkSession, directory: str) -> DataFrame:
    """The ``*.xml`` files right under ``directory``; FileNotFoundError without any.

    Content is read only if a later step asks for the column.
    """
    base = directory.rstrip("/")
    try:
        found = (
            spark.read.format("binaryFile").option("pathGlobFilter", "*.xml").load(base)
        )
    except AnalysisException as error:
        raise FileNotFoundError(f"cannot list blog files in {directory}: no such folder") from error
    files = found.select("path", "content")
    if files.select("path").isEmpty():
        raise FileNotFoundError(f"{directory} holds no blog file (*.xml)")
    return files


def author_columns(path: Column) -> list[Column]:
    """Author attributes from ``<id>.<gender>.<age>.<job>.<horoscope>.xml``.

    A name of another shape, or an age that is no whole number, fails the job.
    """
    name = F.substring_index(path, "/", -1)
    parts = F.split(name, r"\.")
    shaped = F.size(parts) == 6
    wrong = F.raise_error(
        F.concat(
            F.lit("file name is not <id>.<gender>.<age>.<job>.<horoscope>.xml: "), name
        )
    )

    def part(i: int) -> Column:
        return F.when(shaped, F.get(parts, F.lit(i))).otherwise(wrong.cast("string"))

    age = strip(part(2))
    whole = age.rlike(r"^[+-]?[0-9]+$")
    bad_age = F.raise_error(F.concat(F.lit("age is not a whole number: "), name)).cast("int")
    return [
        part(1).alias("gender"),
        F.when(whole, age.cast("int")).otherwise(bad_age).alias("age"),
        part(3).alias("job"),
        part(4).alias("horoscope"),
    ]


def text_lines(df: DataFrame, content: str) -> DataFrame:
    """Explode blog content into text lines with their date; other columns stay.

    ``post_no`` and ``line_no`` order the lines of a file. The content is cut before each
    line with a date tag, so a piece has one date and the date needs no window: the file
    is never shuffled.
    """
    keep = [c for c in df.columns if c != content]
    unix = F.regexp_replace(F.col(content), "\r\n?", "\n")
    posts = df.select(
        *keep, F.posexplode(F.split(unix, _DATE_LINE)).alias("post_no", "_post")
    )
    head = strip(F.substring_index("_post", "\n", 1))
    date = F.substring_index(F.substring_index(head, "<date>", -1), "</date>", 1)
    dated = posts.withColumn(
        "date", F.when(head.contains("<date>"), date).otherwise(F.lit(""))
    )
    lines = dated.select(
        *keep, "post_no", "date", F.posexplode(F.split("_post", "\n")).alias("line_no", "_line")
    )
    text = strip(F.col("_line"))
    return (
        lines.withColumn("text", text)
        .where((F.col("text") != "") & ~F.col("text").contains("<date>"))
        .where(~F.col("text").startswith("<"))
        .select(*keep, "post_no", "line_no", "text", "date")
    )


def read_blog_files(spark: SparkSession, directory: str) -> DataFrame:
    """``path, post_no, line_no, text, date, gender, age, job, horoscope`` of all files."""
    files = list_blog_files(spark, directory)
    decoded = files.select(
        "path", *author_columns(F.col("path")), F.decode("content", "ISO-8859-1").alias("_content")
    )
    return text_lines(decoded, "_content").select(
        "path", "post_no", "line_no", "text", "date", "gender", "age", "job", "horoscope"
    )


def build_dataset(
    spark: SparkSession, directory: str, every: int = C.VALIDATION_EVERY
) -> DataFrame:
    """Blog lines with ``file_idx`` and ``split``; an author is in one split only."""
    lines = read_blog_files(spark, directory)
    splits = split_by_index(list_blog_files(spark, directory).select("path"), every)
    return lookup(lines, splits, ["path"], "inner", spread_by=["post_no", "line_no"])
