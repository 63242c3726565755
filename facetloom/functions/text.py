"""String and date expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from facetloom import constants as C

# Unicode white space, as a set of characters for ``trim``.
WHITESPACE = "".join(
    chr(c)
    for c in (
        *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
        0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
    )
)

TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"


def sql_text(value: str) -> str:
    """A string literal of Spark SQL."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def strip(text: Column) -> Column:
    """Remove white space of any script from both ends."""
    return F.trim(text, F.lit(WHITESPACE))


def parse_year(date: Column) -> Column:
    """Year of a ``23,November,2002`` date, null where it is no date."""
    shaped = F.regexp_extract(strip(date), r"^[0-9]{1,2},\p{L}+,(?!0000)[0-9]{4}$", 0)
    return F.year(F.try_to_timestamp(shaped, F.lit("d,MMMM,yyyy")))


def birth_year(date: Column, age: Column | None = None) -> Column:
    """Estimated birth year: the year of ``date``, or that year less ``age``."""
    year = parse_year(date)
    return year if age is None else (year - to_number(age)).cast("int")


def generation_flag(
    year: Column, start: int = C.COHORT_START, end: int = C.COHORT_END
) -> Column:
    """1 if the year lies in the cohort, both ends included; 0 also for null."""
    return F.coalesce(year.between(start, end).cast("int"), F.lit(0))


def to_number(value: Column) -> Column:
    """The value as a double, null where it is not a number (or is NaN)."""
    number = value.try_cast("double")
    return F.when(~F.isnan(number), number)


def scoring_text(text: Column, missing: str = "") -> Column:
    """Text given to a scorer. ``missing="nan"`` scores a missing text as that word."""
    return F.coalesce(text, F.lit(missing))


def embed_text(text: Column, max_chars: int | None = None) -> Column:
    """Text given to an encoder: null becomes empty.

    The whole text is kept unless ``max_chars`` asks for the clipped form
    (``constants.EMBED_CHARS``) that suits an encoder with a short window.
    """
    whole = F.coalesce(text, F.lit(""))
    return whole if max_chars is None else F.substring(whole, 1, max_chars)


def category_text(value: Column) -> Column:
    """Category as text, ``NA`` for a missing one."""
    return F.coalesce(value.cast("string"), F.lit("NA"))


def text_preview(text: Column, chars: int = C.PREVIEW_CHARS) -> Column:
    """The first characters on one line."""
    return F.replace(F.substring(text, 1, chars), F.lit("\n"), F.lit(" "))


def tokens(text: Column) -> Column:
    """Lower-case words of two or more letters, digits or underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), F.lit(0))


def bigrams(words: Column) -> Column:
    """Pairs of neighbouring words, each joined by a space."""
    count = F.greatest(F.size(words) - 1, F.lit(0))
    pairs = F.zip_with(
        F.slice(words, F.lit(1), count),
        F.slice(words, F.lit(2), count),
        lambda left, right: F.concat_ws(" ", left, right),
    )
    return F.when(count > 0, pairs).otherwise(F.array().cast("array<string>"))
