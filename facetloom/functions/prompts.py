"""Persona descriptions and reaction prompts as text expressions."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from facetloom import constants as C
from facetloom.functions.labels import slot_is_sure, tone
from facetloom.functions.text import strip


def json_value(value: Column) -> Column:
    """JSON text of one value, ``null`` for a missing one."""
    boxed = F.to_json(F.array(value), {"ignoreNullFields": "false"})
    return F.substring(boxed, F.lit(2), F.length(boxed) - 2)


def json_members(pairs: Sequence[tuple[str, Column, Column | None]]) -> Column:
    """JSON object from (key, value, keep) entries; entries not kept are absent."""
    members = []
    for key, value, keep in pairs:
        member = F.concat(F.lit(f"{json.dumps(key, ensure_ascii=False)}: "), json_value(value))
        members.append(member if keep is None else F.when(keep, member))
    return F.concat(F.lit("{"), F.concat_ws(", ", *members), F.lit("}"))


def attributes_json(
    columns: Sequence[str],
    text_col: str = "text",
    threshold: float = C.ATTRIBUTE_MIN_CONFIDENCE,
) -> Column:
    """Attributes of a matched row as JSON, without its text and its unsure emotions."""
    pairs: list[tuple[str, Column, Column | None]] = []
    sure = {}
    for slot in range(1, C.ATTRIBUTE_SLOTS + 1):
        both = {f"emo{slot}_label", f"emo{slot}_conf"}
        for name in both:
            sure[name] = slot_is_sure(slot, threshold) if both <= set(columns) else F.lit(False)
    for name in columns:
        if name != text_col:
            pairs.append((name, F.col(name), sure.get(name)))
    return json_members(pairs)


def emotions_json(emotions: Column) -> Column:
    """JSON text of an emotion list."""
    parts = F.transform(
        emotions,
        lambda e: F.concat(
            F.lit('{"label": '), json_value(e["label"]),
            F.lit(', "confidence": '), json_value(e["confidence"]), F.lit("}"),
        ),
    )
    return F.concat(F.lit("["), F.array_join(parts, ", "), F.lit("]"))


def persona_traits(
    persona: Column,
    has_card: Column,
    emotions: Column,
    words: Column,
    avg_sentiment: Column,
    top_emotions: int = 5,
    top_words: int = 6,
) -> Column:
    """Description of a persona from its card; ``emotions`` and ``words`` are name arrays."""

    def listed(names: Column, top: int) -> Column:
        text = F.array_join(F.slice(F.coalesce(names, F.array().cast("array<string>")), 1, top), ", ")
        return F.when(text == "", "n/a").otherwise(text)

    title = F.concat(F.lit(C.TRAITS_PERSONA), persona.cast("string"), F.lit(C.TRAITS_TITLE))
    described = F.concat(
        title,
        F.lit(C.TRAITS_EMOTIONS), listed(emotions, top_emotions),
        F.lit(C.TRAITS_WORDS), listed(words, top_words),
        F.lit(C.TRAITS_TONE), tone(avg_sentiment),
        F.lit("\n"),
    )
    return F.when(has_card, described).otherwise(F.concat(title, F.lit(C.TRAITS_MISSING)))


def build_prompt(
    user_text: Column,
    traits: Column,
    similarity: Column,
    attributes: Column,
    emotions: Column,
    threshold: float = C.SIMILARITY_MIN,
) -> Column:
    """Chat messages as ``array<struct<role, content>>``.

    ``attributes`` is JSON text or null, ``emotions`` an array or null; both are used
    only from ``threshold`` similarity on.
    """
    near = (similarity >= threshold) & attributes.isNotNull() & (attributes != "{}")
    context = F.concat_ws(
        "\n",
        strip(traits),
        F.when(near, F.concat(F.lit(C.PROMPT_SIMILARITY), F.format_string("%.2f", similarity))),
        F.when(near, F.concat(F.lit(C.PROMPT_ATTRIBUTES), attributes)),
        F.when(
            near & (F.size(emotions) > 0),
            F.concat(F.lit(C.PROMPT_EMOTIONS), emotions_json(emotions)),
        ),
    )
    request = F.concat(
        context, F.lit(C.PROMPT_MESSAGE), strip(F.coalesce(user_text, F.lit(""))), F.lit("\n\n" + C.PROMPT_REQUEST)
    )
    return F.array(
        F.struct(F.lit("system").alias("role"), F.lit(C.PROMPT_SYSTEM).alias("content")),
        F.struct(F.lit("user").alias("role"), request.alias("content")),
    )
