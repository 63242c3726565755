import pytest
from pyspark.sql import functions as F

from facetloom.functions import labels as L
from facetloom.functions import numeric as N
from facetloom.functions import prompts as P
from facetloom.functions import text as X


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def text(value):
    return F.lit(value).cast("string")


@pytest.mark.parametrize(
    ("date", "year"),
    [
        ("23,November,2002", 2002), ("5,may,2004", 2004), ("31,February,2004", None),
        ("003,May,2004", None), ("3,May,04", None), ("", None), (None, None),
        ("  5,May,2004 \t", 2004), ("5,Mai,2004", None), ("05,DECEMBER,1999", 1999),
        ("5,May,0000", None), ("x5,May,2004", None),
    ],
)
def test_parse_year(spark, date, year):
    assert one(spark, X.parse_year(text(date))) == year


def test_birth_year_modes(spark):
    date = F.lit("5,May,2004")
    assert one(spark, X.birth_year(date)) == 2004
    assert one(spark, X.birth_year(date, F.lit("24"))) == 1980
    assert one(spark, X.birth_year(date, F.lit("junk"))) is None


@pytest.mark.parametrize(("year", "flag"), [(1996, 0), (1997, 1), (2012, 1), (2013, 0), (None, 0)])
def test_generation_flag(spark, year, flag):
    assert one(spark, X.generation_flag(F.lit(year).cast("int"))) == flag


@pytest.mark.parametrize(
    "value", [" a b ", "\x85\x1c a\n", "plain", "", " \t　", "﻿keep", "​keep"]
)
def test_strip_is_the_same_as_in_python(spark, value):
    assert one(spark, X.strip(F.lit(value))) == value.strip()


def test_text_for_models(spark):
    assert one(spark, X.scoring_text(text(None))) == ""
    assert one(spark, X.scoring_text(text(None), "nan")) == "nan"
    assert one(spark, X.embed_text(text(None))) == ""
    long = "x" * 3000
    assert one(spark, X.embed_text(F.lit(long))) == long
    assert len(one(spark, X.embed_text(F.lit(long), 1000))) == 1000
    assert one(spark, X.category_text(text(None))) == "NA"
    assert one(spark, X.text_preview(F.lit("a\nb" * 40))) == ("a\nb" * 40)[:60].replace("\n", " ")


def test_tokens_and_bigrams(spark):
    assert one(spark, X.tokens(F.lit("I can't ÉTÉ été_2 b 42"))) == ["can", "été", "été_2", "42"]
    words = F.array(*[F.lit(w) for w in ("a1", "b2", "c3")])
    assert one(spark, X.bigrams(words)) == ["a1 b2", "b2 c3"]
    assert one(spark, X.bigrams(F.array(F.lit("a1")))) == []
    assert one(spark, X.bigrams(F.array().cast("array<string>"))) == []


@pytest.mark.parametrize(("value", "number"), [("1.5", 1.5), ("x", None), (None, None), ("NaN", None)])
def test_to_number(spark, value, number):
    assert one(spark, X.to_number(text(value))) == number


def test_numbers(spark):
    assert one(spark, N.round_half_even(F.lit(1.015))) == 1.01
    assert one(spark, N.round_half_even(F.lit(0.125))) == 0.12
    assert [one(spark, N.clamp01(F.lit(x))) for x in (-0.2, 0.5, 1.0000001)] == [0.0, 0.5, 1.0]
    unit = one(spark, N.l2_normalize(F.array(F.lit(3.0), F.lit(4.0))))
    assert unit == pytest.approx([0.6, 0.8])
    assert one(spark, N.l2_normalize(F.array(F.lit(0.0), F.lit(0.0)))) == [0.0, 0.0]


def scores(*pairs):
    if not pairs:
        return F.array().cast("array<struct<label: string, score: double>>")
    return F.array(
        *[F.struct(F.lit(n).alias("label"), F.lit(float(s)).alias("score")) for n, s in pairs]
    )


def test_top_labels_keep_the_order_of_ties(spark):
    given = scores(("a", 0.2), ("b", 0.5), ("c", 0.5), ("d", 0.1), ("e", 0.2), ("f", 0.0))
    ranked = one(spark, L.top_k_labels(given))
    assert [r["label"] for r in ranked] == ["b", "c", "a", "e", "d"]
    assert one(spark, L.top_label(given)) == "b"
    assert one(spark, L.top_label(scores())) is None
    short = spark.range(1).select(*L.slot_columns(L.top_k_labels(scores(("a", 1))))).first()
    assert short["emo1_label"] == "a" and short["emo2_label"] is None and short["emo5_conf"] is None


@pytest.mark.parametrize(
    ("label", "sentiment"),
    [("joy", "positive"), ("confusion", "negative"), ("approval", "neutral"), ("desire", "neutral"),
     ("neutral", "neutral"), ("unheard", "neutral"), (None, None)],
)
def test_emotion_to_sentiment(spark, label, sentiment):
    assert one(spark, L.emotion_to_sentiment(text(label))) == sentiment


@pytest.mark.parametrize(
    ("label", "name"),
    [("LABEL_0", "negative"), ("LABEL_1", "neutral"), ("LABEL_2", "positive"), ("x", "neutral"), (None, None)],
)
def test_sentiment_classes(spark, label, name):
    assert one(spark, L.map_sentiment_label(text(label))) == name


@pytest.mark.parametrize(
    ("word", "score"), [(" Positive ", 1.0), ("NEGATIVE", -1.0), ("neutral", 0.0), (None, 0.0)]
)
def test_sentiment_score(spark, word, score):
    assert one(spark, L.sentiment_score(text(word))) == score


@pytest.mark.parametrize(
    ("average", "word"),
    [(0.2, "mixed/neutral"), (0.21, "positive"), (-0.2, "mixed/neutral"), (-0.3, "negative"), (None, "mixed/neutral")],
)
def test_tone(spark, average, word):
    assert one(spark, L.tone(F.lit(average).cast("double"))) == word


def row_with_slots(spark):
    return spark.createDataFrame(
        [("t", "love", 0.85, "joy", 0.84, None, 0.99, "fear", None, "pride", 0.1)],
        "text string, emo1_label string, emo1_conf double, emo2_label string, emo2_conf double,"
        " emo3_label string, emo3_conf double, emo4_label string, emo4_conf double,"
        " emo5_label string, emo5_conf double",
    )


def test_high_conf_emotions_take_slots_one_to_four(spark):
    found = row_with_slots(spark).select(L.high_conf_emotions().alias("v")).first()["v"]
    assert [(e["label"], e["confidence"]) for e in found] == [("love", 0.85)]


def test_attributes_json_drops_text_and_unsure_slots(spark):
    df = row_with_slots(spark)
    found = df.select(P.attributes_json(df.columns).alias("v")).first()["v"]
    assert found == '{"emo1_label": "love", "emo1_conf": 0.85, "emo5_label": "pride", "emo5_conf": 0.1}'


def test_json_value_escapes(spark):
    assert one(spark, P.json_value(F.lit('a"b\nç'))) == '"a\\"b\\nç"'
    assert one(spark, P.json_value(F.lit(None).cast("int"))) == "null"


def test_traits_and_prompt(spark):
    names = F.array(*[F.lit(f"e{i}") for i in range(8)])
    traits = P.persona_traits(F.lit(3), F.lit(True), names, F.array().cast("array<string>"), F.lit(0.5))
    assert one(spark, traits) == (
        "Persona #3 traits:\n- Typical emotions: e0, e1, e2, e3, e4\n"
        "- Common words/phrases: n/a\n- Overall tone tendency: positive\n"
    )
    none = P.persona_traits(F.lit(9), F.lit(False), names, names, F.lit(0.5))
    assert one(spark, none) == "Persona #9 traits: (no card found)"
    emotions = F.array(F.struct(F.lit("joy").alias("label"), F.lit(0.9).alias("confidence")))
    near = one(spark, P.build_prompt(F.lit(" hi "), traits, F.lit(0.4), F.lit('{"a": 1}'), emotions))
    assert [m["role"] for m in near] == ["system", "user"]
    lines = near[1]["content"].split("\n")
    assert lines[4:7] == [
        "Nearest-sample similarity: 0.40",
        'Nearest-sample attributes (no text): {"a": 1}',
        'Nearest-sample high-confidence emotions: [{"label": "joy", "confidence": 0.9}]',
    ]
    assert lines[7:10] == ["", "Message: hi", ""]
    far = one(spark, P.build_prompt(F.lit("hi"), traits, F.lit(0.39), F.lit('{"a": 1}'), emotions))
    assert "Nearest-sample" not in far[1]["content"].split("Message:")[0]
