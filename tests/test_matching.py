import json
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import Window
from pyspark.sql import functions as F

from facetloom.operators import cards as K
from facetloom.operators import lookups, matching, scoring, terms
from facetloom.plans import reactions
from facetloom.session import pin
from facetloom.sources.cards import write_cards

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def unit(rows):
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(5)
    held = unit(rng.normal(size=(300, 8))).astype("float32")
    held[100:140] = held[100]
    persona = np.where(np.arange(300) < 200, 0, np.arange(300) % 3 + 1)
    asked = unit(rng.normal(size=(40, 8))).astype("float32")
    asked[0] = held[100]
    wanted = np.arange(40) % 5
    index = spark.createDataFrame(
        [(i, int(persona[i]), [float(x) for x in held[i]]) for i in range(300)],
        "row_id int, persona_id int, vector array<float>",
    ).repartition(7)
    queries = spark.createDataFrame(
        [(i, int(wanted[i]), [float(x) for x in asked[i]]) for i in range(40)],
        "query_id int, persona_id int, vector array<float>",
    ).repartition(3)
    near = np.round(asked.astype("float64") @ held.astype("float64").T, 12)
    return queries, index, near, persona, wanted


def brute(near, persona, wanted, k):
    out = {}
    for q in range(len(wanted)):
        rows = [i for i in range(len(persona)) if persona[i] == wanted[q]]
        best = sorted(rows, key=lambda i: (-near[q, i], i))[:k]
        out.update({(q, rank + 1): i for rank, i in enumerate(best)})
    return out


@pytest.mark.parametrize("k", [1, 3, 500])
@pytest.mark.parametrize("way", ["one pass", "passes", "passes by bytes"])
def test_match_is_exact(tables, k, way, monkeypatch):
    queries, index, near, persona, wanted = tables
    if way == "passes by bytes":
        monkeypatch.setattr(matching, "PASS_BYTES", 2000)
    monkeypatch.setattr(matching, "PAIR_BLOCK", 1 if way == "passes" else 1 << 21)
    rows = matching.match(queries, index, k, 15 if way == "passes" else 4096).collect()
    assert {(r["query_id"], r["rank"]): r["row_id"] for r in rows} == brute(near, persona, wanted, k)
    for r in rows[:20]:
        assert r["similarity"] == pytest.approx(near[r["query_id"], r["row_id"]], abs=1e-12)
    assert not any(r["persona_id"] == 4 for r in rows)


def test_index_stays_in_place(spark, tables):
    """No shuffle below the comparison, and each pass reads the index once."""
    queries, index, near, persona, wanted = tables
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    seen = pin(index).mapInPandas(counted, index.schema)
    asked = queries.where("persona_id < 4")
    rows = matching.match(asked, seen, 2, pass_queries=10).collect()
    expected = brute(near, persona, wanted, 2)
    assert {(r["query_id"], r["rank"]): r["row_id"] for r in rows} == expected
    assert asked.count() == 32 and read.value == 4 * index.count()
    found, _ = matching._one_pass(asked, index.select("row_id", "persona_id", "vector"), 2)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" in plan and "Join" not in plan and "Aggregate" not in plan
    # The repartition of the fixture is the only shuffle of the index.
    assert plan.count("Repartition") == 1 and plan.index("MapInPandas") < plan.index("Repartition")


def test_passes_do_not_grow_with_the_queries(spark, tables, monkeypatch):
    """A small number of queries a pass once made a pass, with a job and a read of the index, for each so many."""
    queries, index, near, persona, wanted = tables
    made = []
    one_pass = matching._one_pass
    monkeypatch.setattr(matching, "_one_pass", lambda *a: made.append(a) or one_pass(*a))
    rows = matching.match(queries, index, 2, pass_queries=1).collect()
    assert {(r["query_id"], r["rank"]): r["row_id"] for r in rows} == brute(near, persona, wanted, 2)
    assert len(made) == matching.PASSES


def test_records_by_shuffle_are_the_same(spark, tables, monkeypatch):
    """Matches that are too many to send meet the index in a shuffle; a popular row serves all its queries."""
    queries, index, *_ = tables
    texts = queries.where("persona_id < 4").withColumn("text", F.concat(F.lit("say "), F.col("query_id").cast("string")))
    popular = texts.withColumn("vector", F.first("vector").over(Window.partitionBy(F.lit(1)).orderBy("query_id")))
    held = index.withColumn("text", F.lit("held")).withColumn("job", F.concat(F.lit("j"), F.col("row_id").cast("string")))
    made = spark.createDataFrame([], "persona_id string, top_emotions array<struct<emotion: string, avg_conf: double>>, top_words array<string>, avg_sentiment_score double")

    def records():
        return sorted(tuple(map(str, r)) for r in matching.match_records(popular, held, made).collect())

    sent = records()
    monkeypatch.setattr(matching, "fits_broadcast", lambda *given: False)
    monkeypatch.setattr(matching, "MATCHED_ROWS", 0)
    monkeypatch.setattr(lookups, "HOT_ROWS", 2)
    assert records() == sent and len(sent) == 32


def test_similarity_gate(spark):
    df = spark.createDataFrame([(1.0000001,), (-0.3,), (0.40,), (0.39,)], "similarity double")
    rows = [tuple(r) for r in matching.similarity_gate(df).collect()]
    assert rows == [(1.0, True), (0.0, False), (0.4, True), (0.39, False)]


ROWS = [
    (1, 3, "happy sunny day", "Leo", "joy", 0.95, "love", 0.2),
    (2, 3, "tired of work", "Aries", "sadness", 0.9, "fear", 0.86),
    (3, 1, "happy sunny day", "Virgo", "joy", 0.9, None, None),
]


@pytest.fixture(scope="module")
def saved(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("match")
    df = spark.createDataFrame(
        ROWS,
        "row_id int, persona_id int, text string, horoscope string, emo1_label string,"
        " emo1_conf double, emo2_label string, emo2_conf double",
    )
    for i in (3, 4):
        df = df.withColumn(f"emo{i}_label", F.lit(None).cast("string")).withColumn(
            f"emo{i}_conf", F.lit(None).cast("double")
        )
    encoder = scoring.fit_text_encoder(df, "text", 64)
    reactions.build_and_save(df, encoder, str(folder / "index"))
    members = df.where("persona_id = 3")
    made = K.persona_cards(members, terms.fit_tfidf(members, "text"))
    write_cards(K.run_summary(made, "rows", 0.1), str(folder / "cards"))
    return encoder, str(folder / "index"), str(folder / "cards")


def test_react(spark, saved):
    encoder, index, cards = saved
    row = reactions.react(spark, " sunny happy day ", index, cards, encoder).first()
    assert (row["matched_row_id"], row["used_attributes"], row["reaction"]) == (1, True, None)
    assert row["error"] and row["similarity"] == pytest.approx(1.0, abs=1e-6)
    sent = json.loads(row["attributes_sent"])
    assert sent == {"row_id": 1, "persona_id": 3, "horoscope": "Leo", "emo1_label": "joy", "emo1_conf": 0.95}
    assert [e["label"] for e in row["high_conf_emotions_sent"]] == ["joy"]
    user = row["prompt_preview"][1]["content"]
    assert user.startswith("Persona #3 traits:\n- Typical emotions: ")
    assert "Message: sunny happy day\n" in user and "happy sunny" in user.split("Nearest")[0]


def test_far_text_sends_nothing(spark, saved):
    encoder, index, cards = saved
    row = reactions.react(spark, "unrelated words only", index, cards, encoder, persona_id=1).first()
    assert not row["used_attributes"]
    assert row["attributes_sent"] is None and row["high_conf_emotions_sent"] is None
    assert "(no card found)" in row["prompt_preview"][1]["content"]
    with pytest.raises(FileNotFoundError):
        reactions.react(spark, "x", index, cards, encoder, persona_id=8)


def test_generator(spark, saved):
    encoder, index, cards = saved

    def make():
        return lambda prompts: [f" reply to {len(json.loads(p))} messages " for p in prompts]

    row = reactions.react(spark, "happy", index, cards, encoder, make_generator=make).first()
    assert (row["reaction"], row["error"]) == ("reply to 2 messages", None)
