import hashlib
import random
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from facetloom.operators import columns, lookups, ordering, scoring
from facetloom.plans import enrichment
from facetloom.schemas import CLUSTERED

# The models below run on the workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def test_require_and_ensure_columns(spark):
    df = spark.createDataFrame([(1, "x")], "cluster int, job string")
    with pytest.raises(ValueError, match="text"):
        columns.require_columns(df, ["job", "text"])
    wide = columns.ensure_columns(df, CLUSTERED)
    assert wide.columns == CLUSTERED.names
    row = wide.first()
    assert (row["job"], row["cluster"], row["x2d"]) == ("x", 1, None)


def test_column_selection(spark):
    df = spark.createDataFrame(
        [("t", "Leo", 1, True, 2.0, "a")],
        "text string, horoscope string, cluster int, flag boolean, x double, color_name string",
    )
    assert columns.select_categoricals(df) == ["horoscope", "color_name", "text"]
    assert columns.select_numerics(df) == ["flag", "x"]
    many = spark.range(50).select(F.col("id").cast("string").alias("text"), F.lit("a").alias("kind"))
    assert columns.select_categoricals(many, max_cardinality=10) == ["kind"]


GATE_ROWS = [
    ("joy", "positive", "positive", 0.90, 0.90), ("joy", "positive", "negative", 0.95, 0.99),
    ("joy", "positive", "positive", 0.89, 0.99), (None, None, "positive", None, 0.99),
    ("joy", "positive", None, 0.95, None), ("joy", "positive", "neutral", float("nan"), 0.95),
]
GATE_SCHEMA = (
    "top_emotion string, emotion_sentiment string, reddit_sentiment string, emotion_conf double,"
    " reddit_conf double"
)


def test_gate_masking_and_report(spark):
    df = spark.createDataFrame(GATE_ROWS, GATE_SCHEMA)
    kept = columns.add_masking(columns.confidence_gate(df)).collect()
    assert sorted(r["masking"] for r in kept) == [0, 1]
    report = columns.quality_report(df).first()
    assert tuple(report) == (6, 2, 4, 0.5)
    empty = columns.quality_report(df.limit(0)).first()
    assert tuple(empty) == (0, 0, 0, 0.0)


def test_drop_text_and_low_conf(spark):
    df = spark.createDataFrame(
        [(1, "secret", "joy", 0.9, "fear", 0.2, "pride")],
        "id int, text string, emo1_label string, emo1_conf double, emo2_label string,"
        " emo2_conf double, emo5_label string",
    )
    row = columns.drop_text_and_low_conf(df).first().asDict()
    assert row == {
        "id": 1, "emo1_label": "joy", "emo1_conf": 0.9, "emo2_label": None, "emo2_conf": None,
        "emo5_label": "pride",
    }


@pytest.fixture(scope="module")
def ids(spark):
    values = random.Random(1).sample(range(-(10**12), 10**12), 500)
    df = spark.createDataFrame([(v,) for v in values], "row_id bigint").repartition(7)
    return df, sorted(values)


@pytest.mark.parametrize(
    ("start", "end", "limit"),
    [(1, 10, None), (100, 250, None), (None, 3, 9), (490, None, None), (490, 900, None),
     (600, 700, None), (None, None, 5), (None, None, 0), (None, None, None), (None, 0, None)],
)
def test_row_range(ids, start, end, limit):
    df, values = ids
    if start is None and end is None:
        want = values[:limit] if limit else values
    else:
        want = values[(start or 1) - 1 : end]
    found = ordering.row_range(df, start, end, limit=limit)
    assert sorted(r["row_id"] for r in found.collect()) == want


def test_limit_comes_before_the_filter(spark):
    df = spark.range(20).select(F.col("id").alias("row_id"), (F.col("id") % 3 == 0).cast("int").alias("is_genz"))
    found = ordering.limit_then_filter(df.repartition(4), 7)
    assert sorted(r["row_id"] for r in found.collect()) == [0, 3, 6]
    assert ordering.limit_then_filter(df.drop("is_genz"), 7).count() == 7


def test_global_index_and_split(spark):
    names = [f"f{i:03d}" for i in range(95)]
    df = spark.createDataFrame([(n,) for n in names], "path string").repartition(9)
    rows = {r["path"]: (r["file_idx"], r["split"]) for r in ordering.split_by_index(df).collect()}
    assert rows == {
        n: (i, "validation" if i % 20 == 0 else "train") for i, n in enumerate(names)
    }
    assert ordering.split_by_index(df.limit(0)).count() == 0


@pytest.mark.parametrize("chunk", [1, 3, 100])
def test_carry_forward_over_chunks(spark, chunk):
    rng = random.Random(2)
    rows = [(g, i, rng.choice([None, None, str(i)])) for g in ("a", "b", None) for i in range(25)]
    df = spark.createDataFrame(rows, "g string, i bigint, v string").repartition(5)
    found = ordering.carry_forward(df, ["g"], "i", F.col("v"), "last", chunk).collect()
    want, last = {}, {}
    for g, i, v in rows:
        last[g] = v if v is not None else last.get(g)
        want[g, i] = last[g]
    assert {(r["g"], r["i"]): r["last"] for r in found} == want


@pytest.mark.parametrize("how", ["left", "inner"])
def test_lookup_by_broadcast_and_by_salt(spark, how, monkeypatch):
    monkeypatch.setattr(lookups, "HOT_ROWS", 500)
    df = spark.range(3000).select(
        F.col("id"), F.when(F.col("id") % 3 > 0, 7).when(F.col("id") % 9 > 0, F.col("id")).alias("k")
    )
    table = spark.range(1500).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    small = lookups.lookup(df, table, ["k"], how)
    large = lookups.lookup(df, table, ["k"], how, spread_by=["id"], max_rows=10)
    assert "_salt" in large._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(str, small.collect())) == sorted(map(str, large.collect()))


def test_hash_and_lexicon_scorers_agree(spark):
    texts = ["one two three two", "zebra apple", "", None, "x y z", "ünder straße one one"]
    df = spark.createDataFrame(list(enumerate(texts)), "row_id int, text string")
    lexicon = scoring.corpus_lexicon(df, "text")
    hashed = scoring.score_labels(df, "text", scoring.HashScorer())
    looked = scoring.score_labels(df, "text", scoring.LexiconScorer(lexicon, "row_id"))

    def table(rows):
        return {
            r["row_id"]: {s["label"]: round(s["score"], 9) for s in r["scores"]} for r in rows.collect()
        }

    assert table(hashed) == table(looked)
    assert table(hashed)[2] == {} and table(hashed)[3] == {}
    with pytest.raises(ValueError):
        scoring.score_labels(df, "text", scoring.HashScorer([str(i) for i in range(90)]))


def emotion_model():
    def model(texts):
        if len(texts) > 1 and "bad" in texts:
            raise ValueError("batch refused")
        if texts == ["bad"]:
            raise ValueError("text refused")
        return [
            [{"label": "joy", "score": 0.95}, {"label": "fear", "score": len(t) / 100}]
            if t != "odd" else "no scores"
            for t in texts
        ]

    return model


def sentiment_model():
    return lambda texts: [{"label": f"LABEL_{len(t) % 3}", "score": 0.97} for t in texts]


def test_model_failures_stay_in_their_row(spark):
    df = spark.createDataFrame([("good",), ("bad",), ("odd",), (None,)], "text string").coalesce(1)
    rows = scoring.score_emotions(df, "text", scoring.ModelScorer(emotion_model)).collect()
    assert [r["top_emotion"] for r in rows] == ["joy", None, None, "joy"]
    assert [r["emo2_conf"] for r in rows] == [0.04, None, None, 0.0]
    assert rows[0]["emo3_label"] is None


def test_sentiment_window(spark):
    df = spark.createDataFrame([("aa bb cc dd",)], "text string")
    model = scoring.ModelScorer(sentiment_model)
    whole = scoring.score_sentiment(df, "text", model).first()
    cut = scoring.score_sentiment(df, "text", model, max_tokens=2).first()
    assert whole["reddit_sentiment"] == "positive"
    assert cut["reddit_sentiment"] == "positive" and cut["text"] == "aa bb cc dd"


def test_enrich(spark):
    rows = [("good day", "23,November,2002", 20), ("bad", "1,May,2001", 20), ("fine then", "x", 20)]
    df = spark.createDataFrame(rows, "text string, date string, age int")
    out = enrichment.enrich(
        df, scoring.ModelScorer(emotion_model), scoring.ModelScorer(sentiment_model)
    )
    found = {r["text"]: (r["birth_year_est"], r["is_genz"], r["masking"]) for r in out.collect()}
    assert found == {"good day": (2002, 1, 0), "fine then": (None, 0, 1)}
    with pytest.raises(ValueError):
        enrichment.enrich(df.drop("date"), scoring.HashScorer(), scoring.HashScorer())


def test_embedding_by_model_and_by_hash(spark):
    df = spark.createDataFrame([("ab",), (None,), ("cd ef gh",)], "text string")

    def make():
        return lambda texts: [[3.0 * len(t), 4.0 * len(t)] for t in texts]

    rows = scoring.embed(df, "text", make).collect()
    assert rows[0]["vector"] == pytest.approx([0.6, 0.8]) and rows[1]["vector"] == [0.0, 0.0]
    encoder = scoring.fit_text_encoder(df, "text", 32)
    again = scoring.embed(df, "text", encoder).collect()
    assert len(again[2]["vector"]) == 32
    assert sum(x * x for x in again[2]["vector"]) == pytest.approx(1.0, abs=1e-5)


def test_rows_can_be_streamed(spark, tmp_path):
    """The per-row operators work on a streaming table as they are."""
    spark.createDataFrame([("good day", "5,May,2004")], "text string, date string").write.parquet(
        str(tmp_path / "in")
    )
    stream = spark.readStream.schema("text string, date string").parquet(str(tmp_path / "in"))
    scored = enrichment.enrich(
        stream, scoring.HashScorer(), scoring.HashScorer(("LABEL_0",)), min_confidence=0.1
    )
    query = scored.writeStream.format("memory").queryName("enriched").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("enriched").count() == 1


def test_votes_are_counted_as_columns(spark, monkeypatch):
    """A different word of a batch is hashed once, not each occurrence; the scores are those of single words."""
    monkeypatch.setattr(scoring, "VOTE_ROWS", 2)
    texts = ["one two one", "", None, "a", "one", "Two TWO three"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "row_id int, text string").coalesce(1)
    labels = ("x", "y", "z")
    scored = scoring.score_labels(df, "text", scoring.HashScorer(labels))
    assert "md5(" not in scored._jdf.queryExecution().optimizedPlan().toString()

    def want(text):
        words = [w for w in (text or "").lower().split() if len(w) > 1]
        votes = [labels[int(hashlib.md5(w.encode()).hexdigest()[:2], 16) % 3] for w in words]
        return [(label, votes.count(label) / len(words)) for label in labels if label in votes]

    assert {r["row_id"]: [tuple(e) for e in r["scores"]] for r in scored.collect()} == {
        i: want(t) for i, t in enumerate(texts)
    }
