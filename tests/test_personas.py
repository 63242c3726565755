import json
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame
from pyspark.storagelevel import StorageLevel

from facetloom.operators import cards as K
from facetloom.operators import clustering, emotions, features, legend, ranking, scoring, terms
from facetloom.palette import CLUSTER_PALETTE
from facetloom.plans import personas
from facetloom.sources.cards import read_cards, write_cards

TEXTS = [
    "the cat sat on the mat", "the dog sat", "a dog and a cat", None, "", "the the the the",
    "cat cat dog bird bird", "on the mat the bird sat",
]


def brute_tfidf(texts, max_features, low, high, min_df):
    """Weights by plain counting."""
    docs = []
    for text in texts:
        words = re.findall(r"\w{2,}", (text or "").lower())
        grams = []
        if low == 1:
            grams += words
        if high == 2:
            grams += [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]
        docs.append(Counter(grams))
    tf, df = Counter(), Counter()
    for d in docs:
        tf.update(d)
        df.update(d.keys())
    vocabulary = sorted((t for t in tf if df[t] >= min_df), key=lambda t: (-tf[t], t))[:max_features]
    out = {}
    for i, d in enumerate(docs):
        raw = {t: d[t] * (math.log((1 + len(docs)) / (1 + df[t])) + 1) for t in vocabulary if d[t]}
        norm = math.sqrt(sum(w * w for w in raw.values()))
        out.update({(i, t): w / norm for t, w in raw.items()})
    return out


@pytest.mark.parametrize(
    ("max_features", "ngrams", "min_df"),
    [(5000, (1, 2), 1), (5, (1, 2), 1), (3, (1, 2), 2), (9, (1, 2), 1), (4, (1, 1), 1), (4, (2, 2), 1)],
)
def test_tfidf(spark, max_features, ngrams, min_df):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "row_id int, text string").repartition(3)
    model = terms.fit_tfidf(df, "text", max_features, ngrams, min_df)
    found = {(r["row_id"], r["term"]): r["weight"] for r in model.long(df, "row_id").collect()}
    assert found == pytest.approx(brute_tfidf(TEXTS, max_features, *ngrams, min_df))


def test_tfidf_of_random_words(spark):
    """Pairs of rare words are passed over only where they cannot get in."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choices(words, [1 / (i + 1) for i in range(40)], k=30)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "row_id int, text string")
    for size in (10, 25, 60):
        model = terms.fit_tfidf(df, "text", size)
        want = brute_tfidf(texts, size, 1, 2, 1)
        assert set(model.terms) == {t for _, t in want}


def test_top_terms_and_no_terms(spark):
    rows = [(0, "aa aa bb"), (0, "cc"), (1, "bb"), (None, "dd")]
    df = spark.createDataFrame(rows, "persona_id int, text string")
    model = terms.fit_tfidf(df, "text", ngrams=(1, 1))
    found = {(r["persona_id"], r["rank"]): r["term"] for r in terms.top_terms(df, model, top=2).collect()}
    assert found == {(0, 1): "cc", (0, 2): "aa", (1, 1): "bb", (1, 2): "aa"}
    with pytest.raises(ValueError):
        terms.fit_tfidf(df.where("false"), "text")


SLOTS = "row_id int, emo1_label string, emo1_conf double, emo2_label string, emo2_conf double, emo9_label string"


def test_emotion_wide(spark):
    rows = [
        (1, " joy ", 0.5, "joy", 0.7, "x"), (2, "fear", None, "joy", 0.1, "x"),
        (3, None, 0.4, "o'fear", 0.2, "x"),
    ]
    wide = emotions.emotion_wide(spark.createDataFrame(rows, SLOTS)).orderBy("row_id")
    assert wide.columns[-2:] == ["emotion_joy", "emotion_o'fear"]
    assert [tuple(r)[-2:] for r in wide.collect()] == [(0.7, 0.0), (0.1, 0.0), (0.0, 0.2)]
    assert emotions.emotion_labels(spark.range(3).toDF("x")) == []


def test_persona_emotions_count_zeros(spark):
    rows = [(1, "joy", 0.5, "fear", 0.2, "x"), (2, "joy", 0.1, "awe", 0.2, "x")]
    df = spark.createDataFrame(rows, SLOTS).withColumn("persona_id", F.lit(0))
    found = [tuple(r) for r in emotions.persona_emotions(df, top=3).orderBy("rank").collect()]
    assert found == [(0, "joy", 0.3, 1), (0, "awe", 0.1, 2), (0, "fear", 0.1, 3)]


def test_most_common_ties_and_nulls(spark):
    rows = [(0, 5, "b"), (0, 1, "a"), (0, 2, None), (0, 3, "b"), (0, 4, "a"), (0, 6, None), (0, 7, "c")]
    df = spark.createDataFrame(rows, "persona_id int, row_id int, job string").repartition(4)
    found = [r["value"] for r in K.most_common(df, "job", top=3).orderBy("rank").collect()]
    assert found == ["a", "nan", "b"]


def test_base_shares(spark):
    sizes = {0: 3395, 1: 17429, 2: 58, 3: 75757}
    df = spark.createDataFrame(list(sizes.items()), "persona_id int, n int").select(
        "persona_id", F.explode(F.expr("sequence(1, n)")).alias("i")
    )
    rows = K.persona_base(df).collect()
    assert {r["persona_id"]: r["size"] for r in rows} == sizes
    assert sum(r["share"] for r in rows) == pytest.approx(1.0)
    assert all(r["share"] == pytest.approx(r["size"] / 96639) for r in rows)
    assert all(r["avg_sentiment_score"] == 0.0 for r in rows)


def test_legend_golden(spark):
    counts = [9056, 21016, 9982, 17058, 5356, 10026, 11108, 13037]
    df = spark.createDataFrame(list(enumerate(counts)), "cluster int, n int").select(
        "cluster", F.explode(F.expr("sequence(1, n)")).alias("i")
    )
    rows = [tuple(r) for r in legend.cluster_legend(df).orderBy("cluster").collect()]
    names = ["steelblue", "lightsteelblue", "darkorange", "lightsalmon", "forestgreen", "lightgreen",
             "crimson", "lightsalmon"]
    assert rows == [(i, c, n) for i, (c, n) in enumerate(zip(counts, names, strict=True))]


def test_legend_wraps_and_keeps_noise_grey(spark):
    df = spark.createDataFrame([(i,) for i in range(-1, 23)], "cluster int")
    table = legend.cluster_legend(df)
    names = {r["cluster"]: r["color_name"] for r in table.collect()}
    assert names[-1] == "darkgray" and names[0] == "steelblue"
    assert names[20] == names[0] and names[22] == names[2] and len(CLUSTER_PALETTE) == 20
    colored = legend.add_cluster_colors(df, table).collect()
    assert all(r["cluster_color_name"] == names[r["cluster"]] for r in colored)


def vectors(spark, rows):
    df = spark.createDataFrame(
        [(i, [float(x) for x in row]) for i, row in enumerate(rows)], "row_id int, v array<double>"
    )
    return df.select("row_id", array_to_vector("v").alias("features"))


def test_numeric_block(spark):
    rows = [(1.0, "3", 1), (2.0, "x", 1), (3.0, "5", 1)]
    df = spark.createDataFrame(rows, "a double, b string, flag int")
    out = features.numeric_block(df, ["a", "b", "flag", "gone"]).collect()
    x = np.array([[1, 3], [2, 4], [3, 5]], dtype=float)
    z = (x - x.mean(0)) / x.std(0)
    norms = np.linalg.norm(z, axis=1, keepdims=True)
    want = np.divide(z, norms, out=np.zeros_like(z), where=norms > 0)
    got = np.array([r["numeric_block"].toArray() for r in out])
    assert got[:, :2] == pytest.approx(want) and (got[:, 2:] == 0).all()
    with pytest.raises(ValueError):
        features.numeric_block(df, ["b"], impute=False)


def test_categorical_block_and_weights(spark):
    rows = [("x", None, [3.0, 4.0]), ("y", "k", [1.0, 0.0])]
    df = spark.createDataFrame(rows, "a string, b string, vector array<float>")
    out = features.categorical_block(df, ["a", "b", "gone"]).collect()
    root = 1 / math.sqrt(3)
    # Categories: a = x, y; b = NA, k; gone = NA.
    assert out[0]["categorical_block"].toArray() == pytest.approx([root, 0, root, 0, root])
    assert out[1]["categorical_block"].toArray() == pytest.approx([0, root, 0, root, root])
    both = features.feature_blocks(df, "vector", [], ["a"], (2.0, 1.0, 3.0)).collect()
    assert both[0]["features"].toArray() == pytest.approx([1.2, 1.6, 3.0, 0.0])


@pytest.mark.parametrize("few", [True, False])
def test_many_categories(spark, few):
    """A million values of one column; positions are in order and every row has its own."""
    many = 1_000_000 if not few else 1000
    df = spark.range(many).select(
        "id", F.format_string("v%07d", "id").alias("own"), F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("third")
    )
    out = features.categorical_block(df, ["own", "third"])
    parts = out.select("id", "third", F.col("categorical_block").alias("v"))
    wrong = parts.mapInPandas(
        lambda batches: (
            b[["id"]][[
                list(v["indices"]) != [i, many + (2 if np.isnan(t) else int(t) - 1)] or v["size"] != many + 3
                for i, t, v in zip(b["id"], b["third"], b["v"], strict=True)
            ]]
            for b in batches
        ),
        "id long",
    )
    assert wrong.count() == 0 and out.count() == many


def test_pca_and_projection_are_centred(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 6)) * [5, 3, 1, 1, 0.5, 0.1] + 7
    df = vectors(spark, x)
    out = features.project_2d(features.reduce_pca(df, 4)).orderBy("row_id").collect()
    reduced = np.array([r["reduced"].toArray() for r in out])
    centred = x - x.mean(0)
    _, _, v = np.linalg.svd(centred, full_matrices=False)
    assert np.abs(reduced) == pytest.approx(np.abs(centred @ v[:4].T), abs=1e-8)
    flat = np.array([[r["x2d"], r["y2d"]] for r in out])
    assert np.abs(flat) == pytest.approx(np.abs(reduced[:, :2]), abs=1e-8)
    same = features.reduce_pca(df, 50).first()
    assert same["reduced"] == same["features"]


@pytest.mark.parametrize("exact", [512, 0])
def test_pca_of_wide_sparse_rows(spark, monkeypatch, exact):
    """100,000 columns through a basis of a few; with all directions, inner products are those of the centred rows."""
    monkeypatch.setattr(features, "EXACT_WIDTH", exact)
    rng = np.random.default_rng(4)
    width = 100_000 if not exact else 30
    shared = rng.choice(width, (3, 8), replace=False)
    x = [{int(j): 5.0 + rng.random() for j in shared[i % 3]} | {int(j): 0.1 for j in rng.integers(0, width, 2)} for i in range(60)]
    df = spark.createDataFrame([(i, Vectors.sparse(width, v)) for i, v in enumerate(x)], ["row_id", "features"]).repartition(3)
    out = features.reduce_pca(df, 2 if not exact else 29).orderBy("row_id").collect()
    got = np.array([r["reduced"].toArray() for r in out])
    used = sorted({j for v in x for j in v})
    plain = np.array([[v.get(j, 0.0) for j in used] for v in x])
    centred = plain - plain.mean(axis=0)
    if exact:
        assert got @ got.T == pytest.approx(centred @ centred.T, abs=1e-8)
    else:
        u, s, _ = np.linalg.svd(centred, full_matrices=False)
        assert np.abs(got) == pytest.approx(np.abs(u[:, :2] * s[:2]), abs=1e-3)


def test_svd(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 12)) * np.linspace(9, 0.5, 12) * (rng.random((40, 12)) < 0.6)
    df = vectors(spark, x)
    out = features.svd(df, 4, "features").orderBy("row_id").collect()
    got = np.array([r["svd"].toArray() for r in out])
    u, s, v = np.linalg.svd(x, full_matrices=False)
    assert np.abs(got) == pytest.approx(np.abs(u[:, :4] * s[:4]), abs=1e-6)


def planted(spark, per=40, centres=((0, 0), (9, 0), (0, 9)), seed=2):
    rng = np.random.default_rng(seed)
    rows = np.concatenate([rng.normal(c, 0.4, size=(per, 2)) for c in centres])
    return vectors(spark, rows), np.repeat(np.arange(len(centres)), per)


def test_choose_k_finds_planted_clusters(spark):
    df, truth = planted(spark)
    chosen = clustering.choose_k(df, kmax=5, restarts=2)
    assert chosen.k == 3 and chosen.score > 0.8 and [k for k, _ in chosen.tried] == [2, 3, 4, 5]
    rows = clustering.assign_personas(df, chosen).orderBy("row_id").collect()
    pairs = {(truth[r["row_id"]], r["persona_id"]) for r in rows}
    assert len(pairs) == 3
    same = clustering.kmeans(df, 3, "features")
    assert same.select("cluster").distinct().count() == 3


def test_choose_k_of_equal_rows(spark):
    chosen = clustering.choose_k(vectors(spark, [[1, 1]] * 6), kmax=3, restarts=1)
    assert (chosen.k, chosen.score) == (2, -1.0)


def test_density_clusters(spark):
    rng = random.Random(6)
    line = [(x / 4, 0.2) for x in range(200)]
    blob = [(80 + rng.random(), 5 + rng.random()) for _ in range(300)]
    spot = [(30.0, 30.0)] * 500
    few = [(60.0, 60.0)] * 8
    alone = [(-40.0, 3.0), (None, 1.0)]
    points = [*line, *blob, *spot, *few, *alone]
    df = spark.createDataFrame(
        [(i, *p) for i, p in enumerate(points)], "row_id int, x double, y double"
    ).repartition(6)
    rows = clustering.density_clusters(df, ["x", "y"], 1.0, 5, 30, spread_by=["row_id"]).collect()
    found = {r["row_id"]: r["cluster"] for r in rows}
    assert len(found) == len(points)
    edges = [0, len(line), len(line) + len(blob), len(line) + len(blob) + len(spot)]
    groups = [{found[i] for i in range(a, b)} for a, b in zip(edges, edges[1:], strict=False)]
    assert [len(g) for g in groups] == [1, 1, 1]
    assert sorted(set.union(*groups)) == [0, 1, 2]
    assert {found[i] for i in range(edges[-1], len(points))} == {-1}


def test_binning(spark):
    df = spark.createDataFrame([(0.0, 1.0), (5.0, 1.0), (10.0, None)], "a double, b double")
    rows = ranking.binned(df, ["a", "b"], 4).collect()
    assert [tuple(r) for r in rows] == [(0, 0), (2, 0), (3, None)]
    cut = ranking.binned(spark.range(100).select(F.col("id").cast("double").alias("a")), ["a"], 4, "quantile")
    assert sorted(r["count"] for r in cut.groupBy("a").count().collect()) == [25, 25, 25, 25]


def test_mutual_information(spark):
    rows = [(i % 4, str(i % 4), "c", str(i % 2)) for i in range(80)]
    df = spark.createDataFrame(rows, "persona_id int, same string, flat string, half string")
    found = [tuple(r) for r in ranking.mutual_information(df, ["flat", "half", "same"]).collect()]
    assert [f[0] for f in found] == ["same", "half", "flat"]
    assert [f[1] for f in found] == pytest.approx([math.log(4), math.log(2), 0.0])
    assert [f[2] for f in found] == [1, 2, 3]


def test_vector_information(spark):
    rows = [(i % 4, Vectors.dense([float(i % 4), 7.0, float(i % 2)])) for i in range(80)]
    df = spark.createDataFrame([*rows, (None, rows[0][1])], ["persona_id", "features"])
    found = [tuple(r) for r in ranking.vector_information(df, ["same", "flat", "half"]).collect()]
    assert [f[0] for f in found] == ["same", "half", "flat"]
    assert [f[1] for f in found] == pytest.approx([math.log(4), math.log(2), 0.0])
    empty = ranking.vector_information(df.limit(0), ["a", "b"]).collect()
    assert [tuple(r) for r in empty] == [("a", 0.0, 1), ("b", 0.0, 2)]


def test_information_of_sparse_vectors(spark):
    """Dense, sparse and mixed rows give the same scores as a crosstab of the written-out bins."""
    rng = np.random.default_rng(9)
    x = np.round(rng.normal(size=(120, 5)), 1) * (rng.random((120, 5)) < [0.1, 0.5, 0.9, 0.3, 0.0])
    label = [["a", "b", "c"][int(v > 0) + int(w > 0.5)] for v, w in zip(x[:, 1], x[:, 2], strict=True)]
    names = list("vwxyz")

    def scored(form):
        rows = [
            (t, Vectors.sparse(5, {j: float(v) for j, v in enumerate(r) if v}) if form(i) else Vectors.dense(r))
            for i, (t, r) in enumerate(zip(label, x, strict=True))
        ]
        df = spark.createDataFrame(rows, ["persona_id", "features"]).repartition(3)
        return [(r["feature"], round(r["score"], 9)) for r in ranking.vector_information(df, names).collect()]

    cut = ranking.binned(spark.createDataFrame([(t, *map(float, r)) for t, r in zip(label, x, strict=True)], ["persona_id", *names]), names, 10)
    want = [(r["feature"], round(r["score"], 9)) for r in ranking.mutual_information(cut, names).collect()]
    assert scored(lambda i: False) == scored(lambda i: True) == scored(lambda i: i % 3 == 0) == want


def test_permutation_importance(spark):
    rng = np.random.default_rng(3)
    noise = rng.normal(size=(200, 3))
    label = (noise[:, 1] > 0).astype(int)
    df = vectors(spark, noise).join(
        spark.createDataFrame([(i, int(v)) for i, v in enumerate(label)], "row_id int, persona_id int"),
        "row_id",
    )
    rows = ranking.permutation_importance(df, ["a", "b", "c"], repeats=2, trees=10).collect()
    scores = {r["feature"]: r["score"] for r in rows}
    assert rows[0]["feature"] == "b" and 0.3 < scores["b"] < 0.7
    assert abs(scores["a"]) < 0.1 and abs(scores["c"]) < 0.1


@pytest.mark.parametrize("rows", [2, 9, 360])
def test_shuffles_are_one_to_one(rows):
    rng = random.Random(0)
    for _ in range(20):
        step, shift = ranking._affine_shuffle(rows, rng)
        assert sorted((step * i + shift) % rows for i in range(rows)) == list(range(rows))


def blog_rows(spark, n=120):
    rng = random.Random(8)
    words = {0: ["love", "happy", "sun", "smile"], 1: ["rain", "work", "tired", "late"]}
    rows = []
    for i in range(n):
        kind = i % 2
        text = " ".join(rng.choices(words[kind], k=6))
        label = "joy" if kind == 0 else "sadness"
        rows.append(
            (i, text, label, "positive" if kind == 0 else "negative", label, 0.95, "neutral", 0.02,
             rng.choice(["Leo", "Virgo"]), "Student" if kind == 0 else None, 1 if i % 10 else 0)
        )
    return spark.createDataFrame(
        rows,
        "row_id int, text string, top_emotion string, reddit_sentiment string, emo1_label string,"
        " emo1_conf double, emo2_label string, emo2_conf double, horoscope string, job string, is_genz int",
    ).repartition(3)


def test_map_and_profiles(spark):
    df = blog_rows(spark)
    encoder = scoring.fit_text_encoder(df, "text", 32)
    table, key = personas.map_clusters(df, encoder, k=2, limit=100, dimensions=5, keep=["row_id"])
    rows = table.collect()
    assert len(rows) == 90 and {r["cluster"] for r in rows} == {0, 1}
    assert {r["cluster"]: r["count"] for r in key.collect()} == dict(Counter(r["cluster"] for r in rows))
    dense, _ = personas.map_clusters(df, encoder, dimensions=5, density=10.0)
    assert dense.columns == table.drop("row_id").columns and dense.agg({"cluster": "max"}).first()[0] <= 0
    profile = personas.profile_clusters(table.drop("row_id"), max_cardinality=20)
    tests = {r["feature"]: r for r in profile.tests.collect()}
    assert tests["top_emotion"]["p_value"] < 1e-6 and "text" not in tests
    assert profile.numbers.count() == 2


def test_discover_personas(spark, tmp_path):
    df = blog_rows(spark)
    run = personas.discover_personas(df, "rows.csv", kmax=3, restarts=2, trees=10, repeats=2)
    assert run.assignments.columns == [*df.columns, "persona_id"]
    path = str(tmp_path / "cards")
    write_cards(run.summary, path)
    line = json.loads(next(iter(spark.read.text(path).collect()))["value"])
    assert list(line) == ["source_csv", "n_rows", "n_personas", "silhouette", "feature_importance", "personas"]
    assert (line["n_rows"], line["n_personas"], line["source_csv"]) == (120, 2, "rows.csv")
    ranked = line["feature_importance"]
    told = {r["feature"] for r in ranked["mutual_information_top30"]}
    assert any(n.startswith("text_svd_") for n in told) and "top_emotion_joy" in told
    scores = [r["score"] for r in ranked["permutation_importance_top30"]]
    assert scores == sorted(scores, reverse=True)
    cards = {r["persona_id"]: r for r in read_cards(spark, path).collect()}
    assert set(cards) == {"0", "1"}
    happy = next(c for c in cards.values() if c["avg_sentiment_score"] == 1.0)
    assert happy["size"] == 60 and happy["share"] == 0.5 and happy["job_top"] == ["Student"]
    assert happy["top_emotions"][0]["emotion"] == "joy"
    assert {"love", "happy", "sun", "smile"} <= set(happy["top_words"])
    sad = next(c for c in cards.values() if c["avg_sentiment_score"] == -1.0)
    assert sad["job_top"] == ["nan"]


def test_features_are_named(spark):
    df, names = features.persona_features(blog_rows(spark), dimensions=6)
    width = len(df.first()["features"])
    assert len(names) == width
    assert names[:2] == ["text_svd_0", "text_svd_1"] and "job_NA" in names
    assert names[-1] == "emotion_sadness" and "sentiment_score" in names
    deviations = df.select(vector_to_array("features").alias("f")).select(
        *[F.stddev_samp(F.col("f")[i]).alias(str(i)) for i in range(width)]
    ).first()
    assert all(d == pytest.approx(1.0) or d == pytest.approx(0.0) for d in deviations)


def test_terms_are_counted_as_columns(spark):
    """Each occurrence was once a row of its own; now some rows are counted at a time, nulls and empty texts too."""
    df = spark.createDataFrame([("ab cd ab",), ("",), (None,), ("cd ab",), ("é_1 ab",)], "text string")
    stats = terms.term_stats(df, "text", (1, 1))
    assert "Generate explode(array(struct" not in stats._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in stats._jdf.queryExecution().optimizedPlan().toString()
    assert {(r["term"], r["tf"], r["df"]) for r in stats.collect()} == {("ab", 4, 3), ("cd", 2, 2), ("é_1", 1, 1)}
    pairs = {(r["term"], r["tf"], r["df"]) for r in terms.term_stats(df, "text", (2, 2)).collect()}
    assert pairs == {("ab cd", 1, 1), ("cd ab", 2, 2), ("é_1 ab", 1, 1)}


def test_the_text_is_read_once_for_each_use(spark):
    """Words, pairs, entries and the result; passes, scales and widths go over the entries."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def read(text):
        seen.add(1)
        return text

    rows = blog_rows(spark).withColumn("text", read.asNondeterministic()("text"))
    df, names = features.persona_features(rows, dimensions=6)
    assert {len(r["features"]) for r in df.select("features").collect()} == {len(names)}
    assert seen.value <= 4 * 120


@pytest.mark.parametrize(("size", "ngrams"), [(5000, (1, 2)), (3, (1, 2)), (9, (2, 2)), (4, (1, 1))])
def test_entries_are_the_vectors_of_transform(spark, size, ngrams):
    texts = ["love sun sun love sun", "rain", "", None, "zz yy love sun", "sun love", "a b rain rain rain"]
    df = spark.createDataFrame(list(enumerate(texts)), "row_id int, text string")
    model = terms.fit_tfidf(df, "text", size, ngrams)
    both = model.entries(model.transform(df, "v"), "e").orderBy("row_id").collect()
    for r in both:
        assert r["e"]["indices"] == r["v"].indices.tolist()
        assert r["e"]["values"] == pytest.approx(r["v"].values.tolist(), abs=1e-12)


def test_the_map_keeps_vectors_alone_and_on_disk(spark, monkeypatch):
    """A text is kilobytes; kept beside the vectors, every pass would read it, and executors' memory would hold it."""
    kept = []
    persist = DataFrame.persist

    def noted(self, level=StorageLevel.MEMORY_AND_DISK_DESER):
        kept.append((self.columns, level))
        return persist(self, level)

    monkeypatch.setattr(DataFrame, "persist", noted)
    df = blog_rows(spark)
    encoder = scoring.fit_text_encoder(df, "text", 32)
    table, key = personas.map_clusters(df, encoder, k=2, dimensions=5, keep=["row_id"])
    assert {r["cluster"]: r["count"] for r in key.collect()} == dict(Counter(r["cluster"] for r in table.collect()))
    assert len(kept) >= 2 and all("text" not in columns and not level.useMemory for columns, level in kept)
