"""The flat forest against Spark's own, and importance against whole new votes."""

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.linalg import Vectors

from facetloom.operators import forests, ranking


@pytest.fixture(scope="module")
def fitted(spark):
    made = np.random.default_rng(1)
    x = np.round(made.normal(size=(150, 5)), 1)
    label = (x[:, 0] + x[:, 3] * x[:, 1] > 0).astype(int) + (x[:, 1] > 1)
    df = spark.createDataFrame([(i, Vectors.dense(r), float(v)) for i, (r, v) in enumerate(zip(x, label, strict=True))], ["row_id", "features", "label"])
    model = RandomForestClassifier(numTrees=15, maxDepth=4, seed=3).fit(df)
    used = [i for i in range(5) if model.featureImportances[i] > 0]
    guesses = [r["prediction"] for r in model.transform(df).orderBy("row_id").collect()]
    return x[:, used], label, forests.flatten(spark, model, used), np.array(guesses)


def test_flat_forest_guesses_like_spark(fitted):
    x, _, flat, guesses = fitted
    assert (flat.guesses(x) == guesses).all()


@pytest.mark.parametrize("pairs", [40, 1 << 18])
def test_losses_equal_new_votes(fitted, monkeypatch, pairs):
    monkeypatch.setattr(forests, "PAIRS", pairs)
    x, label, flat, _ = fitted
    donor = x[np.random.default_rng(2).permutation(len(x))]
    expected = []
    for f in range(x.shape[1]):
        changed = x.copy()
        changed[:, f] = donor[:, f]
        expected.append(int((flat.guesses(x) == label).sum() - (flat.guesses(changed) == label).sum()))
    before = x.copy()
    assert flat.losses(x, donor, label).tolist() == expected and max(expected) > 10
    assert (x == before).all()


def test_one_row_and_a_single_class(spark):
    df = spark.createDataFrame([(1, 2, Vectors.dense([1.0, 2.0]))], ["row_id", "persona_id", "features"])
    found = ranking.permutation_importance(df, ["a", "b"], trees=3, repeats=2).collect()
    assert [tuple(r) for r in found] == [("a", 0.0, 1), ("b", 0.0, 2)]


def test_rows_that_lead_by_far_and_equal_rows_lose_as_new_votes():
    made = np.random.default_rng(5)
    grower = forests.Grower(trees=40, depth=30, seed=3, width=9, classes=3)
    for x, label in (
        (made.integers(0, 32, (300, 9)).astype(np.uint8), made.integers(0, 3, 300)),
        (made.integers(0, 2, (300, 3)).repeat(3, axis=1).astype(np.uint8), made.integers(0, 3, 300)),
    ):
        found = []
        for t in range(grower.trees):
            weight = made.poisson(1, len(x)).astype(float)
            feature, cut, left, counts = grower.grow(t, 1, x[weight > 0], label[weight > 0], weight[weight > 0])
            table = counts / counts.sum(axis=1, keepdims=True)
            found.append((feature, cut, left, table))
        begin = np.cumsum([0, *[len(f[0]) for f in found]])
        left = np.concatenate([b + f[2] for b, f in zip(begin, found, strict=False)])
        votes = np.round(np.concatenate([f[3] for f in found]) * 2.0**40) / 2.0**40
        flat = forests.FlatForest(
            begin[:-1], np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]), left, left + 1,
            np.arange(len(left)), votes,
        )
        donor = x[made.permutation(len(x))]
        expected = []
        for f in range(x.shape[1]):
            changed = x.copy()
            changed[:, f] = donor[:, f]
            expected.append(int((flat.guesses(x) == label).sum() - (flat.guesses(changed) == label).sum()))
        assert flat.losses(x.copy(), donor, label).tolist() == expected


def noise(spark, rows=400, width=6):
    made = np.random.default_rng(4)
    x = np.round(made.normal(size=(rows, width)), 2)
    label = made.integers(0, 4, rows)
    return spark.createDataFrame([(float(v), Vectors.dense(r)) for r, v in zip(x, label, strict=True)], ["label", "x"]), x, label


def test_a_node_split_by_all_tasks_is_split_alike_in_one(spark, monkeypatch):
    df, x, label = noise(spark)
    cuts = forests.thresholds_of(df.select("x"), "x", 6)
    codes = np.stack([np.searchsorted(c, v) for c, v in zip(cuts, x.T, strict=True)], axis=1).astype(np.uint8)
    seen = []
    for local, parts in ((1 << 24, 1), (200, 3)):
        monkeypatch.setattr(forests, "LOCAL", local)
        forest, used = forests.fit_forest(df.repartition(parts), "x", "label", cuts, 4, 12, 30, 7)
        votes = [forests.FlatForest(forest.roots[[t]], *[getattr(forest, n) for n in ("feature", "threshold", "left", "right", "kind", "votes")]).guesses(codes[:, used]) for t in range(12)]
        seen.append((len(forest.feature), used, np.stack(votes).tolist(), int((forest.guesses(codes[:, used]) == label).sum())))
    assert seen[0] == seen[1]
    # Deep trees learn even labels that nothing tells, by heart.
    assert seen[0][3] > 350


def test_deep_trees_take_no_pass_for_each_part_of_their_nodes(spark):
    """Spark's own fit takes a pass, and a job, for each level at least; here only large nodes do."""
    df, _, _ = noise(spark)
    cuts = forests.thresholds_of(df.select("x"), "x", 6)
    spark.sparkContext.setJobGroup("forest", "forest")
    forests.fit_forest(df, "x", "label", cuts, 4, 12, 30, 7)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("forest")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < len(jobs) < 12


def test_features_are_cut_between_few_values_and_at_quantiles_of_many(spark):
    rows = [(Vectors.dense([7.0, float(i % 3), float(i)]),) for i in range(640)]
    cuts = forests.thresholds_of(spark.createDataFrame(rows, ["x"]).repartition(3), "x", 3)
    assert len(cuts[0]) == 0 and cuts[1].tolist() == [0.5, 1.5]
    assert len(cuts[2]) == 31 and np.abs(cuts[2] - np.arange(20, 640, 20)).max() < 4


@pytest.mark.parametrize("label", [None, -1.0, 0.5])
def test_labels_must_be_whole_numbers(spark, label):
    df = spark.createDataFrame([(1, Vectors.dense([1.0])), (2, Vectors.dense([2.0]))], ["row_id", "features"])
    df = df.selectExpr("row_id", "features", f"if(row_id = 1, {'null' if label is None else label}, 1D) persona_id")
    with pytest.raises(ValueError, match="whole label"):
        ranking.permutation_importance(df, ["a"], trees=2, repeats=1)
