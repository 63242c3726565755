"""Packed trees against whole forests, and what their votes lose against whole new votes."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from facetloom.operators import forests, ranking, trees


def made_forest(x, label, number, depth=30, classes=3, seed=3):
    made = np.random.default_rng(seed)
    grower = forests.Grower(trees=number, depth=depth, seed=seed, width=x.shape[1], classes=classes)
    found = []
    for t in range(number):
        weight = made.poisson(1, len(x)).astype(float)
        drawn = weight > 0
        feature, cut, left, counts = grower.grow(t, 1, x[drawn], label[drawn], weight[drawn])
        tree = trees.Tree.unpacked(trees.Top(), {1: trees.pack(feature, cut, counts, x.shape[1])}, x.shape[1], classes)
        assert (tree.feature == feature).all() and (tree.left[feature >= 0] == left[feature >= 0]).all()
        found.append(tree)
    return found


def all_votes(found, x, classes=3):
    votes = np.zeros((len(x), classes))
    for tree in found:
        tree.vote(votes, np.arange(len(x)), tree.follow(x))
    return votes.argmax(axis=1)


def expected(found, x, donor, label):
    before = int((all_votes(found, x) == label).sum())
    out = []
    for f in range(x.shape[1]):
        lost = 0
        for r in range(donor.shape[2]):
            changed = x.copy()
            changed[:, f] = donor[:, f, r]
            lost += before - int((all_votes(found, changed) == label).sum())
        out.append(lost)
    return out


@pytest.mark.parametrize(("values", "repeats", "number", "depth"), [(32, 8, 20, 30), (32, 3, 7, 4), (9, 9, 260, 3), (2, 2, 12, 30)])
def test_losses_equal_new_votes(monkeypatch, values, repeats, number, depth):
    monkeypatch.setattr(trees, "ROWS", 50)
    monkeypatch.setattr(trees, "CASES", 64)
    made = np.random.default_rng(5)
    x = made.integers(0, values, (180, 6)).astype(np.uint8)
    label = (x[:, 0] > values // 2) + (x[:, 1] + made.integers(0, 2, 180) > values // 2).astype(int)
    found = made_forest(x, label, number, depth)
    donor = np.stack([x[made.permutation(len(x))] for _ in range(repeats)], axis=2)
    lost = trees.block_losses(lambda: iter(found), x, donor, label, 3)
    assert lost.tolist() == expected(found, x, donor, label) and lost.max() > 10


def test_equal_rows_vote_once_and_lose_alike():
    made = np.random.default_rng(6)
    x = made.integers(0, 3, (600, 2)).astype(np.uint8)
    label = made.integers(0, 3, 600)
    found = made_forest(x, label, 9)
    donor = np.stack([x[made.permutation(len(x))] for _ in range(4)], axis=2)
    walked = []

    def each():
        for tree in found:
            follow = tree.follow
            tree.follow = lambda rows, *a, follow=follow: walked.append(len(rows)) or follow(rows, *a)
            yield tree
            tree.follow = follow

    assert trees.block_losses(each, x, donor, label, 3).tolist() == expected(found, x, donor, label)
    assert max(walked) <= 9


def test_nodes_of_few_cells_are_split_as_by_bins(monkeypatch):
    made = np.random.default_rng(8)
    for width, classes, values in ((9, 4, 32), (5, 2, 3), (64, 10, 32)):
        codes, label = made.integers(0, values, (700, width)).astype(np.uint8), made.integers(0, classes, 700)
        weight = made.integers(1, 4, 700).astype(float)
        grower, seen = forests.Grower(50, 30, 1, width, classes), []
        for few in ((), (2, 4, 8)):
            monkeypatch.setattr(forests, "FEW", few)
            seen.append(grower.grow(2, 1, codes, label, weight))
        assert all((a == b).all() for a, b in zip(*seen, strict=True))


def test_no_pair_that_could_change_loses_nothing():
    """A forest whose votes lead by so far that no tree has to be walked again."""
    x = np.repeat(np.arange(40, dtype=np.uint8)[:, None] % 30, 9, axis=1)
    split = np.array([[0, 7, 1, 0], [-1, 0, 0, 0], [-1, 0, 0, 0]])
    flat = forests.FlatForest(
        np.arange(9) * 3, np.concatenate([np.where(split[:, 0] < 0, -1, t) for t in range(9)]), np.tile(split[:, 1], 9),
        np.concatenate([split[:, 2] + 3 * t for t in range(9)]), np.concatenate([split[:, 2] + 3 * t + 1 for t in range(9)]),
        np.tile([0, 0, 1], 9), np.eye(2),
    )
    donor, label = x[::-1].copy(), (x[:, 0] > 7).astype(int)
    total = np.zeros(9, dtype=np.int64)
    flat._add_losses(x, donor, label, total)
    assert total.tolist() == [0] * 9


def test_the_forest_reaches_the_driver_in_groups(spark, monkeypatch):
    """No group is larger than the bytes allowed and one tree, whatever the forest; the result is that of the forest in one piece."""
    made = np.random.default_rng(4)
    x = np.round(made.normal(size=(300, 6)), 2)
    label = (x[:, 0] + x[:, 3] > 0).astype(int) + (x[:, 1] > 1)
    df = spark.createDataFrame(
        [(i, int(v), Vectors.dense(r)) for i, (r, v) in enumerate(zip(x, label, strict=True))], ["row_id", "persona_id", "features"]
    )
    seen, groups = [], []
    whole = forests.GrownForest.groups

    def noted(self):
        for group in whole(self):
            groups.append([sum(len(b) for p in parts.values() for b in p) for _, _, parts in group])
            yield group

    monkeypatch.setattr(forests.GrownForest, "groups", noted)
    monkeypatch.setattr(ranking, "LEAST_ROWS", 16)
    for sent, held, local in ((1 << 25, 1 << 25, 1 << 25), (200, 2000, 200)):
        monkeypatch.setattr(forests, "SENT", sent)
        monkeypatch.setattr(forests, "LOCAL", local)
        monkeypatch.setattr(ranking, "HELD", held)
        groups.clear()
        found = ranking.permutation_importance(df, list("abcdef"), trees=20, repeats=3).collect()
        seen.append([(r["feature"], r["score"]) for r in found])
    assert seen[0] == seen[1] and {n for n, s in seen[0] if s > 0.02} >= {"a", "d"}
    assert len(groups) > 3 and all(sum(g) - g[-1] < 200 for g in groups)
