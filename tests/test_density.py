"""Density clusters by distance and connected components, against brute force."""

from collections import Counter

import numpy as np
import pytest

from facetloom.operators import density
from facetloom.operators.components import connected_components

ROWS = "row_id long, reduced array<double>, cluster string, first long"


def expected(rows, radius, min_points, min_size):
    """Clusters from the whole matrix of distances."""
    known = [(i, v) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    ids, x = [i for i, _ in known], np.array([v for _, v in known])
    near = ((x[:, None] - x[None]) ** 2).sum(axis=2) <= radius * radius
    core = near.sum(axis=1) >= min_points
    label = {}
    for start in np.flatnonzero(core):
        if start in label:
            continue
        part, todo = {start}, [start]
        while todo:
            new = [v for v in np.flatnonzero(near[todo.pop()] & core) if v not in part]
            part.update(new)
            todo += new
        label.update(dict.fromkeys(part, min(ids[v] for v in part)))
    for i in np.flatnonzero(~core):
        touched = [label[v] for v in np.flatnonzero(near[i] & core)]
        if touched:
            label[i] = min(touched)
    sizes = Counter(label.values())
    kept = sorted(k for k, n in sizes.items() if n >= min_size)
    out = dict.fromkeys((i for i, _ in rows), -1)
    out.update({ids[i]: kept.index(k) for i, k in label.items() if k in kept})
    return out


def planted(width, seed):
    """Six clouds, points between, copies of one point, and rows that cannot be placed."""
    made = np.random.default_rng(seed)
    centres = made.normal(size=(6, width)) * 4
    clouds = centres[made.integers(0, 6, 500)] + made.normal(size=(500, width)) / np.sqrt(width)
    x = np.concatenate([clouds, made.normal(size=(80, width)) * 4, np.repeat(centres[:1] + 9, 25, axis=0)])
    ids = made.permutation(len(x))
    rows = [(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)]
    return rows + [(900, None), (901, [float("nan")] * width), (902, [None] * width), (903, [float("inf")] * width)]


@pytest.mark.parametrize(("width", "block", "radius"), [(2, 4096, 0.6), (10, 50, 1.3), (50, 64, 1.3)])
def test_clusters_equal_brute_force(spark, monkeypatch, width, block, radius):
    """Small blocks cut the crowded cells into pairs of blocks."""
    monkeypatch.setattr(density, "BLOCK", block)
    monkeypatch.setattr(density, "STEP", 37)
    rows = planted(width, width)
    df = spark.createDataFrame([(*r, "old", 5) for r in rows], ROWS).repartition(4)
    found = density.distance_clusters(df, radius, 5, 10)
    assert found.columns == ["row_id", "reduced", "first", "cluster"]
    got = {r["row_id"]: r["cluster"] for r in found.collect()}
    want = expected(rows, radius, 5, 10)
    assert got == want and len(set(want.values())) > 5


def test_without_ids_and_without_rows(spark):
    rows = [([0.0, float(i % 3)],) for i in range(40)] + [([50.0, 0.0],)]
    df = spark.createDataFrame(rows, "reduced array<double>")
    found = density.distance_clusters(df, 1.0, 5, 10, row_id=None).groupBy("cluster").count().collect()
    assert {r["cluster"]: r["count"] for r in found} == {0: 40, -1: 1}
    none = spark.createDataFrame([(1, None, "x", 1)], ROWS)
    assert [r["cluster"] for r in density.distance_clusters(none, 1.0).collect()] == [-1]
    with pytest.raises(ValueError):
        density.distance_clusters(none, 0.0)


def test_near_at_the_border():
    """Distances of exactly the radius count, also far from the origin."""
    x = np.array([[1e6, 0.0], [1e6, 5.0]])
    y = np.array([[1e6 + 3.0, 4.0], [1e6, -5.000001], [1e6 + 3.0, 1.0]])
    assert density.near(x, y, 5.0).tolist() == [[True, False, True], [True, False, True]]


def test_connected_components(spark):
    made = np.random.default_rng(1)
    path = [(i, i + 1) for i in range(1000, 1200)]
    star = [(5000 + i, 4999) for i in range(300)]
    random = [(int(a), int(b)) for a, b in made.integers(0, 150, (90, 2))]
    edges = path + star + random + [(7, 7), (9000, 9000)]
    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    label = {n: n for e in edges for n in e}
    changed = True
    while changed:
        changed = False
        for u, v in edges:
            low = min(label[u], label[v])
            changed |= label[u] != low or label[v] != low
            label[u] = label[v] = low
    assert found == label
    assert connected_components(spark.createDataFrame([], "u long, v long")).collect() == []
