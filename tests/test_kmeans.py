"""K-means of many models in shared passes, on dense and sparse rows."""

import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from facetloom.operators import blocks, clustering, kmeans


def rows_of(spark, x, sparse):
    def vector(i, row):
        if sparse and i % 3:
            return Vectors.sparse(len(row), {j: float(v) for j, v in enumerate(row) if v})
        return Vectors.dense(row)

    made = [(i, vector(i, row)) for i, row in enumerate(x)]
    return spark.createDataFrame([*made, (len(x), None)], ["row_id", "features"]).repartition(3)


@pytest.fixture(scope="module")
def clouds():
    made = np.random.default_rng(0)
    centres = made.normal(size=(4, 6)) * 8
    x = centres[made.integers(0, 4, 200)] + made.normal(size=(200, 6))
    x[:, 5] = 0
    return x


@pytest.mark.parametrize("sparse", [False, True])
def test_many_models(spark, clouds, sparse):
    """Costs are those of the centres, centres are means, and silhouettes those of Spark."""
    df = rows_of(spark, clouds, sparse)
    found = kmeans.fit_many(df, [2, 4, 5], 4)
    for k, (centres, cost, used, score) in found.items():
        far = ((clouds[:, None] - centres) ** 2).sum(axis=2)
        label = far.argmin(axis=1)
        assert used == k == len(set(label)) and cost == pytest.approx(far.min(axis=1).sum())
        assert centres == pytest.approx(np.array([clouds[label == c].mean(axis=0) for c in range(k)]), abs=1e-4)
        placed = kmeans.Centres(centres).transform(df.where("features IS NOT NULL"))
        assert score == pytest.approx(clustering.silhouette(placed), abs=1e-9)
    missing = kmeans.Centres(found[2][0]).transform(df).where("features IS NULL").first()
    assert missing["cluster"] is None


def test_few_and_no_rows(spark):
    two = rows_of(spark, np.array([[0.0, 1.0], [5.0, 1.0]]), False)
    chosen = clustering.choose_k(two, kmax=4, restarts=2)
    assert chosen.k == 2 and clustering.assign_personas(two, chosen).where("row_id < 2").select("persona_id").distinct().count() == 2
    with pytest.raises(ValueError):
        clustering.choose_k(two.where("row_id > 5"))


def test_wide_data_is_split_evenly(spark):
    """Rows far from each other and near their mean: no model ends with one row alone."""
    x = np.random.default_rng(3).normal(size=(300, 40))
    centres = kmeans.fit_many(rows_of(spark, x, False), [2], 3)[2][0]
    label = ((x[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
    assert np.bincount(label).min() > 60


def test_blocks_multiply_like_matrices(monkeypatch):
    monkeypatch.setattr(blocks, "SPARSE_ENTRIES", 7)
    monkeypatch.setattr(blocks, "DENSE_ROWS", 4)
    made = np.random.default_rng(4)
    x = made.normal(size=(23, 9)) * (made.random((23, 9)) < 0.4)
    x[3] = 0
    matrix, weights, label = made.normal(size=(9, 3)), made.normal(size=(23, 2)), made.integers(0, 4, 23)
    for mixed in (None, True, False):
        dense = [mixed is None or (mixed and i % 4 == 0) for i in range(23)]
        indices = [None if d else np.flatnonzero(r).tolist() for d, r in zip(dense, x, strict=True)]
        values = [r.tolist() if d else r[r != 0].tolist() for d, r in zip(dense, x, strict=True)]
        batch = pa.RecordBatch.from_arrays(
            [pa.array(indices, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float64()))], names=["indices", "values"]
        )
        turned, sums, seen = np.zeros((9, 2)), np.zeros((4, 9)), 0
        for part, block in blocks.blocks_of(batch):
            assert block.times(matrix) == pytest.approx(x[part] @ matrix)
            assert block.norms() == pytest.approx((x[part] ** 2).sum(axis=1))
            block.add_turned(weights[part], turned)
            block.add_by_label(label[part], sums)
            seen += block.rows
        assert seen == 23 and turned == pytest.approx(x.T @ weights)
        assert sums == pytest.approx(np.array([x[label == c].sum(axis=0) for c in range(4)]))


def test_rows_of_one_file_are_worked_on_by_all_cores(spark):
    """A table in one part once kept all passes in one task."""
    rows = spark.range(200).coalesce(1).select(array_to_vector(F.array(F.col("id").cast("double"))).alias("features"))
    kept = kmeans._Rows(rows, "features")
    try:
        assert kept.table.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    finally:
        kept.table.unpersist()


def test_a_batch_of_wide_rows_is_projected_in_pieces(spark, monkeypatch):
    """The product of a whole batch once filled a worker's memory."""
    monkeypatch.setattr(blocks, "SPARSE_ENTRIES", 10)
    made = np.random.default_rng(5).normal(size=(60, 7))
    cut = list(blocks._pieces(pd.DataFrame({"values": list(made), "indices": [None] * 60})))
    assert all(len(piece) == 1 for piece in cut) and len(cut) == 60
    matrix, shift = np.random.default_rng(6).normal(size=(7, 3)), np.ones(3)
    for sparse in (False, True):
        df = rows_of(spark, made, sparse)
        found = {r["row_id"]: r["out"] for r in blocks.projected(df, "features", matrix, shift, "out").collect()}
        assert found.pop(60) is None
        assert np.allclose([found[i].toArray() for i in range(60)], made @ matrix - 1)


def test_sparse_products_stay_small():
    """All entries of a block times a wide matrix would be hundreds of megabytes, several times over."""
    made = np.random.default_rng(2)
    for width, each in ((282, 64), (5000, 160), (5000, 3)):
        rows = blocks.SPARSE_ENTRIES // each
        at = np.sort(np.argsort(made.random((64, width)), axis=1)[:, :each], axis=1)[np.arange(rows) % 64].ravel()
        block = blocks.Block(rows, made.normal(size=rows * each), at, np.arange(rows) * each)
        columns = width if width < 500 else 60
        matrix, turned = made.normal(size=(width, columns)), np.zeros((width, columns))
        tracemalloc.start()
        found = block.times(matrix)
        block.add_turned(found, turned)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert most < 100e6 + found.nbytes
        dense = np.zeros((50, width))
        dense[np.repeat(np.arange(50), each), at[: 50 * each]] = block.values[: 50 * each]
        assert found[:50] == pytest.approx(dense @ matrix)
        # The whole product, by its parts along one direction.
        line = made.normal(size=columns)
        back = np.bincount(at, block.values * np.repeat(found @ line, each), width)
        assert turned @ line == pytest.approx(back)
