import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from facetloom.operators import profiles as P
from facetloom.plans import personas

LEGEND = [
    (0, 9056, "steelblue"), (1, 21016, "lightsteelblue"), (2, 9982, "darkorange"),
    (3, 17058, "lightsalmon"), (4, 5356, "forestgreen"), (5, 10026, "lightgreen"),
    (6, 11108, "crimson"), (7, 13037, "lightsalmon"),
]


@pytest.fixture(scope="module")
def legend(spark):
    return spark.createDataFrame(LEGEND, "cluster int, count bigint, color_name string").repartition(3)


def test_golden_tests(legend):
    row = P.chi_square(legend, ["color_name"]).first()
    assert row["chi2"] == pytest.approx(48.0, abs=1e-12)
    assert row["dof"] == 42
    assert row["p_value"] == pytest.approx(0.24263868733675567, rel=1e-12)
    assert row["cramers_v"] is None
    assert row["effect"] == pytest.approx(1.0)
    diag = P.diag_profiles(P.chi_square(legend, ["color_name"])).first()
    assert tuple(diag)[:2] == ("color_name", "categorical")


def test_golden_profiles(legend):
    rows = P.order_profiles(P.value_profiles(legend, ["color_name"], zeros=True)).collect()
    assert len(rows) == 56
    names = sorted({name for _, _, name in LEGEND})
    want = []
    for cluster, _, own in LEGEND:
        want.append((cluster, "color_name", own, 100.0))
        want += [(cluster, "color_name", n, 0.0) for n in names if n != own]
    assert [tuple(r) for r in rows] == want
    plain = P.order_profiles(P.value_profiles(legend, ["color_name"])).collect()
    assert [tuple(r) for r in plain] == [w for w in want if w[3]]


def test_profiles_of_texts_grow_with_the_cells(spark):
    """Each row has a text of its own; the job writes a line for each, not for each and every cluster."""
    df = spark.range(500).selectExpr("cast(id % 10 AS int) AS cluster", "concat('text ', id) AS text", "id % 2 AS n")
    found = personas.profile_clusters(df)
    assert found.values.count() == 500 and personas.profile_clusters(df, zeros=True).values.count() == 5000
    assert found.values.agg(F.min("pct"), F.max("pct")).first() == (2.0, 2.0)


def test_golden_numbers(legend):
    rows = P.numeric_summary(legend, ["count"]).orderBy("cluster").collect()
    for row, (cluster, count, _) in zip(rows, LEGEND, strict=True):
        assert tuple(row) == (cluster, count, None, count, count, count)


def table(spark, cells):
    rows = [(c, v) for c, v, n in cells for _ in range(n)]
    return spark.createDataFrame(rows, "cluster int, f string")


def test_two_by_two_is_corrected(spark):
    df = table(spark, [(0, "a", 10), (0, "b", 5), (1, "a", 3), (1, "b", 12)])
    row = P.chi_square(df, ["f"]).first()
    assert row["chi2"] == pytest.approx(4.886877828054299, rel=1e-12)
    assert row["dof"] == 1
    part = P.association_parts(df, ["f"], "cluster").first()
    assert (part["n"], part["rows"], part["cols"]) == (30, 2, 2)


def test_two_by_two_with_an_empty_cell_and_small_gaps(spark):
    row = P.chi_square(table(spark, [(0, "a", 4), (1, "a", 2), (1, "b", 6)]), ["f"]).first()
    # By hand: every gap is 2, every expected count 3, 3, 3, 3 scaled by the margins.
    rows, cols, n = (4, 8), (6, 6), 12
    want = sum((2 - 0.5) ** 2 / (r * c / n) for r in rows for c in cols)
    assert row["chi2"] == pytest.approx(want)
    even = P.chi_square(table(spark, [(0, "a", 3), (0, "b", 3), (1, "a", 3), (1, "b", 3)]), ["f"]).first()
    assert even["chi2"] == 0.0 and even["p_value"] == 1.0


def test_plain_table_against_a_dense_sum(spark):
    rng = random.Random(5)
    cells = [(c, v, rng.choice([0, 0, 3, 9])) for c in range(4) for v in "abcde"] + [(0, "a", 1)]
    df = table(spark, cells)
    count = {}
    for c, v, n in cells:
        if n:
            count[c, v] = count.get((c, v), 0) + n
    rows, cols = {}, {}
    for (c, v), n in count.items():
        rows[c] = rows.get(c, 0) + n
        cols[v] = cols.get(v, 0) + n
    total = sum(rows.values())
    want = sum(
        (count.get((c, v), 0) - rows[c] * cols[v] / total) ** 2 / (rows[c] * cols[v] / total)
        for c in rows for v in cols
    )
    row = P.chi_square(df, ["f"]).first()
    assert row["chi2"] == pytest.approx(want, rel=1e-12)
    assert row["dof"] == (len(rows) - 1) * (len(cols) - 1)


def test_degenerate_features(spark):
    df = spark.createDataFrame(
        [(0, "a", None, "p"), (0, "b", None, "p"), (None, "c", None, "p")],
        "cluster int, one string, none string, flat string",
    )
    rows = {r["feature"]: r for r in P.chi_square(df, ["one", "none", "flat"]).collect()}
    assert (rows["one"]["chi2"], rows["one"]["dof"], rows["one"]["p_value"]) == (0.0, 0, 1.0)
    assert rows["none"]["chi2"] is None and rows["none"]["p_value"] is None
    assert rows["flat"]["cramers_v"] is None
    single = P.chi_square(df.limit(1), ["one"]).first()
    assert single["cramers_v"] is None
    ordered = [r["feature"] for r in P.order_tests(P.chi_square(df, ["none", "one"])).collect()]
    assert ordered == ["one", "none"]


def test_tail_probability():
    assert P._upper_gamma(0.5, 3.841458820694124 / 2) == pytest.approx(0.05, rel=1e-9)
    assert P._upper_gamma(50.0, 10.0) == pytest.approx(1.0, abs=1e-12)
    assert P._upper_gamma(1.0, 30.0) == pytest.approx(9.357622968840175e-14, rel=1e-9)


def test_sizes_count_null_and_crosstab_leaves_it_out(spark):
    df = spark.createDataFrame([(0, "a"), (None, "a"), (0, None)], "cluster int, f string")
    assert {r["cluster"]: r["count"] for r in P.cluster_sizes(df).collect()} == {0: 2, None: 1}
    assert [tuple(r) for r in P.crosstab(df, ["f"]).collect()] == [(0, "f", "a", 1)]


def test_profiles_sum_to_hundred_and_skip_null_clusters(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(4), rng.choice(["a", "b", "c", None])) for _ in range(300)] + [(9, None)]
    df = spark.createDataFrame(rows, "cluster int, f string")
    out = P.value_profiles(df, ["f"])
    sums = out.groupBy("cluster").agg(F.sum("pct").alias("s")).collect()
    assert {r["cluster"] for r in sums} == {0, 1, 2, 3}
    assert all(abs(r["s"] - 100) < 0.03 for r in sums)


@pytest.mark.parametrize("bits", [16, 8])
@pytest.mark.parametrize("size", [1, 2, 7, 20_000])
def test_medians_are_exact(spark, size, bits, monkeypatch):
    monkeypatch.setattr(P, "DIGIT_BITS", bits)
    rng = random.Random(size)
    groups = {g: [rng.choice([rng.gauss(0, 1e6), 5.0, 5.0]) for _ in range(size + g)] for g in (0, 1)}
    rows = [(g, x) for g, xs in groups.items() for x in xs] + [(0, None), (0, float("nan"))]
    df = spark.createDataFrame(rows, "cluster int, x double").repartition(5)
    found = {r["cluster"]: r["median"] for r in P.exact_medians(df, ["x"]).collect()}
    assert found == {g: pytest.approx(statistics.median(xs), rel=1e-15) for g, xs in groups.items()}


def test_medians_of_odd_values(spark):
    """Infinities, both zeros, the smallest and largest doubles, ties across the middle."""
    inf = math.inf
    groups = {
        0: [inf, -inf, 3.0], 1: [-inf, -inf, 1.0, inf], 2: [0.0, -0.0], 3: [-5e-324, 5e-324, 0.0], 4: [1.5, 1.5, -2.0, 9.0],
        5: [1.7e308, -1.7e308, 2.0, 2.0], 6: [-1.0, -2.0, -3.0, -4.0], 7: [inf, inf],
    }
    df = spark.createDataFrame([(g, x) for g, xs in groups.items() for x in xs], "cluster int, x double").repartition(4)
    found = {r["cluster"]: r["median"] for r in P.exact_medians(df, ["x"]).collect()}
    assert found == {g: statistics.median(xs) for g, xs in groups.items()}
    assert P.exact_medians(df.limit(0), ["x"]).collect() == []


def test_summary_of_one_row_and_null_cluster(spark):
    df = spark.createDataFrame([(0, 2.0, True), (None, 9.0, False)], "cluster int, x double, b boolean")
    row = P.numeric_summary(df.withColumn("b", F.col("b").cast("int")), ["x", "b"]).collect()
    assert [tuple(r) for r in row] == [(0, 2.0, None, 2.0, 2.0, 2.0, 1.0, None, 1.0, 1.0, 1.0)]
