"""Files, ids and numbers at the borders."""

import math
import os

import pytest

from facetloom.operators import matching, profiles
from facetloom.sources import blogs, tables


def test_csv_round_trip_is_exact(spark, tmp_path):
    rows = [
        (2**53 + 1, "  lead and trail  "), (2, ""), (3, None), (4, "\ty"), (5, 'a "q", b\nnext'),
        (None, " "), (-(2**63), "NULL"),
    ]
    frame = spark.createDataFrame(rows, "id bigint, text string")
    tables.write_csv(frame, str(tmp_path / "t"))
    got = tables.read_csv(spark, str(tmp_path / "t"), "id bigint, text string").collect()
    assert sorted(map(tuple, got), key=str) == sorted(rows, key=str)


def test_fractions_are_no_whole_numbers(spark, tmp_path):
    (tmp_path / "x.csv").write_text("id,n\n1,1997.0\n2,17.9\n3,word\n4,9007199254740993\n")
    got = tables.read_csv(spark, str(tmp_path / "x.csv"), "id int, n bigint").collect()
    assert {r["id"]: r["n"] for r in got} == {1: 1997, 2: None, 3: None, 4: 9007199254740993}


@pytest.mark.parametrize("form", ["{0}/blogs", "{0}/./blogs", "{0}/x/../blogs", "{0}//blogs", "{0}/blogs/"])
def test_forms_of_a_folder(spark, tmp_path, form):
    os.makedirs(tmp_path / "blogs")
    os.makedirs(tmp_path / "x")
    (tmp_path / "blogs" / "1.male.20.Arts.Leo.xml").write_text("<Blog>\n</Blog>")
    assert blogs.list_blog_files(spark, form.format(tmp_path)).count() == 1


@pytest.mark.parametrize("limit", [1, 4096])
def test_match_is_the_same_in_any_passes(spark, limit):
    nan = float("nan")
    index = [("r1", "a", [1.0, 0.0]), ("r0", "a", [1.0, 0.0]), ("r2", "a", [nan, 0.0]), ("r3", "a", None), ("r4", "b", [0.0, 1.0])]
    asked = [("q1", "a", [1.0, 0.0]), ("q2", "b", [1.0, 0.0]), ("q3", "none", [1.0, 0.0]), ("q4", "a", [nan, 1.0]), ("q5", None, [1.0, 0.0])]
    got = matching.match(
        spark.createDataFrame(asked, "query_id string, persona_id string, vector array<double>"),
        spark.createDataFrame(index, "row_id string, persona_id string, vector array<double>").repartition(3),
        pass_queries=limit,
        keep_unmatched=True,
    ).collect()
    assert {r["query_id"]: (r["row_id"], r["similarity"]) for r in got} == {
        "q1": ("r0", 1.0), "q2": ("r4", 0.0), "q3": (None, None), "q4": (None, None), "q5": (None, None),
    }


def test_nan_counts_as_null(spark):
    rows = [("a", 1.0), ("a", 2.0), ("a", float("nan")), ("a", None)]
    row = profiles.numeric_summary(spark.createDataFrame(rows, "cluster string, x double"), ["x"]).first()
    assert (row["x_mean"], row["x_median"], row["x_max"]) == (1.5, 1.5, 2.0)


def test_tail_for_many_degrees_of_freedom():
    for a in (1.01e5, 5e7, 1e12):
        for z in (-3, -1e-3, 0, 0.5, 4):
            x = a + z * math.sqrt(a)
            normal = 0.5 * math.erfc(z / math.sqrt(2))
            assert profiles._upper_gamma(a, x) == pytest.approx(normal, rel=0.05, abs=2e-3)
    below, above = profiles._upper_gamma(9.9999e4, 1.001e5), profiles._upper_gamma_large(9.9999e4, 1.001e5)
    assert below == pytest.approx(above, rel=1e-6)
