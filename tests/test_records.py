"""CSV records that begin in one piece of a file and end in another."""

import csv
import io
import random

import pytest

from facetloom.sources import records, tables


def written(rows, end="\n"):
    out = io.StringIO()
    writer = csv.writer(out, lineterminator=end)
    writer.writerow(["a", "b", "c"])
    writer.writerows(rows)
    return out.getvalue()


@pytest.fixture
def small_pieces(spark):
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    old = [spark.conf.get(n) for n in names]
    spark.conf.set(names[0], "64")
    spark.conf.set(names[1], "1")
    yield
    for name, value in zip(names, old, strict=True):
        spark.conf.set(name, value)


def fields(rng):
    parts = ["plain", '"', "\n", ",", " ", "ü", '""', 'x"y', "long words " * 9, "\n\n", '",\n"', '\n"a",']
    return "".join(rng.choice(parts) for _ in range(rng.randint(1, 5)))


@pytest.mark.parametrize("seed", range(2))
def test_records_over_pieces(spark, tmp_path, small_pieces, seed):
    rng = random.Random(seed)
    want = []
    for file in range(2):
        rows = [(f"{file}-{i}", fields(rng), fields(rng)) for i in range(40)]
        (tmp_path / f"{file}.csv").write_text(written(rows), encoding="utf-8", newline="")
        want += rows
    found = tables.read_csv(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() > 4
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_one_field_over_many_pieces(spark, tmp_path, small_pieces):
    rows = [("1", "\n".join(f'line {i}, "said"' for i in range(300)), "x"), ("2", "", "y")]
    (tmp_path / "t.csv").write_text(written(rows, "\r\n"), newline="")
    found = sorted(map(tuple, tables.read_csv(spark, str(tmp_path / "t.csv"), "a string, b string, c string").collect()))
    assert found == [rows[0], ("2", None, "y")]


def test_odd_files(spark, tmp_path):
    """Quotes in unquoted fields, blank lines, short and long rows, an empty file, no last line end."""
    (tmp_path / "one.csv").write_text('a,b\n5" pipe,x\n\n1\n2,3,4\n"",\n"open\nto the end,1')
    (tmp_path / "two.csv").write_text("")
    rows = tables.read_csv(spark, str(tmp_path / "one.csv"))
    spark_own = spark.read.csv(str(tmp_path / "one.csv"), header=True, quote='"', escape='"', multiLine=True, nullValue="\0")
    key = lambda r: tuple(map(repr, r))
    assert sorted(map(tuple, rows.collect()), key=key)[:-1] == sorted(map(tuple, spark_own.collect()), key=key)[:-1]
    assert rows.count() == 5
    assert records.csv_records(spark, str(tmp_path / "two.csv")).count() == 0


def test_folders_by_value(spark, tmp_path):
    for kind in ("x", "y"):
        (tmp_path / f"kind={kind}").mkdir()
        (tmp_path / f"kind={kind}" / "t.csv").write_text(f'a,b\n1,"{kind}\n2"\n')
    rows = tables.read_csv(spark, str(tmp_path))
    assert sorted(map(tuple, rows.select("a", "b", "kind").collect())) == [("1", "x\n2", "x"), ("1", "y\n2", "y")]


@pytest.mark.parametrize(
    ("line", "inside", "after"),
    [
        ("a,b", False, False), ("a,b", True, True), ('"a', False, True), ('a"', True, False),
        ('a""', True, True), ('a"""', True, False), ('5" pipe,x', False, False), ('x,"y', False, True),
        ('b","c', True, True), ('b",c"d', True, False), ('""', False, False), ('""', True, True), ('"",""', False, False),
        ('","', False, False), ('"\r', True, False),
    ],
)
def test_state_after_a_line(line, inside, after):
    assert records.ends_inside(line, inside) is after
