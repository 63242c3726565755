import datetime
import os
from multiprocessing.pool import ThreadPool

import pytest

from facetloom.operators.scoring import HashScorer
from facetloom.plans.enrichment import enrich, enrich_blogs
from facetloom.schemas import CLUSTER_LEGEND, CLUSTERED, ENRICHED
from facetloom.sources import blogs, cards, index, publish, tables

FILES = {
    "1.male.24.Student.Leo.xml": (
        "<Blog>\r\nearly caf\xe9\r\n<date>1,May,2004</date>\r\n<post>\r\n hi there \r\n\xa0\r\n\r\n"
        "</post>\r<date>2,May,2004</date> dropped text\nmore\n  <tag> x\n"
    ),
    "2.female.17.Arts.Aries.xml": "a\nb",
    "3.male.33.indUnk.Virgo.xml": "",
}


LINES = [
    ("1.male.24.Student.Leo.xml", "early caf\xe9", ""),
    ("1.male.24.Student.Leo.xml", "hi there", "1,May,2004"),
    ("1.male.24.Student.Leo.xml", "more", "2,May,2004"),
    ("2.female.17.Arts.Aries.xml", "a", ""),
    ("2.female.17.Arts.Aries.xml", "b", ""),
]


@pytest.fixture
def blog_dir(tmp_path):
    folder = tmp_path / "blogs"
    folder.mkdir()
    for name, content in FILES.items():
        (folder / name).write_bytes(content.encode("latin-1"))
    (folder / "note.txt").write_text("no blog")
    (folder / "deep").mkdir()
    (folder / "deep" / "9.male.1.x.y.xml").write_text("hidden")
    return str(folder)


def test_blog_lines(spark, blog_dir):
    rows = blogs.read_blog_files(spark, blog_dir).orderBy("path", "post_no", "line_no").collect()
    found = [(r["path"].rsplit("/", 1)[1], r["text"], r["date"]) for r in rows]
    assert found == LINES
    first = rows[0]
    assert (first["gender"], first["age"], first["job"], first["horoscope"]) == ("male", 24, "Student", "Leo")


def test_build_dataset_splits_by_file(spark, blog_dir):
    rows = blogs.build_dataset(spark, blog_dir, every=2).collect()
    by_file = {r["path"].rsplit("/", 1)[1]: (r["file_idx"], r["split"]) for r in rows}
    assert by_file == {
        "1.male.24.Student.Leo.xml": (0, "validation"),
        "2.female.17.Arts.Aries.xml": (1, "train"),
    }


def test_enrich_blogs(spark, blog_dir, tmp_path):
    out = str(tmp_path / "out")
    emotions, sentiment = HashScorer(), HashScorer(("LABEL_0", "LABEL_2"))
    report = enrich_blogs(spark, blog_dir, out, emotions, sentiment, min_confidence=0.3)
    loaded, kept, dropped, rate = report.first()
    lines = [line for _, line, _ in LINES]
    assert loaded == len(lines) and kept + dropped == loaded and 0 <= rate <= 1
    saved = tables.read_dataset(spark, out).collect()
    assert len(saved) == kept and {r["text"] for r in saved} <= set(lines)
    assert {r["birth_year_est"] for r in saved} <= {None, 2004}
    some = enrich_blogs(spark, blog_dir, out, emotions, sentiment, start=2, end=2)
    # The second line of each split; the first file alone is validation.
    assert some.first()["rows_loaded"] == 2


def test_missing_and_empty_folders(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        blogs.read_blog_files(spark, str(tmp_path / "nowhere"))
    (tmp_path / "empty").mkdir()
    with pytest.raises(FileNotFoundError):
        blogs.read_blog_files(spark, str(tmp_path / "empty"))


@pytest.mark.parametrize("name", ["1.male.24.Student.xml", "1.male.old.Student.Leo.xml"])
def test_wrong_file_names_fail(spark, tmp_path, name):
    (tmp_path / name).write_text("text")
    with pytest.raises(Exception, match="file name is not|age is not"):
        blogs.read_blog_files(spark, str(tmp_path)).collect()


def test_csv_round_trip(spark, tmp_path):
    rows = [('says "hi", twice\nand more', "1,May,2004", 5), (None, "NA", None), ("", "x", 7)]
    df = spark.createDataFrame(rows, "text string, date string, age int")
    path = str(tmp_path / "out")
    tables.write_csv(df, path, ["age"])
    back = tables.read_csv(spark, path, "text string, date string, age int", null_values=["NA"])
    found = {(r["text"], r["date"], r["age"]) for r in back.collect()}
    assert (rows[0][0], "1,May,2004", 5) in found
    assert (None, None, None) in found


def test_csv_types_and_absent_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("age,year\n24,1997.0\nold,\n")
    back = tables.read_csv(spark, str(tmp_path / "a.csv"), "year int, age double, job string")
    assert [tuple(r) for r in back.collect()] == [(1997, 24.0, None), (None, None, None)]


def test_materialize_parquet_prefers_parquet(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x\n1\n")
    made = tables.materialize_parquet(spark, str(tmp_path / "a.csv"), str(tmp_path / "p"), "x int")
    assert made.count() == 1
    (tmp_path / "a.csv").write_text("x\n1\n2\n")
    again = tables.materialize_parquet(spark, str(tmp_path / "a.csv"), str(tmp_path / "p"), "x int")
    assert again.count() == 1


def test_dataset_by_split(spark, tmp_path):
    df = spark.createDataFrame([(1, "train"), (2, "validation")], "x int, split string")
    tables.write_dataset(df, str(tmp_path / "d"))
    assert [r["x"] for r in tables.read_dataset(spark, str(tmp_path / "d"), "train").collect()] == [1]
    assert tables.read_dataset(spark, str(tmp_path / "d")).count() == 2


def test_age_mode_of_the_jobs(spark, blog_dir, tmp_path):
    """The author of the first file is 24 in 2004; without the mode the post's date is the birth date."""
    out = str(tmp_path / "ages")
    models = HashScorer(), HashScorer(("LABEL_0", "LABEL_2"))
    enrich_blogs(spark, blog_dir, out, *models, min_confidence=0.0, date_is_birthdate=False)
    dated = tables.read_dataset(spark, out).where("date != ''").select("birth_year_est", "is_genz")
    assert {tuple(r) for r in dated.collect()} == {(1980, 0)}
    rows = spark.createDataFrame([("some happy words", "1,May,2010", "9"), ("some happy words", "1,May,2010", "x")], "text string, date string, age string")
    young = enrich(rows, *models, min_confidence=0.0, date_is_birthdate=False)
    assert sorted((r["birth_year_est"] or 0, r["is_genz"]) for r in young.collect()) == [(0, 0), (2001, 1)]


def test_a_partial_folder_is_converted_again(spark, tmp_path):
    csv, out = str(tmp_path / "a.csv"), str(tmp_path / "p")
    (tmp_path / "a.csv").write_text("x\n" + "\n".join(map(str, range(10))))
    tables.materialize_parquet(spark, csv, out, "x int")
    os.remove(f"{out}/_SUCCESS")
    os.remove(next(f for f in map(str, (tmp_path / "p").glob("part-*"))))
    assert sorted(r["x"] for r in tables.materialize_parquet(spark, csv, out, "x int").collect()) == list(range(10))
    assert len(list(tmp_path.glob("p.incomplete-*"))) == 1 and not list(tmp_path.glob("p.making-*"))


def test_writers_at_once(spark, tmp_path):
    """Each reader sees one whole table; the writers that lose leave nothing behind."""
    out = str(tmp_path / "t")
    frames = [spark.range(100).selectExpr("id", f"{i} AS who").repartition(4) for i in range(4)]
    with ThreadPool(4) as pool:
        won = pool.map(lambda df: publish.publish(df, out), frames)
    found = spark.read.parquet(out).groupBy("who").count().collect()
    assert sum(won) == 1 and [tuple(r) for r in found] == [(won.index(True), 100)]
    assert [p.name for p in tmp_path.iterdir()] == ["t"]
    with ThreadPool(2) as pool:
        assert pool.map(lambda df: publish.publish(df, out, replace=True), frames[:2]) == [True, True]
    assert spark.read.parquet(out).count() == 100 and [p.name for p in tmp_path.iterdir()] == ["t"]


def test_modes_of_a_dataset(spark, tmp_path):
    out = str(tmp_path / "d")
    one = spark.createDataFrame([(1, "train")], "x int, split string")
    tables.write_dataset(one, out, "errorifexists")
    with pytest.raises(FileExistsError):
        tables.write_dataset(one, out, "errorifexists")
    tables.write_dataset(one, out, "ignore")
    tables.write_dataset(one, out, "append")
    assert tables.read_dataset(spark, out, "train").count() == 2
    tables.write_dataset(one, out)
    assert tables.read_dataset(spark, out).count() == 1
    os.remove(f"{out}/_SUCCESS")
    with pytest.raises(FileNotFoundError):
        tables.read_dataset(spark, out)
    with pytest.raises(ValueError):
        tables.write_dataset(one, out, "other")


def test_newest_file(spark, tmp_path):
    for i, name in enumerate(["m_a.csv", "m_b.csv"]):
        (tmp_path / name).write_text("x")
        stamp = datetime.datetime(2024, 1, 2 - i).timestamp()
        os.utime(tmp_path / name, (stamp, stamp))
    assert tables.newest_file(spark, f"{tmp_path}/m_*.csv").endswith("m_a.csv")
    assert tables.newest_file(spark, f"{tmp_path}/m_*.csv", f"{tmp_path}/m_b.csv").endswith("m_b.csv")
    with pytest.raises(FileNotFoundError):
        tables.newest_file(spark, f"{tmp_path}/none*.csv")
    assert tables.resolve_file(spark, "m_b.csv", ["/nowhere", str(tmp_path)]) == f"{tmp_path}/m_b.csv"
    with pytest.raises(FileNotFoundError):
        tables.resolve_file(spark, "m_b.csv", [str(tmp_path)], "/nowhere/x.csv")


def test_persona_index(spark, tmp_path):
    df = spark.createDataFrame(
        [(1, 0, [3.0, 4.0]), (2, 1, [0.0, 2.0]), (3, None, [1.0, 0.0])],
        "row_id int, persona_id int, vector array<float>",
    )
    path = str(tmp_path / "i")
    index.write_persona_index(index.build_index(df), path)
    rows = index.read_persona_index(spark, path).collect()
    assert {r["row_id"] for r in rows} == {1, 2}
    one = index.read_persona_index(spark, path, 0)
    assert one.first()["vector"] == pytest.approx([0.6, 0.8])
    assert "persona_id" in one._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(FileNotFoundError):
        index.read_persona_index(spark, path, 7)


def test_cards_need_personas(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"n_rows": 3}')
    with pytest.raises(ValueError):
        cards.read_cards(spark, str(tmp_path / "c.json"))
    (tmp_path / "d.json").write_text(
        '{\n "n_rows": 3, "personas": {"0": {"size": 3, "top_words": ["a"],\n "share": 1.0}}}'
    )
    row = cards.read_cards(spark, str(tmp_path / "d.json")).first()
    assert (row["persona_id"], row["size"], row["top_words"], row["job_top"]) == ("0", 3, ["a"], None)


def test_schemas():
    assert len(CLUSTERED) == 18 and len(ENRICHED) == 24
    assert CLUSTER_LEGEND.names == ["cluster", "count", "color_name"]
