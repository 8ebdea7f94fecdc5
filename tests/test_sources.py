"""Readers, stores and the streaming use of stateless operators."""

import pytest
from pyspark.sql import functions as F

from armwave.session import scratch_path, shared_dir
from armwave.sources import stores, tables
from armwave.streaming import cleaning


@pytest.fixture()
def questionnaire(tmp_path):
    path = tmp_path / "snap.txt"
    path.write_text(
        "src_subject_id\tinterview_date\tdays_baseline\tversion_form\tscore\n"
        f"{tables.DESCRIPTION_ID}\tDate\tDays since baseline\tForm\tTotal score\n"
        "S1\t01/31/1997\t0\tTeacher form\t2\nS1\t01/31/1997\t0\tTeacher form\t2\nS2\t02/30/1997\t40\tParent form\t999\n"
        "S3\t03/01/1997\t\tParent form\t1\nS4\t03/01/1997\t200\tParent form\t1\nS9\t03/01/1997\t10\tParent form\t1\n")
    return str(path)


def test_questionnaire_and_dictionary(spark, questionnaire):
    rows = {r["src_subject_id"]: r for r in tables.read_questionnaire(spark, questionnaire).collect()}
    assert set(rows) == {"S1", "S2", "S4", "S9"} and str(rows["S1"]["interview_date"]) == "1997-01-31" and rows["S2"]["interview_date"] is None
    words = {r["column"]: r["description"] for r in tables.read_dictionary(spark, questionnaire).collect()}
    assert words["score"] == "Total score" and len(words) == 5


def test_stateless_operators_accept_a_stream(spark, questionnaire, tmp_path):
    arms = spark.createDataFrame([("S1", "M"), ("S2", "C"), ("S4", "L"), ("S9", None)], "src_subject_id string, trtname string")
    schema = "src_subject_id string, interview_date string, days_baseline string, version_form string, score string"
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text(open(questionnaire).read())
    rows = spark.readStream.schema(schema).option("sep", "\t").option("header", True).csv(str(folder))
    out = str(tmp_path / "out")
    cleaning.write_clean(cleaning.clean_rows(rows, arms, [999]), out, str(tmp_path / "ckpt")).awaitTermination(120)
    got = spark.read.parquet(out).select("src_subject_id", "version_form", "wave", "score")
    batch = cleaning.clean_rows(spark.read.schema(schema).option("sep", "\t").option("header", True).csv(str(folder)), arms, [999])
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, batch.select(*got.columns).collect()), key=str)
    assert {r["src_subject_id"] for r in got.collect()} == {"S1", "S2", "S9"} and got.where("score = '999'").count() == 0
    assert {r["version_form"] for r in got.collect()} == {"Teacher", "Parent"}


def test_folder_names_tables_by_prefix(spark, tmp_path):
    (tmp_path / "snap_1.csv").write_text("id,a\n1,x\n")
    (tmp_path / "snap_2.csv").write_text("id,a\n2,y\n")
    (tmp_path / "masc01.csv").write_text("id,b\n3,z\n")
    (tmp_path / ".hidden.csv").write_text("id,b\n9,z\n")
    got = {(r["table"], r["id"], r["a"], r["b"]) for r in tables.read_folder(spark, str(tmp_path)).select("table", "id", "a", "b").collect()}
    assert got == {("snap", "1", "x", None), ("snap", "2", "y", None), ("masc", "3", None, "z")}
    assert {r["file"] for r in tables.find_tables(spark, str(tmp_path), ["MASC"]).collect()} == {"masc01.csv"}


def test_append_is_idempotent_with_nulls(spark):
    path = scratch_path(spark, "store")
    rows = spark.createDataFrame([("a", None), ("b", 1.0), ("b", 1.0)], "k string, v double")
    for _ in range(3):
        stores.append_to_store(spark, path, rows)
    stores.append_to_store(spark, path, spark.createDataFrame([("a", None), ("c", 2.0)], "k string, v double"))
    assert sorted(map(tuple, spark.read.parquet(path).collect()), key=str) == [("a", None), ("b", 1.0), ("c", 2.0)]


def test_partitions_are_pruned(spark):
    path = scratch_path(spark, "parts")
    df = spark.range(100).select("id", (F.col("id") % 4).alias("wave"), (F.col("id") % 2).alias("qst"))
    stores.write_partitioned(df, path, ["qst", "wave"])
    one = spark.read.parquet(path).where("wave = 3")
    assert one.count() == 25 and len(one.inputFiles()) >= 1
    with pytest.raises(ValueError):
        stores.write_json(df, path + "-j", "merge")


def test_jdbc_options(monkeypatch):
    seen = {}

    class Reader:
        def format(self, name):
            seen["format"] = name
            return self

        def options(self, **kw):
            seen.update(kw)
            return self

        def load(self):
            return seen

    class Session:
        read = Reader()

    got = tables.read_jdbc(Session(), "jdbc:x", "t", {"user": "u"}, ("id", 0, 100, 4))
    assert got["format"] == "jdbc" and got["dbtable"] == "t" and got["partitionColumn"] == "id" and got["numPartitions"] == 4


def test_shared_dir_is_read_from_the_session(spark):
    assert shared_dir(spark) == spark.sparkContext.getCheckpointDir().rstrip("/")
    with pytest.raises(ValueError):
        tables.find_tables_with_column({"a": spark.range(1)}, "absent")


def test_first_record_describes_whatever_it_says(spark, tmp_path):
    for name, about in (("a.txt", "The NDAR id"), ("b.txt", "Subject")):
        (tmp_path / name).write_text(f"src_subject_id\tdays_baseline\tscore\n{about}\tDays\tTotal\nS{name[0]}\t3\t1\nThe NDAR id\t4\t2\n")
    got = tables.read_questionnaire(spark, [str(tmp_path / "a.txt"), str(tmp_path / "b.txt")], date_col=None)
    assert sorted(map(tuple, got.collect())) == [("Sa", "3", "1"), ("Sb", "3", "1"), ("The NDAR id", "4", "2")]
