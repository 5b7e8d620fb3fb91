import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from civicsift.sources import comments, versions


def rows(spark, path):
    return sorted(tuple(r) for r in comments.read_csv(spark, path).collect())


@pytest.fixture
def target(spark, tmp_path):
    path = str(tmp_path / "data.csv")
    comments.write_csv(spark.createDataFrame([("1", "x"), ("2", "y")], "id string, body string"), path)
    return path


def test_overwrite_while_reading_and_failing_writer(spark, target):
    frame = comments.read_csv(spark, target)
    comments.write_output(frame.filter("id = '1'"), target, "_cleaned", inplace=True)
    assert rows(spark, target) == [("1", "x")]
    assert frame.count() == 2  # who reads the old rows still can
    bad = comments.read_csv(spark, target).withColumn("body", F.raise_error("stop").cast("string"))
    with pytest.raises(PySparkException):
        comments.write_output(bad, target, "_cleaned", inplace=True)
    assert rows(spark, target) == [("1", "x")] and versions.latest(spark, target) == 1


def test_second_writer_from_one_version_is_refused(spark, target):
    frame = comments.read_csv(spark, target)
    start = versions.latest(spark, target)
    versions.commit(spark, target, lambda path: comments.write_csv(frame, path), start)
    with pytest.raises(versions.ConflictError):
        versions.commit(spark, target, lambda path: comments.write_csv(frame.limit(0), path), start)
    assert len(rows(spark, target)) == 2


def test_old_versions_are_forgotten(spark, target, tmp_path):
    for number in range(4):
        frame = comments.read_csv(spark, target).withColumn("body", F.lit(f"v{number}"))
        comments.write_output(frame, target, "_cleaned", inplace=True)
    versions.forget(spark, target, keep=2)
    kept = sorted(p.name[:20] for p in (tmp_path / "data.csv").iterdir() if p.name.startswith("version-"))
    assert kept == ["version-000000000003", "version-000000000004"]
    assert rows(spark, target) == [("1", "v3"), ("2", "v3")]


def test_a_plain_file_is_replaced(spark, tmp_path):
    path = tmp_path / "one.csv"
    path.write_text("id,body\n1,x\n")
    comments.write_output(comments.read_csv(spark, str(path)).withColumn("body", F.lit("z")), str(path), "_cleaned", inplace=True)
    assert rows(spark, str(path)) == [("1", "z")]
