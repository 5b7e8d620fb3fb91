import csv
import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from civicsift.functions.rules import PatternSpec
from civicsift.operators import clean, stats
from civicsift.operators.model import TextModel
from civicsift.operators.tfidf import VectorizerSettings, fit_vocabulary
from civicsift.sources import artifacts, comments, patterns, reports


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode())


@pytest.fixture
def raw(tmp_path):
    root = tmp_path / "raw data"
    put(root / "cats+dogs" / "comments.csv", 'comment_id,body\nc1,"two\nlines, ""quoted"""\nc2,\nc3,"  pad "\n')
    put(root / "a b" / "deep" / "comments.csv", "body,comment_id,score\nhello,c4,007\n")
    put(root / "a b" / "other.csv", "body\nno\n")
    put(root / "comments.csv", "comment_id,body\nc9,top\n")
    return root


def test_merge_tags_and_fills(spark, raw):
    merged = comments.merge_comments(spark, str(raw), position=True)
    assert merged.columns[0] == "source_subreddit"
    rows = {r["comment_id"]: r for r in merged.collect()}
    assert rows["c1"]["body"] == 'two\nlines, "quoted"'
    assert (rows["c2"]["body"], rows["c3"]["body"], rows["c4"]["score"], rows["c1"]["score"]) == ("", "  pad ", "007", "")
    assert [rows[k]["source_subreddit"] for k in ("c1", "c4", "c9")] == ["cats+dogs", "a b", "raw data"]
    order = [r["comment_id"] for r in merged.orderBy("_position").collect()]
    assert order == ["c4", "c1", "c2", "c3", "c9"]
    assert tuple(comments.merge_counts(merged).first()) == (3, 5)


def test_reading_keeps_odd_cells(spark, tmp_path):
    rng = random.Random(11)
    pieces = ["a", "b c", '"', ",", "\n", "\r\n", "é", "", " ", "\n\n", '""', "long " * 30]
    written = []
    for name, crlf in (("one", False), ("two", True)):
        path = tmp_path / name / "comments.csv"
        path.parent.mkdir()
        with open(path, "w", newline="", encoding="utf-8") as out:
            writer = csv.writer(out, lineterminator="\r\n" if crlf else "\n")
            writer.writerow(["id", "body", "odd name"])
            for i in range(400):
                row = [f"{name}{i}", "".join(rng.choices(pieces, k=rng.randint(0, 12))), rng.choice("xyz")]
                writer.writerow(row)
                written.append((name, *row))
    names = ["source_subreddit", "id", "body", "odd name"]
    plain = comments.merge_comments(spark, str(tmp_path)).collect()
    # files with CRLF record ends: Spark's own reader turns CRLF inside cells into LF
    unify = lambda rows: sorted((a, b, c.replace("\r\n", "\n"), d) for a, b, c, d in rows)
    assert unify(tuple(r[n] for n in names) for r in plain) == unify(written)


def test_merge_failures(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        comments.merge_comments(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError):
        comments.merge_comments(spark, str(tmp_path))
    put(tmp_path / "x" / "comments.csv", "source_subreddit,body\na,b\n")
    with pytest.raises(ValueError):
        comments.merge_comments(spark, str(tmp_path))


def test_csv_write_reads_back_and_suits_pandas(spark, tmp_path):
    rows = [("1", ' "q", x\ny '), ("2", ""), ("3", "a\r\nb"), ("4", "plain")]
    frame = spark.createDataFrame(rows, "id string, body string")
    path = str(tmp_path / "out")
    comments.write_csv(frame.coalesce(1), path)
    assert sorted(map(tuple, comments.read_csv(spark, path).collect())) == rows
    part = next(os.path.join(path, f) for f in os.listdir(path) if f.startswith("part-"))
    back = pd.read_csv(part, dtype=str, keep_default_na=False)
    assert sorted(map(tuple, back.values.tolist())) == rows


def test_outputs_names_and_inplace(spark, tmp_path):
    path = str(tmp_path / "data.csv")
    comments.write_csv(spark.createDataFrame([("1", "x")], "id string, body string"), path)
    frame = comments.read_csv(spark, path)
    target = comments.write_output(frame.withColumn("n", F.lit("5")), path, "_labeled")
    assert target == str(tmp_path / "data_labeled.csv")
    assert comments.read_csv(spark, target).columns == ["id", "body", "n"]
    comments.write_output(frame.withColumn("n", F.lit("6")), path, "_labeled", inplace=True)
    assert [tuple(r) for r in comments.read_csv(spark, path).collect()] == [("1", "x", "6")]


def test_safe_read(spark, tmp_path):
    with pytest.warns(UserWarning):
        assert comments.safe_read_csv(spark, str(tmp_path / "nothing.csv")).columns == []
    with pytest.warns(UserWarning), pytest.raises(ValueError):
        comments.load_comments(spark, str(tmp_path / "nothing.csv"))


def test_pattern_files(spark, tmp_path):
    put(tmp_path / "toxic.tsv", "# words\n\n\\btrash\\b\t1.5\r\nplain\nempty\t\n  x\\ty\t2  \n")
    specs = patterns.load_pattern_file(spark, str(tmp_path / "toxic.tsv"), "toxic")
    assert specs == [
        PatternSpec("toxic", r"\btrash\b", 1.5), PatternSpec("toxic", "plain"), PatternSpec("toxic", "empty"),
        PatternSpec("toxic", r"x\ty", 2.0)]
    put(tmp_path / "insult.tsv", "clown\\t0.8\n")
    loaded = patterns.load_pattern_dir(spark, str(tmp_path), allow_missing=True)
    assert [s.label for s in loaded] == ["toxic"] * 4 + ["insult"]
    assert loaded[-1] == PatternSpec("insult", "clown", 0.8)
    with pytest.raises(FileNotFoundError):
        patterns.load_pattern_dir(spark, str(tmp_path))
    merged = patterns.extend_patterns(loaded, [PatternSpec("toxic", "more"), PatternSpec("toxic", "plain")])
    assert [s.pattern for s in merged][:6] == [r"\btrash\b", "plain", "empty", r"x\ty", "more", "plain"]
    for bad in ("(", "a*"):
        put(tmp_path / "threat.tsv", f"ok\n{bad}\n")
        with pytest.raises(ValueError, match="threat.tsv:2"):
            patterns.load_pattern_file(spark, str(tmp_path / "threat.tsv"), "threat")
    put(tmp_path / "threat.tsv", "ok\tabc\n")
    with pytest.raises(Exception):
        patterns.load_pattern_file(spark, str(tmp_path / "threat.tsv"), "threat")


def test_reports(spark, tmp_path):
    frame = spark.createDataFrame([("a", "one two"), ("b", "x")], "subreddit string, body_clean string")
    table = reports.summary_table(stats.dataset_summary(frame))
    assert [tuple(r) for r in table.collect()] == [
        ("Total komentar", "2"), ("Jumlah subreddit", "2"), ("Rata-rata panjang (karakter)", "4.0"),
        ("Median panjang (karakter)", "4.0"), ("Rata-rata panjang (token)", "1.5"), ("Median panjang (token)", "1.5")]
    reports.write_table(table, str(tmp_path / "summary"))
    assert comments.read_csv(spark, str(tmp_path / "summary")).count() == 6
    reports.write_text(spark, "line\nmore", str(tmp_path / "report.txt"))
    assert (tmp_path / "report.txt").read_text().rstrip("\n") == "line\nmore"


def test_report_lines(spark):
    counts = spark.createDataFrame([("toxic", 12), ("identity_hate", 3)], "label string, positives long")
    assert [r["line"] for r in reports.label_lines(counts).collect()] == ["toxic         : 12", "identity_hate : 3"]
    totals = spark.createDataFrame([(9, 2, 3, 4)], "input_rows long, removed_empty long, removed_duplicates long, output_rows long")
    assert [r["line"] for r in reports.clean_lines(totals).collect()] == [
        "Input rows: 9", "Removed empty/url-only bodies: 2", "Removed duplicate bodies: 3", "Output rows: 4"]
    merged = spark.createDataFrame([(2, 1234567)], "files long, rows long")
    assert reports.merge_lines(merged).first()["line"] == "Merged 2 files (1,234,567 rows)"


def test_cut_offs_keep_their_number_type(spark, tmp_path):
    vocabulary = spark.createDataFrame([("a", 1, 0, 1.0, [0.5])], "term string, df long, idx long, idf double, coef array<double>")
    settings = VectorizerSettings()
    fitted = TextModel(settings, ["toxic"], {}, [0.1], vocabulary, 1, {"solver": "lbfgs", "penalty": "l2", "C": 2.0, "max_iter": 9})
    artifacts.export_json(fitted, str(tmp_path))
    loaded = artifacts.load_json(spark, str(tmp_path))
    assert (loaded.settings.min_df, loaded.settings.max_df) == (1, 1.0) and isinstance(loaded.settings.max_df, float)
    assert loaded.classifier == fitted.classifier
    docs = spark.createDataFrame([(n, "word other") for n in range(3)], "doc_id int, text string")
    assert fit_vocabulary(docs, loaded.settings).terms == 2


def test_numbers_are_decimal(spark):
    texts = ["1", " 2.5 ", "-.5e3", "1d", "2f", "0x1", "", "nan", "1_0", "inf"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r["v"] for r in frame.select(clean._number(F.col("t")).alias("v")).collect()] == [
        1.0, 2.5, -500.0, None, None, None, None, None, None, float("inf")]


def test_headers_of_many_shapes(spark, tmp_path):
    root = tmp_path / "raw"
    put(root / "a" / "comments.csv", "﻿id,body\n1,x\n")
    put(root / "b" / "comments.csv", 'body,"odd, name",id,body,\ny,o,2,again,u\nz\n')
    put(root / "c" / "comments.csv", "ID,score\n3,9\n")
    put(root / "d" / "comments.csv", "")
    put(root / "e" / "comments.csv", "id,body\n")
    merged = comments.merge_comments(spark, str(root))
    assert merged.columns == ["source_subreddit", "id", "body", "odd, name", "body.1", "Unnamed: 4", "score"]
    assert sorted(tuple(r) for r in merged.collect()) == [
        ("a", "1", "x", "", "", "", ""), ("b", "", "z", "", "", "", ""), ("b", "2", "y", "o", "again", "u", ""),
        ("c", "3", "", "", "", "", "9")]
    put(root / "f" / "comments.csv", "source_subreddit\nq\n")
    with pytest.raises(ValueError, match="already exists"):
        comments.merge_comments(spark, str(root))
    with pytest.raises(ValueError, match="no nothing.csv files"):
        comments.merge_comments(spark, str(root), name="nothing.csv")
    with pytest.raises(FileNotFoundError):
        comments.merge_comments(spark, str(tmp_path / "missing"))


def test_tolerant_read(spark, tmp_path):
    root = tmp_path / "raw"
    put(root / "a" / "comments.csv", 'id,body\n1,"x, ""y"""\n2,a,b\n3\n')
    put(root / "b" / "comments.csv", "id,body,score\n4,z,5\n6,z,5,\n")
    put(root / "c" / "comments.csv", "id,title\n7,t\n")
    put(root / "d" / "comments.csv", "")
    rows, failures = comments.read_tolerant(spark, str(root))
    assert sorted(tuple(r) for r in rows.collect()) == [
        ("a", "1", 'x, "y"', ""), ("a", "3", "", ""), ("b", "4", "z", "5")]
    assert sorted((r["path"].split("/")[-2], r["problem"], r["record"]) for r in failures.collect()) == [
        ("a", "3 cells for 2 columns", "2,a,b"), ("b", "4 cells for 3 columns", "6,z,5,"), ("c", "no column body", "")]


def test_pattern_table_numbers_lines_and_tells_faults(spark, tmp_path):
    put(tmp_path / "base" / "toxic.tsv", "# c\n\nplain\x85second\r\nbad(\t1\n\tonly\t2\nword\theavy\n" + "many\n" * 500)
    put(tmp_path / "base" / "insult.tsv", "clown\\t0.8\n")
    put(tmp_path / "base" / "notes.tsv", "ignored\n")
    put(tmp_path / "extra" / "toxic.tsv", "plain\n")
    with pytest.raises(FileNotFoundError, match="severe_toxic, obscene"):
        patterns.pattern_files(spark, str(tmp_path / "base"))
    for label in ("severe_toxic", "obscene", "threat", "identity_hate", "racism"):
        put(tmp_path / "base" / f"{label}.tsv", "# nothing yet\n")
    table = patterns.pattern_files(spark, str(tmp_path / "base"), str(tmp_path / "extra"))
    rows = [(r["origin"], r["label"], r["line"], r["pattern"], r["weight"], (r["problem"] or "").split(":")[0])
            for r in table.orderBy("number").collect()]
    assert rows[:5] == [
        (0, "toxic", 3, "plain", 1.0, ""), (0, "toxic", 4, "second", 1.0, ""), (0, "toxic", 5, "bad(", 1.0, "invalid regex"),
        (0, "toxic", 6, "only", 2.0, ""), (0, "toxic", 7, "word", None, "no number")]
    assert [r[2] for r in rows[5:505]] == list(range(8, 508))
    assert rows[505:] == [(1, "toxic", 1, "plain", 1.0, ""), (0, "insult", 1, "clown", 0.8, "")]
    with pytest.raises(ValueError, match="toxic.tsv:5: invalid regex.*toxic.tsv:7: no number: heavy"):
        patterns.require_valid(table)
    assert patterns.require_valid(table.filter("problem IS NULL")).count() == len(rows) - 2
