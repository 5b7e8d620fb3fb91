import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from civicsift.operators import clean, prepare, split, stats
from civicsift.operators.prefix import running_totals, spread_lookup


def rows_of(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_best_row_per_text(spark):
    data = [
        (1, "Hello  World", "0.2", "5", "c1"), (2, "hello world ", "0.9", "1", "c2"),
        (3, "HELLO\nWORLD", "bad", "9", "c3"), (4, "tie", "1", "5", "a"), (5, "Tie", "1.0", "6", "a"),
        (6, "id", "1", "5", "a"), (7, "ID", "1", "5", "b"), (8, "same", "1", "5", "a"), (9, "same", "1", "5", "a"),
        (10, "", "1", "1", "x"), (11, "https://x y", "1", "1", "x"), (12, "nan", "NaN", "1", "q"),
        (13, "NAN", "-1", "0", "p"),
    ]
    frame = spark.createDataFrame(data, "n int, body string, toxic_score string, created_utc string, comment_id string")
    best = clean.clean_comments(frame, position=F.col("n"))
    assert best.columns == frame.columns
    assert rows_of(best, "n") == [(2,), (5,), (7,), (8,), (13,)]
    assert rows_of(clean.clean_comments(frame, keep_first=True, position=F.col("n")), "n") == [
        (1,), (4,), (6,), (8,), (12,)]
    assert rows_of(clean.clean_comments(frame.drop("toxic_score"), position=F.col("n")), "n") == [
        (3,), (5,), (7,), (8,), (12,)]
    bare = clean.clean_comments(frame.select("n", "body"), position=F.col("n"))
    assert rows_of(bare, "n") == [(1,), (4,), (6,), (8,), (12,)]
    placed = frame.withColumn("_position", F.struct(F.lit(0).alias("file"), F.col("n").alias("row")))
    assert rows_of(clean.clean_comments(placed), "n") == [(2,), (5,), (7,), (8,), (13,)]
    assert tuple(clean.clean_counts(frame).first()) == (13, 2, 6, 5)
    ordered = [r["n"] for r in clean.sort_cleaned(best).collect()]
    assert ordered == [5, 7, 8, 2, 13]
    first = clean.clean_comments(placed, keep_first=True)
    assert [r["n"] for r in clean.sort_cleaned(first, keep_first=True).collect()] == [1, 4, 6, 8, 12]
    again = clean.clean_comments(best, position=F.col("n"))
    assert rows_of(again, "n") == rows_of(best, "n")


def test_copies_are_reduced_before_the_shuffle(spark):
    frame = spark.range(1000).select(F.col("id"), F.lit("copy").alias("body"))
    plan = clean.clean_comments(frame, position=F.col("id"))._jdf.queryExecution().executedPlan().toString()
    assert "partial_max_by" in plan and plan.count("Exchange") == 1 and "Window" not in plan


def test_prepare(spark):
    data = [
        ("c1", "x", "1", "0.9"), ("c1", "later", "1", "1"), ("c2", "[deleted]", "1", "1"), ("c3", "http://x", "1", "1"),
        ("c4", "HTTP ok", "10", "True"), ("c5", " \n ", "1", "1"), ("c6", "a\n b", "", "x7"),
    ]
    frame = spark.createDataFrame(data, "comment_id string, body string, toxic_bin string, insult string")
    out = prepare.prepare_frame(frame, position=F.monotonically_increasing_id())
    assert rows_of(out, "comment_id", "body_clean", "toxic", "insult", "threat", "post_id") == [
        ("c1", "x", 1, 0, 0, ""), ("c4", "HTTP ok", 1, 0, 0, ""), ("c6", "a b", 0, 1, 0, "")]
    no_id = prepare.prepare_frame(frame.drop("comment_id"))
    assert rows_of(no_id, "body_clean") == [("HTTP ok",), ("a b",), ("later",), ("x",)]
    assert rows_of(prepare.label_rows(out.limit(1), ["comment_id"], ["toxic", "threat"]), "label", "y") == [
        ("threat", 0), ("toxic", 1)]
    counts = prepare.blank_counts(spark.createDataFrame(
        [("a", ""), ("a", None), ("a", "x"), ("b", "y")], "split string, body_clean string"))
    assert rows_of(counts, "split", "rows", "blank_rows") == [("a", 3, 2), ("b", 1, 0)]
    assert prepare.preview(out).count() == 3


@pytest.fixture
def threads(spark):
    rng = random.Random(3)
    rows = []
    for thread in range(600):
        flags = (int(rng.random() < 0.3), int(rng.random() < 0.1))
        # one thread holds about a third of all comments
        for _ in range(1500 if thread == 17 else rng.randint(1, 9)):
            rows.append((f"t{thread}", f"c{len(rows)}", flags[0] & rng.randint(0, 1), flags[1] & rng.randint(0, 1)))
    return spark.createDataFrame(rows, "post_id string, comment_id string, toxic int, insult int")


def test_split_keeps_threads_whole_and_shares_even(spark, threads):
    labels = ["toxic", "insult"]
    out = split.thread_stratified_split(threads, labels)
    assert out.count() == threads.count()
    assert rows_of(out, "comment_id") == rows_of(threads, "comment_id")
    per_thread = out.groupBy("post_id").agg(F.count_distinct("split").alias("n"), F.max("split").alias("split"))
    assert per_thread.filter("n <> 1").count() == 0
    sizes = {r["split"]: r["count"] for r in per_thread.groupBy("split").count().collect()}
    assert sizes == {"train": 400, "val": 100, "test": 100}
    vectors = split.thread_labels(threads, labels).join(per_thread, "post_id")
    for r in vectors.groupBy(*labels).pivot("split", ["train", "val", "test"]).count().na.fill(0).collect():
        total = r["train"] + r["val"] + r["test"]
        assert abs(r["train"] - total * 4 / 6) <= 3 and abs(r["val"] - total / 6) <= 2
    again = split.thread_stratified_split(threads, labels)
    assert rows_of(again, "comment_id", "split") == rows_of(out, "comment_id", "split")
    other = split.thread_stratified_split(threads, labels, seed=1)
    assert rows_of(other, "comment_id", "split") != rows_of(out, "comment_id", "split")


def test_spread_lookup_equals_plain_join(spark):
    rows = spark.range(9000).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, F.lit(None)).otherwise(
            F.concat(F.lit("k"), F.col("id") % 400)).alias("key"))
    table = rows.groupBy("key").count().filter("key is not null and key <> 'k5'").select(
        "key", F.col("count").alias("n"), F.upper("key").alias("value"))
    for how in ("left", "inner"):
        mine = spread_lookup(rows, table, "key", "n", 9000, how)
        plain = rows.join(table.drop("n"), "key", how).select("id", "key", "value")
        assert mine.count() == plain.count()
        assert mine.exceptAll(plain).count() == 0


def test_spread_lookup_places_a_hot_key_over_all_tasks(spark):
    rows = spark.range(20_000).select("id", F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("key"))
    table = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).withColumn("value", F.col("key") * 2)
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false",
                "spark.sql.shuffle.partitions": "16"}
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        sizes = spread_lookup(rows, table, "key", "n", 20_000).groupBy(F.spark_partition_id().alias("p")).agg(
            F.count(F.lit(1)).alias("rows"), F.sum("value")).collect()  # the sum keeps the join in the plan
        assert len(sizes) == 16 and max(row["rows"] for row in sizes) < 2 * 20_000 / 16
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def test_running_totals_equal_window(spark):
    rng = np.random.default_rng(0)
    rows = [(f"k{i % 3}", float(x), int(n)) for i, (x, n) in enumerate(zip(rng.random(500), rng.integers(0, 9, 500)))]
    frame = spark.createDataFrame(rows, "k string, x double, n int")
    got = running_totals(frame, ["k"], F.floor(F.col("x") * 8), [F.col("x")], ["n"]).collect()
    for r in got:
        assert r["n_before"] == sum(n for k, x, n in rows if k == r["k"] and x < r["x"])
    assert len(got) == 500


def test_summary_distribution_histogram(spark):
    rng = random.Random(5)
    texts = [" ".join("w" * rng.randint(1, 9) for _ in range(rng.randint(1, 200))) for _ in range(300)]
    frame = spark.createDataFrame(
        [(t, f"s{i % 7}", i % 3 % 2) for i, t in enumerate(texts)], "body_clean string, subreddit string, toxic int")
    chars, tokens = [len(t) for t in texts], [len(t.split()) for t in texts]
    row = stats.dataset_summary(frame).first()
    assert tuple(row) == (
        300, 7, round(float(np.mean(chars)), 2), round(float(np.median(chars)), 2),
        round(float(np.mean(tokens)), 2), round(float(np.median(tokens)), 2))
    assert tuple(stats.label_distribution(frame, ["toxic"]).first()) == ("toxic", 100, 33.33)
    for values in (tokens, [4] * 300):
        data = spark.createDataFrame([(" ".join(["a"] * n),) for n in values], "body_clean string")
        counts, edges = np.histogram(values, bins=60)
        got = stats.length_histogram(data).orderBy("bin").collect()
        assert [r["comments"] for r in got] == counts.tolist()
        assert all(math.isclose(r["left"], e) for r, e in zip(got, edges))
    assert stats.length_histogram(frame.filter(F.lit(False))).count() == 0


def test_counts_are_observed_in_one_pass(spark, tmp_path):
    rows = [("a", "x"), ("b", " X "), ("c", ""), ("d", "http://y"), ("e", "z"), ("f", None)]
    spark.createDataFrame(rows, "comment_id string, body string").write.parquet(str(tmp_path / "in"))
    frame = spark.read.parquet(str(tmp_path / "in"))
    observer = clean.CleanObserver()
    kept = clean.clean_comments(frame, observer=observer)
    assert kept._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    kept.write.parquet(str(tmp_path / "out"))
    assert observer.counts() == {"input_rows": 6, "removed_empty": 3, "removed_duplicates": 1, "output_rows": 2}
    assert tuple(clean.clean_counts(frame).first()) == (6, 3, 1, 2)
