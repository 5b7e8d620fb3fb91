import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from civicsift.llm import quality, queries


@pytest.fixture(scope="module")
def corpus(spark, make_words):
    rng = random.Random(3)
    rows = []
    for number in range(400):
        good = rng.random() < 0.7
        text = make_words(rng, 60) if good else " ".join(w + rng.choice(["!!", "###"]) for w in make_words(rng, 60).upper().split())
        rows.append((number, text, int(good)))
    return spark.createDataFrame(rows, "doc_id long, text string, quality int")


def test_held_out_accuracy_and_reruns(corpus):
    def scores():
        model = queries.quality_model(corpus.drop("quality"), corpus.drop("text"))
        return {r.doc_id: (r.score, r.quality, r.held) for r in corpus.select(
            "doc_id", "quality", queries.held_out("doc_id").alias("held"), quality.score(F.col("text"), model).alias("score")).collect()}

    first = scores()
    held = [(score >= 0.3) == bool(label) for score, label, is_held in first.values() if is_held]
    assert len(held) > 50 and np.mean(held) > 0.98
    assert scores() == first


def test_held_out_labels_are_not_learned(corpus):
    flipped = corpus.withColumn("quality", F.when(queries.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = (queries.quality_model(c.drop("quality"), c.drop("text")) for c in (corpus, flipped))
    assert np.array_equal(one.slots, two.slots) and np.array_equal(one.weights, two.weights)


def test_sparse_dot_product_is_the_brute_force_sum(corpus):
    model = queries.quality_model(corpus.drop("quality"), corpus.drop("text"))
    weights = dict(zip(model.slots.tolist(), model.weights.tolist(), strict=True))
    for text in ("aa bb aa!! CC", "", None, "one"):
        slots, values = quality.features(text)
        margin = sum(weights.get(slot, 0.0) * value for slot, value in zip(slots.tolist(), values.tolist(), strict=True))
        assert model.scorer()(text) == pytest.approx(1 / (1 + np.exp(-(margin + weights.get(quality.BIAS, 0.0)))))


def test_messy_rows_and_no_labels(messy, nothing, spark):
    labels = spark.createDataFrame([(7, 1), (7, None), (None, 1), (8, 0), (999, 1)], "doc_id long, quality int")
    model = quality.fit(messy, labels, "quality")
    rows = messy.withColumn("own_score", quality.score(F.col("text"), model)).collect()
    assert len(rows) == messy.count() and all(0 <= r.own_score <= 1 for r in rows)
    assert len({r.own_score for r in rows if not (r.text or "").strip(" \t\r\n")}) == 1
    empty = quality.fit(nothing, labels.limit(0), "quality")
    assert empty.scorer()("any text") == 0.5
    assert nothing.withColumn("s", quality.score(F.col("text"), empty)).collect() == []


def test_fit_is_bounded(corpus):
    docs, labels = corpus.drop("quality"), corpus.drop("text")
    lowest = labels.orderBy(F.xxhash64("doc_id")).limit(10)
    some, same = quality.fit(docs, labels, "quality", fit_rows=10), quality.fit(docs, lowest, "quality")
    assert some.slots.size and np.array_equal(some.slots, same.slots) and np.array_equal(some.weights, same.weights)
