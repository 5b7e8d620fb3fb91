"""Texts counted from their bytes, and vocabularies that are asked by batches, against the plain ways."""

import os
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from civicsift.functions.text import clean_text, model_tokens
from civicsift.operators import lookup, model, tfidf
from civicsift.operators.grams import bucket_numbers, list_counts, packed, plain_tokens, steps, summed, unpacked
from civicsift.session import materialise

TEXTS = ["The cat, the CAT!", "", None, "a b cd", "x", "  \t\x1c\n ", "snake_case 42 4", "é été the", "ab cd", "the cat sat", "ﬁn fin ΣΑΣ ΣΑΣ.",
         "cat\x00cat", "the-cat the cat", "Z" * 9000, "_ __ ___"]


def documents(spark):
    return spark.createDataFrame([(n, text) for n, text in enumerate(TEXTS * 3)], "doc_id long, text string").repartition(3)


def test_plain_tokens_are_those_of_the_regex(spark):
    plain = [text for text in TEXTS if (text or "").isascii()]
    frame = spark.createDataFrame(list(enumerate(plain)), "n int, text string")
    for lowercase in (True, False):
        rows = frame.select("n", model_tokens(clean_text(F.col("text")), lowercase=lowercase).alias("t")).orderBy("n").collect()
        assert plain_tokens(pa.array(plain, pa.string()), lowercase).to_pylist() == [row.t for row in rows]
        assert plain_tokens(pa.array(["head", *plain], pa.string())[1:], lowercase).to_pylist() == [row.t for row in rows]
    assert plain_tokens(pa.array([], pa.string()), True).to_pylist() == []


def test_buckets_depend_on_the_term_only():
    terms = ["", "a", "ab", "eight888", "the cat", "a much longer term", "a much longer tern"] + [f"term {n}" for n in range(3000)]
    numbers = bucket_numbers(pa.array(terms), 7)
    assert bucket_numbers(pa.array(terms[::-1]), 7)[::-1].tolist() == numbers.tolist()
    assert bucket_numbers(pa.array(terms)[3:], 7).tolist() == numbers[3:].tolist()
    assert min((numbers == bucket).sum() for bucket in range(7)) > 200


def test_counts_are_shuffled_in_packets(spark):
    docs = documents(spark)
    settings = tfidf.VectorizerSettings(ngram_range=(1, 2))
    found = tfidf.document_frequency(docs, settings)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in plan and "FlatMapGroupsInArrow" in plan  # a term is no row of a shuffle
    tokens = docs.select(tfidf.text_tokens(F.col("text"), settings).alias("tokens"))
    assert sorted(found.collect()) == sorted(list_counts(tokens, 1, 2).collect())


@pytest.mark.parametrize("settings", [
    tfidf.VectorizerSettings(ngram_range=(1, 2), sublinear_tf=True),
    tfidf.VectorizerSettings(norm="l1", binary=True, use_idf=False, token_pattern=r"[a-z ]+"),
])
def test_large_vocabularies_are_asked_by_batches(spark, monkeypatch, settings):
    docs = documents(spark)
    # ids that repeat or are null count as one document
    docs = docs.unionByName(docs.filter("doc_id < 2")).unionByName(docs.filter("doc_id > 40").withColumn("doc_id", F.lit(None).cast("long")))
    vocabulary = tfidf.fit_vocabulary(docs, settings)
    coef = F.when(F.col("idx") != 1, F.array((F.col("idx") % 3 - 1).cast("double"), F.when(F.col("idx") != 2, F.lit(0.5))))
    fitted = model.TextModel(settings, ["one", "two"], {}, [0.1, -0.2], vocabulary.table.withColumn("coef", coef), vocabulary.terms)

    def results():
        scored = model.score_texts(docs, fitted).select("doc_id", F.explode("probs").alias("value"))
        packs = tfidf.vectors(docs, vocabulary).select("doc_id", F.inline("cells"))
        out = [scored, packs, tfidf.tfidf(docs, vocabulary)]
        return out, [sorted(str((*row[:-1], round(row[-1], 9))) for row in frame.collect()) for frame in out]

    _, before = results()
    for module in (model, tfidf):
        monkeypatch.setattr(module, "BROADCAST_TERMS", 0)
    frames, after = results()
    assert after == before
    for frame in frames:  # batches ask and are answered, no row of a term is joined
        assert "FlatMapCoGroupsInArrow" in frame._jdf.queryExecution().executedPlan().toString()


def test_packets_are_compressed():
    terms, numbers = pa.array([f"some term {n}" for n in range(5000)]), [n + n // 9 for n in range(5000)]
    packet = packed({"term": terms, "step": steps(numbers)})
    assert len(packet) < terms.nbytes / 3
    assert unpacked(packet).column("term").equals(terms) and summed(unpacked(packet).column("step")).tolist() == numbers


def test_terms_that_the_vocabulary_lacks_are_not_asked_for(spark, monkeypatch):
    paths, path_of = [], lookup.scratch_path
    monkeypatch.setattr(lookup, "scratch_path", lambda session, name: paths.append(path_of(session, name)) or paths[-1])
    monkeypatch.setattr(model, "BROADCAST_TERMS", 0)
    docs = spark.createDataFrame([(n, f"known rare{n} odd{n} once{n}") for n in range(300)], "doc_id long, text string")
    table = spark.createDataFrame([("known", 0, [2.0])], "term string, idx long, coef array<double>")
    fitted = model.TextModel(tfidf.VectorizerSettings(use_idf=False), ["one"], {}, [0.0], table, 1)
    assert {round(row["probs"][0], 6) for row in model.score_texts(docs, fitted).collect()} == {0.880797}
    asked = [unpacked(row["asked"]).num_rows for row in spark.read.parquet(paths[0]).filter("asked IS NOT NULL").collect()]
    assert 0 < sum(asked) < 200  # of 901 different terms


def test_what_is_written_leaves_no_shuffle_files(spark):
    def files():
        folders = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
        return {name for folder in folders for _, _, names in os.walk(folder) for name in names if name.startswith("shuffle_")}

    before = files()
    written = materialise(spark.range(20_000).repartition(3).groupBy((F.col("id") % 999).alias("k")).count(), "counted")
    for _ in range(50):  # they are deleted in the background
        left = [name for name in files() - before if name.endswith(".data")]
        if not left:
            break
        time.sleep(0.1)
    assert not left and written.count() == 999


def test_rows_of_unique_documents_are_not_brought_together(spark, monkeypatch):
    monkeypatch.setattr(tfidf, "BROADCAST_TERMS", 0)
    docs = documents(spark)
    vocabulary = tfidf.fit_vocabulary(docs, tfidf.VectorizerSettings())
    for frame, again in ((docs, False), (docs.union(docs.limit(1)), True)):
        assert ("Window" in tfidf.tfidf(frame, vocabulary)._jdf.queryExecution().executedPlan().toString()) == again
