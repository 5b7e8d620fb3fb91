"""N-gram counts against a plain Python count."""

from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from civicsift.operators import tfidf
from civicsift.operators.grams import batch_terms, list_counts

LISTS = [["a", "b", "a", "b"], [], None, ["b"], ["a b", "c"], ["a", "b c"], ["ß", "ß", "ß"], ["c", "a"]]


def expected(words, low, high):
    words = words or []
    return Counter(" ".join(words[i:i + n]) for n in range(low, high + 1) for i in range(len(words) - n + 1))


@pytest.mark.parametrize("low, high", [(1, 1), (1, 2), (2, 3), (3, 3), (2, 1)])
def test_batch_terms(low, high):
    for lists in (LISTS, LISTS[:4], [], [None], [[]]):
        rows, numbers, counts, terms = batch_terms(pa.array(lists, pa.list_(pa.string())), low, high)
        found = [Counter() for _ in lists]
        for row, number, count in zip(rows.tolist(), numbers.tolist(), counts.tolist()):
            assert terms[number].as_py() not in found[row]
            found[row][terms[number].as_py()] = count
        assert found == [expected(words, low, high) for words in lists]


def test_document_counts(spark):
    frame = spark.createDataFrame([(words,) for words in LISTS], "tokens array<string>").repartition(3)
    wanted = Counter(term for words in LISTS for term in expected(words, 1, 2))
    assert {row.term: row.df for row in list_counts(frame, 1, 2).collect()} == wanted


def test_terms_are_counted_by_batch(spark):
    docs = spark.createDataFrame([(1, "the cat The cat"), (2, None), (3, "x")], "doc_id long, text string")
    settings = tfidf.BASELINE_SETTINGS
    counts = tfidf.term_counts(docs, settings, keep_empty=True)
    assert {(r.doc_id, r.term, r.tf) for r in counts.collect()} == {
        (1, "the", 2), (1, "cat", 2), (1, "the cat", 2), (1, "cat the", 1), (2, None, None), (3, None, None)}
    for frame in (counts, tfidf.document_frequency(docs, settings)):
        assert "lambda" not in frame._jdf.queryExecution().executedPlan().toString()  # nothing is interpreted per element


def test_large_vocabularies_are_joined_without_sorting_the_rows(spark):
    rows = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 7).alias("term"))
    table = spark.createDataFrame([(f"t{n}", 286, n) for n in range(5)], "term string, df long, idx long")
    joined = tfidf.with_vocabulary(rows, table, tfidf.BROADCAST_TERMS + 1, "left")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
    assert {(r.term, r.idx) for r in joined.collect()} == {(f"t{n}", n if n < 5 else None) for n in range(7)}
    assert joined.count() == 2000
