"""Streaming queries over tables that are folders of files, and over single files."""

import pytest

from civicsift.plans import registry


@pytest.mark.parametrize("parts", [1, 3])
def test_streams_read_every_file_of_a_table(spark, tmp_path, parts):
    rows = [(n, "What an idiot. Quite so." if n % 2 else "All is well here.", "en", "web", 20) for n in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(parts).write.parquet(f"{tmp_path}/documents.parquet")
    labeled = registry.stream_label(spark, str(tmp_path))
    assert {(r.doc_id, r.labels != "") for r in labeled.collect()} == {(n, bool(n % 2)) for n in range(12)}


def test_streams_read_one_file(spark, tmp_path):
    events = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "user_id long, event_type string")
    events.coalesce(1).write.parquet(f"{tmp_path}/made")
    source = next((tmp_path / "made").glob("part-*.parquet"))
    (tmp_path / "events.parquet").write_bytes(source.read_bytes())
    assert sorted(map(tuple, registry.stream_dedupe(spark, str(tmp_path)).collect())) == [(1, "a"), (2, "b")]
