import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from civicsift.llm import exact_dedup, mixing, queries, simhash


def test_stages_in_order_on_messy_rows(messy, nothing, spark, tmp_path):
    labels = spark.createDataFrame([(n, int(n % 4 != 0)) for n in range(0, 40)], "doc_id long, quality int")
    folder = str(tmp_path)
    base = messy.select("doc_id", "text", "lang", "source", "n_chars")
    base.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality_classifier", "exact_dedup", "simhash_near_dedup", "mixing", "bpe"]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for docs in (messy, nothing):
        current = docs
        for name, stage in corpus_pipeline.STAGES:
            after = stage(spark, current, folder)
            if name != "bpe":
                assert after.columns == current.columns and set(after.collect()) <= set(current.collect())
            if name == "exact_dedup":
                assert after.count() == exact_dedup.decide(current).filter("kept").count()
            if name == "simhash_near_dedup":
                kept = simhash.components_of(current).filter("doc_id is null or doc_id = component_id")
                assert after.count() == kept.count()
            current = corpus_pipeline.materialise(after, name)
        for row in current.collect():
            assert row.round_trip and row.n_tokens == len(row.ids)
    whole = corpus_pipeline.run(spark, folder).collect()
    texts = {(r.doc_id, tuple(library.encode(r.text or "", add_special_tokens=False).ids)) for r in base.collect()}
    assert whole and {(r.doc_id, tuple(r.ids)) for r in whole} <= texts


def test_rejected_documents_go(messy, spark, tmp_path):
    spark.createDataFrame([(n, 0) for n in range(40)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.good_quality(spark, messy, str(tmp_path)).count() < messy.count() / 2


def test_every_operator_has_a_query():
    assert sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES) == list(range(1, 14))
    assert set(queries.ORACLE) <= set(queries.QUERIES) and mixing.MOST_COPIES == 3
