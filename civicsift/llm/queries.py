"""The registered queries of this package, each over its whole table, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civicsift.llm import (bpe, cover_tree, exact_dedup, fim, mixing, multi_index, ngram_join, passages, quality, simhash,
                           suffix_dedup, url_filter, warc)
from civicsift.llm.common import small_batches

Query = Callable[[SparkSession, str], DataFrame]

URL_RULES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block",
             "net/fr/": "block"}
QUALITY_THRESHOLD = 0.3


def vocabulary_path() -> str:
    """The vocabulary the queries encode with; read on the driver only."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.decide(table(spark, folder, "documents"))


def op2_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url")
    parts = url_filter.split_urls(pages, URL_RULES)
    model = url_filter.train(url_filter.label_by_rules(parts, URL_RULES))
    judged = url_filter.judge(parts, URL_RULES, model)
    return judged.select(F.col("row.page_id").alias("page_id"), "host", "path", "rule", "verdict", "score")


def held_out(id_column: str) -> Column:
    """Rows of the fold that no model learns from; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit(""))) % 5 == 0


def quality_model(docs: DataFrame, labels: DataFrame) -> quality.QualityModel:
    return quality.fit(docs, labels.filter(~held_out("doc_id")), "quality")


def op3_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = quality_model(docs, table(spark, folder, "labels"))
    scored = docs.select("doc_id", held_out("doc_id").alias("held_out"),
                         quality.score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= QUALITY_THRESHOLD).cast("int"))


def op4_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archive_and_read(table(spark, folder, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_passages(spark: SparkSession, folder: str) -> DataFrame:
    return passages.near_passages(table(spark, folder, "documents").select("doc_id", "text"))


def op6_simhash(spark: SparkSession, folder: str) -> DataFrame:
    grouped = simhash.components_of(table(spark, folder, "documents").select("doc_id", "text"))
    return grouped.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def op7_bpe(spark: SparkSession, folder: str) -> DataFrame:
    vocabulary = bpe.load_vocabulary(vocabulary_path())
    encoded = table(spark, folder, "documents").select("doc_id", bpe.encode(F.col("text"), vocabulary).alias("ids"))
    decoded = encoded.withColumn("decoded", bpe.decode(F.col("ids"), vocabulary))
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(table(spark, folder, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"),
                        "copies")


def op9_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(table(spark, folder, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
                      F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op10_multi_index(spark: SparkSession, folder: str) -> DataFrame:
    return multi_index.nearest(table(spark, folder, "embeddings"), F.col("id") % 20 == 0)


def op11_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    joined = ngram_join.join(table(spark, folder, "documents").select("doc_id", "text"))
    return joined.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def op12_fim(spark: SparkSession, folder: str) -> DataFrame:
    moved = fim.fill_in_middle(table(spark, folder, "documents").select("doc_id", "text"))
    return moved.select(F.col("row.doc_id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars",
                        F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return cover_tree.mine(table(spark, folder, "embeddings"), F.col("id") % 50 == 0, label)


QUERIES: dict[str, Query] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_url_filter": op2_url_filter,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_warc": op4_warc,
    "op5_passages": op5_passages,
    "op6_simhash": op6_simhash,
    "op7_bpe": op7_bpe,
    "op8_mixing": op8_mixing,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_multi_index": op10_multi_index,
    "op11_ngram_join": op11_ngram_join,
    "op12_fim": op12_fim,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLE: dict[str, str] = {
    "op1_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, length(coalesce(text, '')) AS len,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS h
            FROM documents)
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
               row_number() OVER w = 1 AS kept, h AS text_sha256
        FROM d WINDOW w AS (PARTITION BY h ORDER BY len DESC, doc_id)
    """,
    "op4_warc": """
        WITH p AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
                   sha1(coalesce(html, '')) AS payload_digest FROM pages),
        r AS (
            SELECT *, CASE WHEN payload_bytes >= 1000
                      THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS response FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id = response THEN NULL ELSE response END AS refers_to
        FROM r
    """,
    "op11_ngram_join": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS MATERIALIZED (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                   ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
                   END AS g FROM d),
        e AS MATERIALIZED (SELECT doc_id, len(g) AS n, hash(unnest(g)) AS sh FROM s),
        shared AS (
            SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb
            FROM e a JOIN e b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
        link AS (SELECT x, y FROM shared WHERE 100 * c >= 80 * (na + nb - c)),
        both_ways AS MATERIALIZED (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
        reach(id, other) AS (
            SELECT x, y FROM both_ways UNION SELECT r.id, b.y FROM reach r JOIN both_ways b ON b.x = r.other),
        least AS (SELECT id, min(other) AS other FROM reach GROUP BY id)
        SELECT doc_id, len(g) AS n_shingles, least(doc_id, coalesce(other, doc_id)) AS component_id
        FROM s LEFT JOIN least ON id = doc_id
    """,
    "op12_fim": """
        WITH h AS (
            SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
                   list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substring(
                       sha256('1:' || CAST(doc_id AS VARCHAR)), i, 8) AS BIGINT)) AS h FROM documents),
        c AS (
            SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
                   CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90
                        THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
        p AS (SELECT *, substring(t, 1, a) AS pre, substring(t, a + 1, b - a) AS mid, substring(t, b + 1) AS suf FROM c)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
               CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                      ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
               sha256(t) AS restored_sha256
        FROM p
    """,
    "op13_hard_negatives": """
        WITH v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(
                embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
                   CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
            FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
        p AS (
            SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
        SELECT anchor_id, positive_id,
               row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS rank,
               other AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s USING (anchor_id)
        WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
        QUALIFY rank <= 3
    """,
}
