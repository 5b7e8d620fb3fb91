"""Queries over the given tables, one per operator family.

``documents`` stands for comments (thread = ``doc_id % 50``), ``conversations`` for texts with
sentences, ``pages`` for web pages, ``labels`` for truth. Every query reads its tables whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicsift.constants import LABELS
from civicsift.functions.text import (
    clean_text,
    dedupe_key,
    model_tokens,
    ngrams,
    rule_tokens,
)
from civicsift.operators import clean, hits, label, mask, metrics, model, prepare, split, stats, tfidf
from civicsift.operators.order import number_rows
from civicsift.plans.lexicon import PATTERNS, QUERY_NEGATORS
from civicsift.plans.pipeline import train
from civicsift.session import materialise, scratch_path, spread
from civicsift.sources import artifacts, comments, patterns, reports
from civicsift.sources.files import publish
from civicsift.streaming import scan

Query = Callable[[SparkSession, str], DataFrame]

# Parameters of the deterministic model the scoring queries use; the oracle repeats them.
MODEL_LABELS = ["toxic", "insult", "threat"]
MODEL_THRESHOLDS = {"toxic": 0.55, "insult": 0.6}
MODEL_INTERCEPTS = [-0.25, -0.5, 0.1]
MASK_THRESHOLDS = {"toxic": 0.75, "insult": 0.8, "threat": 0.9}
EVAL_THRESHOLDS = {"toxic": 0.4}


# Tables of long texts, whose queries are bound by computing and not by reading.
TEXT_TABLES = ("documents", "conversations", "pages")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    frame = spark.read.parquet(f"{folder}/{name}.parquet")
    return spread(frame) if name in TEXT_TABLES else frame


def as_comments(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return docs.select(
        F.col("source").alias("source_subreddit"),
        (F.col("doc_id") % 50).cast("string").alias("post_id"),
        F.col("doc_id").cast("string").alias("comment_id"),
        F.col("text").alias("body"),
        F.col("source").alias("subreddit"),
    )


def labeled(spark: SparkSession, folder: str) -> DataFrame:
    return label.label_comments(as_comments(spark, folder), PATTERNS, negators=QUERY_NEGATORS)


def scored_comments(spark: SparkSession, folder: str) -> DataFrame:
    """Comments with a score column as text, blank where there is no truth."""
    truth = table(spark, folder, "labels").select(
        F.col("doc_id").cast("string").alias("comment_id"), F.col("toxic").cast("string").alias("toxic_score"))
    docs = table(spark, folder, "documents").select(
        F.col("doc_id").cast("string").alias("comment_id"), "doc_id", F.col("text").alias("body"),
        F.col("n_chars").cast("string").alias("created_utc"), F.col("source").alias("source_subreddit"))
    return docs.join(truth, "comment_id", "left").na.fill("", ["toxic_score"])


def merge_union(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select(
        F.lit("documents").alias("source_subreddit"), F.col("doc_id").cast("string").alias("comment_id"),
        "lang", F.col("text").alias("body"))
    turns = table(spark, folder, "conversations").select(
        F.lit("conversations").alias("source_subreddit"), F.col("conv_id").cast("string").alias("post_id"),
        "role", F.col("text").alias("body"))
    items = table(spark, folder, "benchmark").select(
        F.lit("benchmark").alias("source_subreddit"), F.col("item_id").cast("string").alias("comment_id"),
        F.col("text").alias("body"))
    return comments.concat_frames([docs, turns, items])


def csv_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "csv")
    frame = table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "source", "text")
    comments.write_csv(frame, path)
    return comments.read_csv(spark, path)


def clean_best(spark: SparkSession, folder: str) -> DataFrame:
    kept = clean.clean_comments(scored_comments(spark, folder), position=F.col("doc_id"))
    return kept.select("comment_id", "source_subreddit", "toxic_score", "created_utc", "body")


def clean_first(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", F.col("text").alias("body"), "source")
    return clean.clean_comments(docs, keep_first=True, position=F.col("doc_id"))


def clean_counts(spark: SparkSession, folder: str) -> DataFrame:
    return clean.clean_counts(as_comments(spark, folder))


def observed_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The counters of cleaning, taken while the cleaned rows are written."""
    observer = clean.CleanObserver()
    kept = clean.clean_comments(as_comments(spark, folder), observer=observer)
    comments.write_csv(kept, scratch_path(spark, "cleaned"))
    counts = observer.counts()
    return spark.createDataFrame([tuple(counts.values())], ", ".join(f"{name} long" for name in counts))


def normalised(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(
        "doc_id", F.md5(dedupe_key(F.col("text"))).alias("dedupe_md5"),
        F.md5(clean_text(F.col("text"))).alias("clean_md5"))


def label_rules(spark: SparkSession, folder: str) -> DataFrame:
    return labeled(spark, folder).drop("body", "subreddit", "post_id")


def label_counts(spark: SparkSession, folder: str) -> DataFrame:
    return stats.label_counts(labeled(spark, folder))


def label_overall(spark: SparkSession, folder: str) -> DataFrame:
    totals = stats.overall_toxicity(labeled(spark, folder))
    return totals.withColumns({
        "toxic_percent": F.round("toxic_percent", 6), "clean_percent": F.round("clean_percent", 6)})


def label_by_source(spark: SparkSession, folder: str) -> DataFrame:
    return stats.source_toxicity(labeled(spark, folder)).withColumn("toxic_percent", F.round("toxic_percent", 6))


def label_source_detail(spark: SparkSession, folder: str) -> DataFrame:
    return stats.source_labels(labeled(spark, folder))


def label_scores(spark: SparkSession, folder: str) -> DataFrame:
    rows = labeled(spark, folder).select("comment_id", label.score_map().alias("scores"))
    return rows.select("comment_id", F.explode("scores").alias("label", "score"))


def source_report(spark: SparkSession, folder: str) -> DataFrame:
    return reports.source_lines(stats.source_toxicity(labeled(spark, folder)))


def overall_report(spark: SparkSession, folder: str) -> DataFrame:
    return reports.overall_lines(stats.overall_toxicity(labeled(spark, folder)))


def label_report(spark: SparkSession, folder: str) -> DataFrame:
    return reports.label_lines(stats.label_counts(labeled(spark, folder)))


def source_label_report(spark: SparkSession, folder: str) -> DataFrame:
    return reports.label_lines(stats.source_labels(labeled(spark, folder)), "source_subreddit")


def clean_report(spark: SparkSession, folder: str) -> DataFrame:
    return reports.clean_lines(clean_counts(spark, folder))


def summary_report(spark: SparkSession, folder: str) -> DataFrame:
    return reports.summary_table(stats.dataset_summary(prepared(spark, folder)))


def label_then_clean(spark: SparkSession, folder: str) -> DataFrame:
    kept = clean.clean_comments(labeled(spark, folder), position=F.col("comment_id").cast("long"))
    return kept.select("comment_id", "source_subreddit", "toxic_score", "labels")


def prepared(spark: SparkSession, folder: str) -> DataFrame:
    truth = table(spark, folder, "labels").select(
        F.col("doc_id").cast("string").alias("comment_id"),
        F.col("toxic").cast("string").alias("toxic_bin"), F.col("quality").cast("string").alias("insult"))
    frame = as_comments(spark, folder).join(truth, "comment_id", "left")
    return prepare.prepare_frame(frame, position=F.col("comment_id").cast("long"))


def prepare_frame(spark: SparkSession, folder: str) -> DataFrame:
    return prepared(spark, folder).select(
        "comment_id", "post_id", "created_utc", "toxic", "insult", "threat",
        F.md5("body_clean").alias("body_md5"))


def dataset_summary(spark: SparkSession, folder: str) -> DataFrame:
    return stats.dataset_summary(prepared(spark, folder))


def label_distribution(spark: SparkSession, folder: str) -> DataFrame:
    return stats.label_distribution(prepared(spark, folder), ["toxic", "insult", "threat"])


def length_histogram(spark: SparkSession, folder: str) -> DataFrame:
    bins = stats.length_histogram(prepared(spark, folder))
    return bins.select("bin", F.round("left", 6).alias("left"), F.round("right", 6).alias("right"), "comments")


def truth_frame(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "n_chars", "text")
    truth = table(spark, folder, "labels").select("doc_id", "toxic", "quality")
    return docs.join(truth, "doc_id").withColumn("post_id", F.col("doc_id") % 50)


def thread_frame(spark: SparkSession, folder: str) -> DataFrame:
    """All documents with their threads; those without truth count as unlabelled."""
    docs = table(spark, folder, "documents").select("doc_id", "n_chars", (F.col("doc_id") % 50).alias("post_id"))
    truth = table(spark, folder, "labels").select("doc_id", "toxic", "quality")
    return docs.join(truth, "doc_id", "left").na.fill(0, ["toxic", "quality"])


def thread_labels(spark: SparkSession, folder: str) -> DataFrame:
    return split.thread_labels(thread_frame(spark, folder), ["toxic", "quality"])


def thread_split(spark: SparkSession, folder: str) -> DataFrame:
    order = (F.col("post_id") * F.lit(2654435761)) % F.lit(1 << 32)
    frame = thread_frame(spark, folder).select("doc_id", "post_id", "toxic", "quality")
    return split.thread_stratified_split(frame, ["toxic", "quality"], order=order)


def blank_counts(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").select(
        F.col("lang").alias("split"), clean_text(F.regexp_replace("text", "[A-Za-z]", "")).alias("body_clean"))
    return prepare.blank_counts(rows)


def tokens(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    rules, words = rule_tokens(F.col("text")), model_tokens(F.col("text"))
    return docs.select(
        "doc_id", F.size(rules).cast("long").alias("rule_tokens"), F.md5(F.array_join(rules, " ")).alias("rule_md5"),
        F.size(words).cast("long").alias("model_tokens"), F.md5(F.array_join(words, " ")).alias("model_md5"))


def ngram_lists(spark: SparkSession, folder: str) -> DataFrame:
    grams = ngrams(model_tokens(F.col("text"), stop_words=["the", "of"]), 1, 3)
    return table(spark, folder, "documents").select(
        "doc_id", F.size(grams).cast("long").alias("n"), F.md5(F.array_join(grams, "|")).alias("ngram_md5"))


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", "text")


def doc_freq(spark: SparkSession, folder: str) -> DataFrame:
    terms, _ = tfidf.select_terms(_docs(spark, folder), tfidf.BASELINE_SETTINGS)
    return terms.select("term", "df", F.round("idf", 9).alias("idf"))


def vocabulary_index(spark: SparkSession, folder: str) -> DataFrame:
    return tfidf.fit_vocabulary(_docs(spark, folder)).table.select("term", "idx", "df")


def tfidf_matrix(spark: SparkSession, folder: str) -> DataFrame:
    docs = _docs(spark, folder)
    rows = tfidf.tfidf(docs, tfidf.fit_vocabulary(docs))
    return rows.select("doc_id", "term", "idx", F.round("value", 6).alias("value"))


def formula_model(spark: SparkSession, folder: str, thresholds: dict[str, float]) -> model.TextModel:
    """Vocabulary of the documents with weights given by a formula, so that SQL can repeat them."""
    vocabulary = tfidf.fit_vocabulary(_docs(spark, folder))
    weights = F.array(*[
        (F.pmod(F.col("idx") * (7 + i), F.lit(13)) - 6).cast("double") * 0.5 for i in range(len(MODEL_LABELS))])
    return model.TextModel(
        vocabulary.settings, MODEL_LABELS, dict(thresholds), MODEL_INTERCEPTS,
        vocabulary.table.withColumn("coef", weights), vocabulary.terms)


def score_model(spark: SparkSession, folder: str) -> DataFrame:
    fitted = formula_model(spark, folder, MODEL_THRESHOLDS)
    scored = model.predict(_docs(spark, folder), fitted)
    rows = F.arrays_zip(F.array(*[F.lit(name) for name in MODEL_LABELS]).alias("label"), F.col("probs").alias("prob"),
                        F.col("preds").alias("pred"))
    return scored.select("doc_id", F.inline(rows)).withColumn("prob", F.round("prob", 6))


def prediction_text(spark: SparkSession, folder: str) -> DataFrame:
    docs = _docs(spark, folder)
    scored = model.predict(docs, formula_model(spark, folder, MODEL_THRESHOLDS))
    shown = model.prediction_text(F.col("text"), MODEL_LABELS)
    return docs.join(scored, "doc_id").select("doc_id", F.md5(shown).alias("report_md5"))


def triggered(spark: SparkSession, folder: str) -> DataFrame:
    scored = model.predict(_docs(spark, folder), formula_model(spark, folder, MODEL_THRESHOLDS))
    return scored.select("doc_id", F.array_join("active_labels", "|").alias("active"),
                         F.explode_outer("triggered").alias("label", "prob")).withColumn("prob", F.round("prob", 6))


def artifact_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "bundle")
    artifacts.export_json(formula_model(spark, folder, MODEL_THRESHOLDS), path, shard=2000)
    loaded = artifacts.load_json(spark, path)
    scored = model.score_texts(_docs(spark, folder), loaded)
    return model.probability_rows(scored, loaded.labels).withColumn("prob", F.round("prob", 6))


def evaluation_wide(spark: SparkSession, folder: str) -> DataFrame:
    """Truth with two deterministic scores: one with many ties, one with few."""
    rows = truth_frame(spark, folder)
    tied = (F.col("n_chars") * 37 % 101) / F.lit(100.0)
    fine = (F.col("n_chars") * 7919 % 10007 + F.col("quality") * 2000) / F.lit(12007.0)
    return rows.select(F.col("doc_id").alias("row_id"), F.array("toxic", "quality").alias("y"),
                       F.array(F.least(tied, F.lit(1.0)), fine).alias("probs"))


def evaluation_rows(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.long_rows(evaluation_wide(spark, folder), ["toxic", "quality"])


def confusion(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.confusion(evaluation_rows(spark, folder), EVAL_THRESHOLDS)


def prf(spark: SparkSession, folder: str) -> DataFrame:
    rows = metrics.precision_recall_f1(confusion(spark, folder))
    return rows.select("label", *[F.round(name, 9).alias(name) for name in ("precision", "recall", "f1")])


def micro_macro(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.micro_macro(confusion(spark, folder)).select(
        F.round("micro_f1", 9).alias("micro_f1"), F.round("macro_f1", 9).alias("macro_f1"))


def subset_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    preds = model.apply_thresholds(F.col("probs"), EVAL_THRESHOLDS, ["toxic", "quality"])
    shares = metrics.subset_accuracy(evaluation_wide(spark, folder).withColumn("preds", preds))
    return shares.select(*[F.round(name, 9).alias(name) for name in shares.columns])


def average_precision(spark: SparkSession, folder: str) -> DataFrame:
    rows = metrics.average_precision(metrics.cumulative(evaluation_rows(spark, folder)))
    return rows.withColumn("average_precision", F.round("average_precision", 9))


def roc_auc(spark: SparkSession, folder: str) -> DataFrame:
    rows = metrics.roc_auc(metrics.cumulative(evaluation_rows(spark, folder)))
    return rows.withColumn("roc_auc", F.round("roc_auc", 9))


def pr_curve(spark: SparkSession, folder: str) -> DataFrame:
    rows = metrics.pr_curve(metrics.cumulative(evaluation_rows(spark, folder)))
    return rows.select("label", *[F.round(name, 9).alias(name) for name in ("threshold", "precision", "recall")])


def calibrate(spark: SparkSession, folder: str) -> DataFrame:
    rows = metrics.calibrate_thresholds(evaluation_rows(spark, folder))
    return rows.select("label", F.round("threshold", 9).alias("threshold"), F.round("f1", 9).alias("f1"))


def evaluate(spark: SparkSession, folder: str) -> DataFrame:
    rows = metrics.evaluate(evaluation_rows(spark, folder), EVAL_THRESHOLDS)
    return rows.select("label", *[F.round(name, 9).alias(name) for name in rows.columns if name != "label"])


def sentence_split(spark: SparkSession, folder: str) -> DataFrame:
    turns = _turns(spark, folder)
    return mask.text_segments(turns, "turn_id").select("turn_id", F.col("pos").cast("long").alias("pos"), "segment_text")


def _turns(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "conversations").select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("turn_id"), "text")


def mask_sentences(spark: SparkSession, folder: str) -> DataFrame:
    scorer = mask.model_scorer(formula_model(spark, folder, MASK_THRESHOLDS))
    return mask.mask_texts(_turns(spark, folder), scorer, "turn_id").select("turn_id", "masked")


def page_nodes(spark: SparkSession, folder: str) -> DataFrame:
    return mask.page_nodes(table(spark, folder, "pages")).select(
        "page_id", F.col("node").cast("long").alias("node"), "text")


def mask_pages(spark: SparkSession, folder: str) -> DataFrame:
    scorer = mask.model_scorer(formula_model(spark, folder, MASK_THRESHOLDS))
    return mask.mask_pages(table(spark, folder, "pages"), scorer).select("page_id", "masked")


def _stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table as a stream, whether it is one file or a folder of files."""
    # a stream takes a file by a pattern only; the pattern matches this one name
    return scan.read_files(spark, f"{folder}/{name}.parque[t]", table(spark, folder, name).schema)


def stream_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    output, state = scratch_path(spark, "deduped"), scratch_path(spark, "state")
    seen_once = scan.once(_stream(spark, folder, "events"), ["user_id", "event_type"])
    scan.start(seen_once.select("user_id", "event_type"), lambda batch: batch, output, state,
               available_now=True).awaitTermination()
    return scan.results(spark, output)


def stream_label(spark: SparkSession, folder: str) -> DataFrame:
    output, state = scratch_path(spark, "labeled"), scratch_path(spark, "state")
    texts = _stream(spark, folder, "documents").select("doc_id", F.col("text").alias("body"))
    rows = scan.label_stream(texts, PATTERNS, negators=QUERY_NEGATORS).select("doc_id", "toxic_score", "labels")
    scan.start(rows, lambda batch: batch, output, state, available_now=True).awaitTermination()
    return scan.results(spark, output)


def stream_score(spark: SparkSession, folder: str) -> DataFrame:
    output, state = scratch_path(spark, "scored"), scratch_path(spark, "state")
    texts = _stream(spark, folder, "documents").select("doc_id", "text")
    scan.score_stream(texts, lambda: formula_model(spark, folder, MODEL_THRESHOLDS), output, state,
                      available_now=True).awaitTermination()
    scored = scan.results(spark, output).select("doc_id", "probs")
    return model.probability_rows(scored, MODEL_LABELS).withColumn("prob", F.round("prob", 6))


def stream_mask(spark: SparkSession, folder: str) -> DataFrame:
    output, state = scratch_path(spark, "masked"), scratch_path(spark, "state")
    scan.mask_stream(
        _stream(spark, folder, "pages"), lambda: mask.model_scorer(formula_model(spark, folder, MASK_THRESHOLDS)),
        output, state, available_now=True).awaitTermination()
    return scan.results(spark, output).select("page_id", "masked")


def train_model(spark: SparkSession, folder: str) -> DataFrame:
    """Split, fit, calibrate and score the test part (no SQL twin: the fit is iterative)."""
    rows = truth_frame(spark, folder).select(
        F.col("doc_id").cast("string").alias("comment_id"), F.col("post_id").cast("string").alias("post_id"),
        F.col("text").alias("body"), "toxic", F.col("quality").alias("insult"))
    trained = train(rows, ["toxic", "insult"], max_iter=100)
    return trained.test_scores.select("row_id", F.inline(F.arrays_zip("y", "probs", "preds")))


def fit_optimum(spark: SparkSession, folder: str) -> DataFrame:
    """What a fit on all documents with truth learned from, and whether it reached the optimum."""
    rows = truth_frame(spark, folder).select("doc_id", clean_text(F.col("text")).alias("body_clean"), "toxic", "quality")
    rows = materialise(rows, "fit-rows")
    fitted = model.fit_model(rows, ["toxic", "quality"], doc="doc_id", max_iter=200)
    found = model.largest_gradients(rows, fitted, "doc_id", "body_clean")
    return found.select("label", "rows", "positives", (F.col("gradient") < 1e-3).alias("optimal"))


# Columns of the comment files that merge_files writes and reads, by community.
FILE_COLUMNS = {"alpha": ["comment_id", "body"], "beta": ["body", "score", "comment_id"], "gamma": ["comment_id", "lang", "body"]}


def comment_files(spark: SparkSession, folder: str) -> str:
    """The documents as CSV files of three communities with different headers; returns their root."""
    root = scratch_path(spark, "raw")
    docs = table(spark, folder, "documents").select(
        "doc_id", F.col("doc_id").cast("string").alias("comment_id"), F.col("text").alias("body"),
        F.col("n_chars").cast("string").alias("score"), "lang")
    for number, (community, columns) in enumerate(FILE_COLUMNS.items()):
        own = docs.filter(F.col("doc_id") % len(FILE_COLUMNS) == number)
        comments.write_csv(own.orderBy("doc_id").select(*columns), f"{root}/{community}/deep")
    return root


def merge_files(spark: SparkSession, folder: str) -> DataFrame:
    merged = comments.merge_comments(spark, comment_files(spark, folder), position=True, name="part-*.csv")
    at = comments.POSITION
    numbered = number_rows(merged, [F.col(f"{at}.file"), F.col(f"{at}.block"), F.col(f"{at}.row")])
    return numbered.select("source_subreddit", "comment_id", "body", "score", "lang", "position")


def merge_counts(spark: SparkSession, folder: str) -> DataFrame:
    root = comment_files(spark, folder)
    merged = comments.merge_comments(spark, root, position=True, name="part-*.csv")
    listed = comments.file_table(spark, root, "part-*.csv").agg(F.count(F.lit(1)).alias("listed"))
    return comments.merge_counts(merged).crossJoin(listed).select("rows", (F.col("files") == F.col("listed")).alias("all_files"))


def pattern_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of pattern files made from the documents: label, place and text of each line."""
    word = F.regexp_extract("text", "[A-Za-z]{3,}", 0)
    docs = table(spark, folder, "documents").select("doc_id", F.when(word == "", F.lit("none")).otherwise(word).alias("word"))
    word, tab = F.col("word"), F.lit("\t")
    lines = [F.concat(F.lit("# "), word), F.lit("  "), F.concat(word, tab, F.lit("0.5")),
             F.concat(word, F.lit("\\t1.25")), word, F.concat(word, tab), F.concat(word, tab, F.lit("heavy")),
             F.concat(F.lit("("), word), F.concat(F.lit(" \\b"), word, F.lit("\\b\t2 ")), F.concat(word, F.lit("|x"), word)]
    return docs.select(
        F.element_at(F.array(*map(F.lit, LABELS)), (F.col("doc_id") % len(LABELS) + 1).cast("int")).alias("label"), "doc_id",
        F.element_at(F.array(*lines), (F.floor(F.col("doc_id") / len(LABELS)) % len(lines) + 1).cast("int")).alias("value"))


def pattern_files(spark: SparkSession, folder: str) -> DataFrame:
    """Pattern files of all labels, and of three labels once more as an extra folder, written and read with their faults."""
    lines = materialise(pattern_lines(spark, folder), "pattern-lines")
    base, extra = scratch_path(spark, "patterns"), scratch_path(spark, "patterns")
    for path, rows in ((base, lines), (extra, lines.filter(F.col("label").isin(LABELS[:3])))):
        (rows.repartition("label").sortWithinPartitions("label", "doc_id").select("label", "value")
         .write.partitionBy("label").text(path))
    read = patterns.pattern_files(spark, base, extra, name="part-*", label="label=([^/]+)/[^/]+$")
    kind = F.coalesce(F.substring_index("problem", ":", 1), F.lit(""))
    return read.select("origin", "label", F.col("line").cast("long").alias("line"), "pattern", "weight",
                       kind.alias("problem"), "number")


def word_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of neighbouring words of the conversations as patterns, numbered."""
    parts = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+"), F.lit(0))
    turns = table(spark, folder, "conversations").select(parts.alias("p"))
    zipped = F.arrays_zip(F.col("p"), F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0))).alias("q"),
                          F.slice("p", 3, F.greatest(F.size("p") - 2, F.lit(0))).alias("r"))
    triples = turns.select(F.inline(zipped)).filter(
        F.col("p").rlike("^[a-z]{4,}$") & (F.col("q") == " ") & F.col("r").rlike("^[a-z]{4,}$") & (F.col("p") != F.col("r")))
    pairs = triples.select(F.concat_ws(" ", "p", "r").alias("pair")).distinct()
    return number_rows(pairs, [F.col("pair")], "number").select(
        "number", "pair", F.concat(F.lit("\\b"), "pair", F.lit("\\b")).alias("pattern"))


def pattern_hits(spark: SparkSession, folder: str) -> DataFrame:
    """All documents by all word pairs of the conversations, tens of thousands of regexes."""
    pairs = materialise(word_pairs(spark, folder), "pairs")
    found = hits.pattern_hits(_docs(spark, folder), pairs, "doc_id", "text")
    return found.join(pairs, "number").select("doc_id", "pair", F.size("matches").cast("long").alias("matches"))


def clean_sorted(spark: SparkSession, folder: str) -> DataFrame:
    kept = clean.clean_comments(scored_comments(spark, folder), position=F.col("doc_id"))
    return number_rows(kept, clean.output_order(kept.columns)).select("comment_id", "toxic_score", "created_utc", "position")


def label_order(spark: SparkSession, folder: str) -> DataFrame:
    shares = stats.label_distribution(prepared(spark, folder), LABELS)
    return number_rows(shares, [F.desc("positives"), F.col("label")]).select("label", "positives", "position")


def preview_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The first rows of the training frame in input order."""
    rows = number_rows(prepared(spark, folder).select("comment_id", "subreddit", "toxic"), [F.col("comment_id").cast("long")])
    return prepare.preview(rows.orderBy("position"), 3)


def dirty_comments(spark: SparkSession, folder: str) -> DataFrame:
    """Documents among blank, deleted and URL bodies, repeated ids, and one id that a third of the rows share."""
    docs = table(spark, folder, "documents").select("doc_id", F.col("doc_id").cast("string").alias("name"), "text")
    odd = F.element_at(F.array(*map(F.lit, ["", "[deleted]", "[removed]", "http://x.org/ a", " \n\t ", "HTTP://X.ORG a",
                                            "  https://y.org", "[deleted] "])), (F.col("doc_id") % 8 + 1).cast("int"))
    rows = [(F.col("name"), F.col("text"), 0), (F.col("name"), F.concat(F.lit("again "), "text"), 1),
            (F.concat(F.lit("v"), "name"), odd, 2), (F.lit("hot"), F.col("text"), 3),
            (F.concat(F.lit("v"), "name"), F.concat(F.lit("late "), "text"), 4)]
    made = F.array(*[F.struct(name.alias("comment_id"), body.alias("body"), (F.col("doc_id") * 5 + at).alias("at"))
                     for name, body, at in rows])
    return docs.select(F.inline(made))


def prepare_dirty(spark: SparkSession, folder: str) -> DataFrame:
    frame = prepare.prepare_frame(dirty_comments(spark, folder), position=F.col("at"))
    return frame.select("comment_id", "at", F.md5("body_clean").alias("body_md5"))


def clean_dirty(spark: SparkSession, folder: str) -> DataFrame:
    return clean.clean_comments(dirty_comments(spark, folder), keep_first=True, position=F.col("at")).select("comment_id", "at")


def label_dirty(spark: SparkSession, folder: str) -> DataFrame:
    """Rule labels where half of the bodies begin with a link, in either case and after blanks."""
    begin = F.element_at(F.array(*map(F.lit, ["http://a.org ", " \n HTTPS://b.org ", "", "xhttp "])), (F.col("doc_id") % 4 + 1).cast("int"))
    bodies = table(spark, folder, "documents").select("doc_id", F.concat(begin, "text").alias("body"))
    return label.label_comments(bodies, PATTERNS, negators=QUERY_NEGATORS).select("doc_id", "toxic_score", "insult_score", "labels")


def write_inplace(spark: SparkSession, folder: str) -> DataFrame:
    """A comment file cleaned over itself; a writer that fails afterwards changes nothing."""
    path = scratch_path(spark, "comments.csv")
    docs = table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("comment_id"), F.col("text").alias("body"))
    comments.write_csv(docs, path)
    rows = comments.read_csv(spark, path)
    kept = clean.clean_comments(rows, keep_first=True, position=F.col("comment_id").cast("long"))
    comments.write_output(kept, path, "_cleaned", inplace=True)
    failing = comments.read_csv(spark, path).withColumn("body", F.raise_error(F.concat(F.lit("stopped at "), "comment_id")).cast("string"))
    try:
        comments.write_output(failing, path, "_cleaned", inplace=True)
    except PySparkException:
        return comments.read_csv(spark, path)
    raise AssertionError("a failing writer has committed")


def model_saved(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of a model that was saved over another one and loaded again."""
    path = scratch_path(spark, "model")
    fitted = formula_model(spark, folder, MODEL_THRESHOLDS)
    artifacts.save_model(formula_model(spark, folder, EVAL_THRESHOLDS), path)
    artifacts.save_model(fitted, path)
    scored = model.predict(_docs(spark, folder), artifacts.load_model(spark, path))
    rows = F.arrays_zip(F.array(*[F.lit(name) for name in MODEL_LABELS]).alias("label"), F.col("probs").alias("prob"),
                        F.col("preds").alias("pred"))
    return scored.select("doc_id", F.inline(rows)).withColumn("prob", F.round("prob", 6))


def tolerant_read(spark: SparkSession, folder: str) -> DataFrame:
    """Comment files of which some have records with a cell too many, some lack the body, and one cannot be read at all."""
    root = scratch_path(spark, "raw")
    docs = table(spark, folder, "documents").select("doc_id", F.col("doc_id").cast("string").alias("comment_id"), F.col("text").alias("body"))
    comments.write_csv(docs.filter("doc_id % 3 = 0").select("comment_id", "body"), f"{root}/good")
    digest = F.md5("body")
    extra = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(","), digest)).otherwise(F.lit(""))
    lines = docs.filter("doc_id % 3 = 1").select(F.concat("comment_id", F.lit(","), digest, extra).alias("value"))
    # a text file has no header of its own, so each one is given the first line
    with_header = lines.repartition(2).mapInPandas(_headed, "value string")
    with_header.write.option("compression", "none").text(f"{root}/records")
    comments.write_csv(docs.filter("doc_id % 3 = 2").select("comment_id", digest.alias("title")).coalesce(2), f"{root}/bodiless")
    ids = scratch_path(spark, "ids")
    docs.select("comment_id").coalesce(1).write.text(ids)
    publish(spark, ids, f"{root}/broken/part-0.csv.gz")
    rows, failures = comments.read_tolerant(spark, root, name="part-*")
    good = rows.select("source_subreddit", "comment_id", F.md5("body").alias("body_md5"), F.lit("").alias("problem"))
    place = F.regexp_extract("path", "/([a-z]+)/[^/]+$", 1)
    bad = failures.select(place.alias("source_subreddit"), F.substring_index("record", ",", 1).alias("comment_id"),
                          F.lit("").alias("body_md5"), "problem").distinct()
    return good.unionByName(bad)


def _headed(frames):
    first = True
    for frame in frames:
        yield type(frame)({"value": (["comment_id,body"] if first else []) + frame["value"].tolist()})
        first = False


def stream_burst(spark: SparkSession, folder: str) -> DataFrame:
    """Last event of every user and burst that has ended, a burst being events at most half an hour apart."""
    output, state = scratch_path(spark, "bursts"), scratch_path(spark, "state")
    events = _stream(spark, folder, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    ended = scan.bursts(events, ["user_id"], "ts", "30 minutes", "1 hour")
    rows = ended.select("user_id", F.col("row.event_id").alias("last_event"), "versions")
    scan.start(rows, lambda batch: batch, output, state, available_now=True).awaitTermination()
    return scan.results(spark, output)


def stream_once_bounded(spark: SparkSession, folder: str) -> DataFrame:
    """Every event once, from a stream that is restarted and given all earlier events again, in state that does not grow."""
    arriving, output, state = (scratch_path(spark, name) for name in ("arriving", "deduped", "state"))
    events = table(spark, folder, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    early = F.col("ts") < F.lit("2024-01-15").cast("timestamp")

    def run() -> None:
        stream = scan.read_files(spark, arriving, events.schema)
        once = scan.once(stream, ["event_id"], "ts", "1 hour").select("event_id")
        scan.start(once, lambda batch: batch, output, state, available_now=True).awaitTermination()

    events.filter(early).unionByName(events.filter(early)).write.parquet(arriving)
    run()
    events.unionByName(events.filter(~early)).write.mode("append").parquet(arriving)
    run()
    kept = scan.state_rows(spark, state).agg(F.count(F.lit(1)).alias("kept"))
    latest = events.agg(F.max("ts").alias("latest"))
    recent = events.join(latest, F.col("ts") >= F.col("latest") - F.expr("interval 2 hours")).agg(F.count(F.lit(1)).alias("recent"))
    bounded = kept.join(recent).select((F.col("kept") <= F.col("recent")).alias("state_bounded"))  # one row
    return scan.results(spark, output).join(F.broadcast(bounded))


QUERIES: dict[str, Query] = {
    "merge_union": merge_union,
    "merge_files": merge_files,
    "merge_counts": merge_counts,
    "pattern_files": pattern_files,
    "pattern_hits": pattern_hits,
    "clean_sorted": clean_sorted,
    "label_order": label_order,
    "preview_rows": preview_rows,
    "prepare_dirty": prepare_dirty,
    "clean_dirty": clean_dirty,
    "label_dirty": label_dirty,
    "write_inplace": write_inplace,
    "model_saved": model_saved,
    "tolerant_read": tolerant_read,
    "stream_burst": stream_burst,
    "stream_once_bounded": stream_once_bounded,
    "csv_roundtrip": csv_roundtrip,
    "normalised": normalised,
    "clean_best": clean_best,
    "clean_first": clean_first,
    "clean_counts": clean_counts,
    "observed_counts": observed_counts,
    "label_rules": label_rules,
    "label_counts": label_counts,
    "label_overall": label_overall,
    "label_by_source": label_by_source,
    "label_source_detail": label_source_detail,
    "label_then_clean": label_then_clean,
    "label_scores": label_scores,
    "source_report": source_report,
    "overall_report": overall_report,
    "summary_report": summary_report,
    "label_report": label_report,
    "source_label_report": source_label_report,
    "clean_report": clean_report,
    "dataset_summary": dataset_summary,
    "label_distribution": label_distribution,
    "length_histogram": length_histogram,
    "prepare_frame": prepare_frame,
    "blank_counts": blank_counts,
    "thread_labels": thread_labels,
    "thread_split": thread_split,
    "tokens": tokens,
    "ngrams": ngram_lists,
    "doc_freq": doc_freq,
    "vocabulary_index": vocabulary_index,
    "tfidf": tfidf_matrix,
    "score_model": score_model,
    "prediction_text": prediction_text,
    "triggered": triggered,
    "artifact_roundtrip": artifact_roundtrip,
    "confusion": confusion,
    "prf": prf,
    "micro_macro": micro_macro,
    "subset_accuracy": subset_accuracy,
    "average_precision": average_precision,
    "roc_auc": roc_auc,
    "pr_curve": pr_curve,
    "calibrate": calibrate,
    "evaluate": evaluate,
    "sentence_split": sentence_split,
    "mask_sentences": mask_sentences,
    "page_nodes": page_nodes,
    "mask_pages": mask_pages,
    "stream_dedupe": stream_dedupe,
    "stream_label": stream_label,
    "stream_score": stream_score,
    "stream_mask": stream_mask,
    "train_model": train_model,
    "fit_optimum": fit_optimum,
}
