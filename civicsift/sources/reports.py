"""Report tables and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicsift.operators.stats import percent_text, thousands
from civicsift.sources.comments import write_csv
from civicsift.sources.files import write_document

# fixed values: row titles of the summary table
SUMMARY_ROWS = [
    ("Total komentar", "comments"),
    ("Jumlah subreddit", "communities"),
    ("Rata-rata panjang (karakter)", "mean_chars"),
    ("Median panjang (karakter)", "median_chars"),
    ("Rata-rata panjang (token)", "mean_tokens"),
    ("Median panjang (token)", "median_tokens"),
]


def summary_table(summary: DataFrame) -> DataFrame:
    """The one-row summary as ``Metrik``/``Nilai`` rows, in report order."""
    shown = {name: F.col(name).cast("string") for _, name in SUMMARY_ROWS}
    shown["comments"] = thousands(F.col("comments"))
    rows = F.array(*[F.struct(F.lit(title).alias("Metrik"), shown[name].alias("Nilai"))
                     for title, name in SUMMARY_ROWS])
    return summary.select(F.inline(rows))


def label_table(distribution: DataFrame) -> DataFrame:
    return distribution.select(
        F.col("label").alias("Label"), F.col("positives").alias("Jumlah Positif"),
        F.col("percent").alias("Persentase (%)"))


def overall_lines(overall: DataFrame) -> DataFrame:
    """Totals of ``overall_toxicity`` as text lines."""
    toxic = F.format_string(
        "Overall toxic rows: %d/%d (%s)", "toxic_rows", "total_rows", percent_text(F.col("toxic_percent")))
    clean = F.format_string(
        "Overall non-toxic rows: %d/%d (%s)", "clean_rows", "total_rows", percent_text(F.col("clean_percent")))
    return overall.select(F.explode(F.array(toxic, clean)).alias("line"))


def source_lines(sources: DataFrame, source: str = "source_subreddit") -> DataFrame:
    """Communities of ``source_toxicity`` as text lines."""
    return sources.select(source, F.format_string(
        "r/%s: %d/%d toxic (%s), %d clean", source, "toxic_rows", "size", percent_text(F.col("toxic_percent")),
        "clean_rows").alias("line"))


def label_lines(counts: DataFrame, *keys: str) -> DataFrame:
    """``(label, positives)`` rows, of ``label_counts`` or per community of ``source_labels``, as text lines."""
    return counts.select(*keys, F.format_string("%-14s: %d", "label", "positives").alias("line"))


def clean_lines(counts: DataFrame) -> DataFrame:
    """The counters of ``clean_counts`` as text lines."""
    titles = {"Input rows": "input_rows", "Removed empty/url-only bodies": "removed_empty",
              "Removed duplicate bodies": "removed_duplicates", "Output rows": "output_rows"}
    lines = [F.format_string(f"{title}: %d", name) for title, name in titles.items()]
    return counts.select(F.explode(F.array(*lines)).alias("line"))


def merge_lines(counts: DataFrame) -> DataFrame:
    """The counters of ``merge_counts`` as a text line."""
    return counts.select(F.concat(
        F.lit("Merged "), F.col("files").cast("string"), F.lit(" files ("), thousands(F.col("rows")), F.lit(" rows)")
    ).alias("line"))


def write_table(table: DataFrame, path: str) -> None:
    write_csv(table.coalesce(1), path, mode="overwrite")


def write_text(spark: SparkSession, text: str, path: str) -> None:
    write_document(spark.createDataFrame([(text,)], "value string"), path)
