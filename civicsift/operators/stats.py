"""Counts, ratios and length profiles."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicsift.constants import LABELS
from civicsift.functions.text import token_count
from civicsift.session import materialise


def label_counts(labeled: DataFrame, labels: Sequence[str] = tuple(LABELS), suffix: str = "_bin") -> DataFrame:
    """``(label, positives)``; all labels are summed in one pass."""
    sums = labeled.agg(*[
        F.coalesce(F.sum(F.col(f"{label}{suffix}").cast("long")), F.lit(0)).alias(label) for label in labels
    ])
    return sums.unpivot([], list(labels), "label", "positives")


def overall_toxicity(labeled: DataFrame) -> DataFrame:
    """Toxic and other rows with percentages; no rows count as 0 percent toxic."""
    totals = labeled.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.coalesce(F.sum(F.col("toxic_bin").cast("long")), F.lit(0)).alias("toxic_rows"),
    )
    percent = _percent(F.col("toxic_rows"), F.col("total_rows"))
    return totals.select(
        "total_rows", "toxic_rows",
        (F.col("total_rows") - F.col("toxic_rows")).alias("clean_rows"),
        percent.alias("toxic_percent"),
        (F.lit(100.0) - percent).alias("clean_percent"),
    )


def source_toxicity(labeled: DataFrame, source: str = "source_subreddit") -> DataFrame | None:
    """Size, toxic rows and percentage per community, by name; None without that column."""
    if source not in labeled.columns:
        return None
    groups = labeled.groupBy(source).agg(
        F.count(F.lit(1)).alias("size"),
        F.sum(F.col("toxic_bin").cast("long")).alias("toxic_rows"),
    )
    return groups.select(
        source, "size", "toxic_rows",
        (F.col("size") - F.col("toxic_rows")).alias("clean_rows"),
        _percent(F.col("toxic_rows"), F.col("size")).alias("toxic_percent"),
    ).orderBy(source)


def source_labels(labeled: DataFrame, source: str = "source_subreddit",
                  labels: Sequence[str] = tuple(LABELS)) -> DataFrame | None:
    """``(community, label, positives)`` of the labels below ``toxic``, without zero counts."""
    if source not in labeled.columns:
        return None
    own = [label for label in labels if label != "toxic"]
    sums = labeled.groupBy(source).agg(*[F.sum(F.col(f"{label}_bin").cast("long")).alias(label) for label in own])
    return sums.unpivot([source], own, "label", "positives").filter(F.col("positives") > 0)


def dataset_summary(prepared: DataFrame, text: str = "body_clean", community: str = "subreddit") -> DataFrame:
    """Rows, communities, mean and exact median of characters and tokens, two decimals.

    Rows are first counted per distinct combination of community and lengths, so the medians
    are taken over weighted lengths and never over one row per comment.
    """
    shapes = prepared.select(
        F.col(community).alias("community"),
        F.char_length(text).alias("chars"),
        token_count(F.col(text)).alias("tokens"),
    ).groupBy("community", "chars", "tokens").agg(F.count(F.lit(1)).alias("n"))
    return shapes.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("comments"),
        F.count_distinct("community").alias("communities"),
        *[stat for name in ("chars", "tokens") for stat in (
            F.bround(F.sum(F.col(name) * F.col("n")) / F.sum("n"), 2).alias(f"mean_{name}"),
            F.bround(F.percentile(name, 0.5, F.col("n")), 2).alias(f"median_{name}"),
        )],
    )


def label_distribution(frame: DataFrame, labels: Sequence[str] = tuple(LABELS)) -> DataFrame:
    """Positives and percentage per label, most frequent first."""
    totals = frame.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.coalesce(F.sum(F.col(label).cast("long")), F.lit(0)).alias(label) for label in labels],
    )
    rows = totals.unpivot(["n"], list(labels), "label", "positives")
    percent = F.bround(F.when(F.col("n") > 0, F.col("positives") / F.col("n") * 100), 2)
    return rows.select("label", "positives", percent.alias("percent")).orderBy(F.desc("positives"), "label")


def length_histogram(prepared: DataFrame, text: str = "body_clean", bins: int = 60) -> DataFrame:
    """Token counts in ``bins`` equal steps from the smallest to the largest, last bin closed.

    Bin borders are the doubles numpy computes, so a length on a border falls on the same side.
    """
    lengths = prepared.select(token_count(F.col(text)).alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    # read twice, for the borders and for the counts
    lengths = materialise(lengths, "lengths")
    span = lengths.agg(F.min("x").alias("low"), F.max("x").alias("high")).first()
    if span["low"] is None:
        return lengths.select(F.lit(0).alias("bin"), F.lit(0.0).alias("left"), F.lit(0.0).alias("right"),
                              F.lit(0).cast("long").alias("comments")).limit(0)
    edges = np.histogram_bin_edges([span["low"], span["high"]], bins).tolist()
    border = F.array(*[F.lit(edge) for edge in edges])
    place = F.least(F.size(F.filter(border, lambda edge: edge <= F.col("x"))), F.lit(bins)) - 1
    counts = lengths.groupBy(place.alias("bin")).agg(F.sum("n").alias("comments"))
    frame = prepared.sparkSession.createDataFrame(
        [(i, edges[i], edges[i + 1]) for i in range(bins)], "bin int, left double, right double")
    return frame.join(F.broadcast(counts), "bin", "left").select(
        "bin", "left", "right", F.coalesce("comments", F.lit(0)).alias("comments"))


def percent_text(value: Column) -> Column:
    return F.format_string("%.2f%%", value)


def thousands(value: Column) -> Column:
    return F.format_number(value, 0)


def _percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole * 100).otherwise(F.lit(0.0))
