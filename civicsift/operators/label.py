"""Rule labels: seven scores, seven flags and the joined label string per comment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicsift.constants import FLAG_THRESHOLD, LABELS, NEGATION_WINDOW, NEGATORS
from civicsift.functions.rules import PatternSpec, finds_any, kept_matches, matching_patterns, severities
from civicsift.functions.text import settled, strip
from civicsift.operators.checks import require_columns


def label_comments(
    comments: DataFrame,
    patterns: Sequence[PatternSpec],
    threshold: float = FLAG_THRESHOLD,
    negators: Sequence[str] = tuple(NEGATORS),
    window: int = NEGATION_WINDOW,
    body: str = "body",
) -> DataFrame:
    """Add ``<label>_score``, ``<label>_bin`` and ``labels``.

    Row-local and free of shuffles, so it serves batch and streaming frames alike. Rows in
    which no pattern occurs pay for one scan of the text only.
    """
    require_columns(comments, [body])
    unknown = {spec.label for spec in patterns} - set(LABELS)
    if unknown:
        raise ValueError(f"patterns for unknown labels: {sorted(unknown)}")
    stripped = comments.withColumn("_text", strip(F.coalesce(F.col(body), F.lit(""))))
    text = F.col("_text")
    scored = (text != "") & ~F.lower(F.substring(text, 1, 4)).startswith("http")
    candidates = stripped.withColumn("_candidate", scored & finds_any(text, patterns))
    found = candidates.withColumns({
        "_found": F.when(F.col("_candidate"), matching_patterns(text, patterns, LABELS)),
        "_lower": F.when(F.col("_candidate"), F.lower(text)),
    })
    hits = found.withColumn("_hits", _count_hits(F.col("_lower"), F.col("_found"), negators, window))
    raw = hits.withColumn("_raw", settled(F.when(F.size("_hits") > 0, severities(F.col("_hits"), LABELS))))
    columns = {}
    for i, label in enumerate(LABELS):
        score = F.col("_raw")[i] if label != "toxic" else F.array_max("_raw")
        score = F.coalesce(score, F.lit(0.0))
        # flags look at the exact score, the stored score is rounded half-even
        columns[f"{label}_score"] = F.bround(score, 4)
        columns[f"{label}_bin"] = (score >= F.lit(threshold)).cast("int")
    flagged = raw.withColumns(columns).drop("_text", "_candidate", "_found", "_lower", "_hits", "_raw")
    return flagged.withColumn("labels", active_labels())


def active_labels(labels: Sequence[str] = tuple(LABELS), suffix: str = "_bin") -> Column:
    """Labels whose flag is set, in label order, joined by a bar."""
    return F.concat_ws("|", *[F.when(F.col(f"{label}{suffix}") == 1, F.lit(label)) for label in labels])


def score_map(labels: Sequence[str] = tuple(LABELS)) -> Column:
    """All scores of a labelled row as a map from label to score."""
    return F.map_from_arrays(
        F.array(*[F.lit(label) for label in labels]), F.array(*[F.col(f"{label}_score") for label in labels]))


def _count_hits(lowered: Column, found: Column, negators: Sequence[str], window: int) -> Column:
    return F.transform(
        found,
        lambda row: F.struct(
            row["label"].alias("label"),
            row["weight"].alias("weight"),
            kept_matches(lowered, row["matches"], row["gaps"], negators, window).alias("kept"),
        ),
    )

