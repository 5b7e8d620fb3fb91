"""Dropping blank bodies and keeping one row per normalised body."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civicsift.functions.text import dedupe_key, is_number, keep_if
from civicsift.operators.checks import require_columns


class CleanObserver:
    """Counts rows while they are cleaned, in the very pass that writes them; see ``clean_comments``.

    An observer serves one action on the cleaned frame, after which ``counts`` can be asked for.
    """

    def __init__(self) -> None:
        self._read, self._filled, self._kept = (Observation() for _ in range(3))

    @staticmethod
    def _watch(frame: DataFrame, observation: Observation) -> DataFrame:
        return frame.observe(observation, F.count(F.lit(1)).alias("rows"))

    def counts(self) -> dict[str, int]:
        """Rows read, blank rows removed, duplicate rows removed, rows left."""
        read, filled, kept = (o.get["rows"] for o in (self._read, self._filled, self._kept))
        return {"input_rows": read, "removed_empty": read - filled, "removed_duplicates": filled - kept, "output_rows": kept}


def clean_comments(
    comments: DataFrame,
    keep_first: bool = False,
    position: Column | None = None,
    body: str = "body",
    observer: CleanObserver | None = None,
) -> DataFrame:
    """One row per distinct normalised body, blanks and URL-only bodies dropped.

    The kept row has the highest ``toxic_score`` (rows without a number last), then the
    latest ``created_utc``, then the largest ``comment_id``, then the earliest position;
    columns that do not exist take no part. ``keep_first`` looks at the position only.

    ``position`` is a number or a struct of numbers. ``observer`` counts the rows as they pass.

    The winner is an aggregate, not a window: each task first reduces its own copies, so a
    text that makes up a third of all rows reaches the shuffle as one row per task.
    """
    require_columns(comments, [body])
    if position is None:
        position = F.col("_position") if "_position" in comments.columns else F.monotonically_increasing_id()
    names = comments.columns
    if observer:
        comments = observer._watch(comments, observer._read)
    keyed = comments.withColumn("_at", position).withColumn(
        "_key", keep_if(dedupe_key(F.col(body)), lambda key: key != ""))
    if observer:
        keyed = observer._watch(keyed, observer._filled)
    at = _earliest_largest(keyed)
    rank = F.struct(*([] if keep_first else preference(comments.columns)), at.alias("at"))
    # the digest stands for the text, which then neither moves nor is sorted by
    rows = keyed.select(F.sha2("_key", 256).alias("_digest"), rank.alias("_rank"), F.struct(*names).alias("_row"))
    kept = rows.groupBy("_digest").agg(F.max_by("_row", "_rank").alias("_row"))
    if observer:
        kept = observer._watch(kept, observer._kept)
    return kept.select("_row.*")


def preference(columns: list[str]) -> list[Column]:
    """Sort fields whose largest value marks the preferred row; a missing number is smallest."""
    fields = [_number(F.col("toxic_score")).alias("score")] if "toxic_score" in columns else []
    return fields + [F.col(name) for name in ("created_utc", "comment_id") if name in columns]


def output_order(columns: list[str]) -> list[Column]:
    """Order of the cleaned output: score, time and id, each descending."""
    order = []
    if "toxic_score" in columns:
        order.append(_number(F.col("toxic_score")).desc_nulls_last())
    order += [F.col(name).desc() for name in ("created_utc", "comment_id") if name in columns]
    return order


def sort_cleaned(cleaned: DataFrame, keep_first: bool = False) -> DataFrame:
    """Cleaned rows in output order; under ``keep_first`` that is the input order (``_position``)."""
    if keep_first:
        return cleaned.orderBy("_position") if "_position" in cleaned.columns else cleaned
    order = output_order(cleaned.columns)
    return cleaned.orderBy(*order) if order else cleaned


def clean_counts(comments: DataFrame, body: str = "body") -> DataFrame:
    """Rows read, blank rows removed, duplicate rows removed, rows left."""
    require_columns(comments, [body])
    digests = comments.select(F.sha2(dedupe_key(F.col(body)), 256).alias("digest"))
    copies = digests.groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
    blank = F.col("digest") == F.sha2(F.lit(""), 256)
    return copies.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("input_rows"),
        F.coalesce(F.sum(F.when(blank, F.col("n"))), F.lit(0)).alias("removed_empty"),
        F.coalesce(F.sum(F.when(~blank, F.col("n") - 1)), F.lit(0)).alias("removed_duplicates"),
        F.count_if(~blank).alias("output_rows"),
    )


def _number(value: Column) -> Column:
    text = value.cast("string")
    return F.when(is_number(text), F.trim(text).try_cast("double"))


def _earliest_largest(keyed: DataFrame) -> Column:
    """Position turned round, so that the earliest row has the largest value."""
    kind = keyed.schema["_at"].dataType
    if isinstance(kind, T.StructType):
        return F.struct(*[(-F.col(f"_at.{name}")).alias(name) for name in kind.names])
    return -F.col("_at")
