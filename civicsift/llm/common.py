"""Helpers shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def named(df: DataFrame, name: str) -> Column:
    """Column ``name`` of ``df``, whatever characters the name holds."""
    return df["`" + name.replace("`", "``") + "`"]


def whole_row(df: DataFrame) -> Column:
    """All columns of ``df`` as one struct, so that columns an operator adds cannot clash with them."""
    return F.struct(*[named(df, name) for name in df.columns])


def unpacked(df: DataFrame, columns: list[str], row: str = "row") -> list[Column]:
    """The fields of struct ``row`` as top-level columns again."""
    return [F.col(row).getField(name).alias(name) for name in columns]


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Let Spark send texts to Python in batches of about ``BATCH_BYTES``, however long they are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
