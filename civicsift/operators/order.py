"""Positions of rows in a global order, without a task that holds all of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civicsift.session import materialise

_PLACES = (1 << 33) - 1  # Spark's row ids hold the partition above these bits and the place in it in them


def _comparable(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(_comparable(field.dataType) for field in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _comparable(kind.elementType)
    return not isinstance(kind, (T.MapType, T.VariantType))


def number_rows(df: DataFrame, order: Sequence[Column], name: str = "position", start: int = 1) -> DataFrame:
    """Add the place of every row in ``order``, which may mix keys, directions and places of nulls.

    Rows are placed by range, sorted inside their task and written once, which fixes the places; a row's number is its place
    plus the rows of the ranges before. Rows that tie are told apart by a hash of all their columns, and
    beyond that by where they lay, so that no single range must take all rows of a frequent key.
    """
    hashed = [F.col(f"`{field.name}`") for field in df.schema.fields if _comparable(field.dataType)]
    ties = [F.xxhash64(*hashed)] if hashed else []
    lying = df.withColumn("_lay", F.monotonically_increasing_id())
    ordered = lying.orderBy(*order, *ties, "_lay").select(*[F.col(f"`{column}`") for column in df.columns])
    return number_as_lying(ordered, name, start)


def number_as_lying(df: DataFrame, name: str, start: int = 1) -> DataFrame:
    """Add a number to every row, in the order they lie in. Rows are written once, which fixes their places."""
    placed = materialise(df.select(
        F.struct(*[F.col(f"`{column}`") for column in df.columns]).alias("_row"),
        F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit(_PLACES)).alias("_place")), "placed")
    sizes = sorted((row["_part"], row["count"]) for row in placed.groupBy("_part").count().collect())  # one row per range
    offsets, total = [], start
    for part, size in sizes:
        offsets.append((part, total))
        total += size
    starts = df.sparkSession.createDataFrame(offsets, "_part int, _start long")
    numbered = placed.join(F.broadcast(starts), "_part")
    return numbered.select("_row.*", (F.col("_start") + F.col("_place")).alias(name))
