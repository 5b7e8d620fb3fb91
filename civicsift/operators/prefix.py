"""Running totals and lookups that stay spread out when one key holds most rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A key is hot when it holds more than one row in this many; there are at most so many of them.
HOT_SHARE = 1000
SALTS = 256


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    bucket: Column,
    order: Sequence[Column],
    sums: Sequence[str],
) -> DataFrame:
    """Add ``<name>_before``: the total of ``name`` over earlier rows of the same ``keys``.

    ``bucket`` is an ascending coarse form of ``order`` with a bounded number of values. One
    window task then holds one bucket of a key instead of the whole key; the totals of the
    earlier buckets are added from a small table. ``keys`` and ``bucket`` must not be null.
    """
    placed = df.withColumn("_bucket", bucket)
    totals = placed.groupBy(*keys, "_bucket").agg(*[F.sum(name).alias(f"_total_{name}") for name in sums])
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "_bucket",
        *[F.coalesce(F.sum(f"_total_{name}").over(earlier), F.lit(0)).alias(f"_offset_{name}") for name in sums],
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = placed.withColumns({
        f"_local_{name}": F.coalesce(F.sum(name).over(inside), F.lit(0)) for name in sums
    })
    # the window has placed the rows by the join columns already, so only the totals move
    joined = local.join(offsets, [*keys, "_bucket"])
    return joined.select(
        *df.columns,
        *[(F.col(f"_offset_{name}") + F.col(f"_local_{name}")).alias(f"{name}_before") for name in sums],
    )


def spread_lookup(
    rows: DataFrame,
    table: DataFrame,
    key: str,
    weight: str,
    total: int,
    how: str = "left",
    spread_on: Sequence[str] | None = None,
    strategy: str | None = None,
) -> DataFrame:
    """Join ``table`` (unique ``key``) to ``rows`` although a key may hold a third of them.

    ``weight`` is the number of ``rows`` per key, ``total`` their sum. The few hot keys are
    joined from a broadcast of at most ``HOT_SHARE`` rows; their rows are spread over
    salts in the shuffled join for everything else, where they meet no partner. The salt is
    a hash of ``spread_on`` (all columns if not given), so a lost task is redone alike.
    The salt of ``table`` is 0 in every row but no literal: the optimizer would take a literal
    out of the join keys, and the rows of a hot key would be placed by their key alone.
    Frequent keys that ``table`` does not know are left to adaptive skew handling. ``strategy`` is a join hint for
    the shuffled join, as ``shuffle_hash`` where a task's part of ``table`` is small and sorting the rows would cost most.
    """
    values = [name for name in table.columns if name not in (key, weight)]
    limit = max(total // HOT_SHARE, 1)
    packed = table.select(key, weight, F.struct(*values).alias("_value"))
    hot = packed.filter(F.col(weight) > limit).select(F.col(key).alias("_hot_key"), F.col("_value").alias("_hot"))
    cold_salt = F.when(F.col(weight) > limit, F.lit(-1)).otherwise(F.lit(0))
    cold = packed.filter(F.col(weight) <= limit).select(
        F.col(key).alias("_cold_key"), cold_salt.alias("_cold_salt"), F.col("_value").alias("_cold"))
    cold = cold.hint(strategy) if strategy else cold
    marked = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left")
    spread = F.pmod(F.xxhash64(*(spread_on or rows.columns)), F.lit(SALTS)).cast("int") + 1
    salted = marked.withColumn("_salt", F.when(F.col("_hot_key").isNull() & F.col(key).isNotNull(), F.lit(0)).otherwise(spread))
    joined = salted.join(cold, (F.col(key) == F.col("_cold_key")) & (F.col("_salt") == F.col("_cold_salt")), "left")
    if how == "inner":
        joined = joined.filter(F.col("_hot_key").isNotNull() | F.col("_cold_key").isNotNull())
    value = F.when(F.col("_hot_key").isNotNull(), F.col("_hot")).otherwise(F.col("_cold"))
    out = joined.withColumn("_picked", value)
    return out.select(*[F.col(name) for name in rows.columns], *[F.col(f"_picked.{name}").alias(name) for name in values])
