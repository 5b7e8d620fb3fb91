"""Mixing sources to target weights by pivotal dependent rounding.

A source whose target is ``e`` times its size takes every document ``floor(e)`` times, and once more
with probability ``e - floor(e)``. These probabilities are rounded in pairs: of two documents one passes
expected words to the other until one of them is 0 or 1, so the words of the two stay put while each document
keeps its probability. Pairs are formed from the largest documents of a leaf to the smallest. Each leaf of a
source leaves at most one fractional document; these residuals meet level by level in a reduction tree. Only
the last one of a source is rounded by itself, so its words are the whole error.

Random numbers are hashes of the documents and the seed, leaves depend on the data alone, so reruns agree
whatever the partitioning, and a lost task is redone alike.

Defined cases: a null text has size 0; documents of size 0 and sources without words take nothing. A null
source is a source of its own, the last in order. Rows that repeat in full count each and may be rounded
differently. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civicsift.llm.common import named, text_or_empty, unpacked, whole_row
from civicsift.operators.prefix import running_totals, spread_lookup
from civicsift.session import materialise

MOST_COPIES = 3
LEAF_ROWS = 5_000  # documents that meet in one leaf, about
FAN_IN = 64
PIECE_ROWS = 4096  # rows that repeat are numbered in pieces of so many
EPSILON = 1e-12
GOLDEN, STRIDE = 0.6180339887498949, 7919.0  # they turn used draws into new ones


def word_count(text: Column) -> Column:
    """Number of runs without blank, tab, line feed, vertical tab, form feed and carriage return."""
    return F.regexp_count(text_or_empty(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = (1.0, 2.0, 3.0)) -> DataFrame:
    """``key, source_size, target`` from ``key`` (unique, in source order, null source last) and ``source_size``.

    All words are shared by weight; shares above ``MOST_COPIES`` times a source's size stop there and their
    excess is shared again, until no source is above. One row per source; what reaches the driver are totals.
    """
    rank = F.row_number().over(Window.orderBy("order")) - 1  # the table has one row per source
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    shares = materialise(sizes.select("key", "source_size", weight.alias("weight")), "source-weights")
    cap = F.col("source_size") * float(MOST_COPIES)
    ratio = cap / F.col("weight")  # a source is capped once the words per weight reach this
    total = float(shares.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:
        capped = ratio < level
        fixed, free = shares.agg(F.sum(F.when(capped, cap).otherwise(0.0)), F.sum(F.when(~capped, F.col("weight")))).first()
        above = level
        level = (total - (fixed or 0.0)) / free if free else math.inf
        if not free or level <= above:
            break
    target = F.when(ratio < level, cap).otherwise(F.col("weight") * F.lit(level if free else 0.0))
    return shares.select("key", "source_size", target.alias("target"))


def pair_up(a: float, b: float, first: float, second: float, draw: float) -> tuple[float, float]:
    """Probabilities of two fractional rows of ``first`` and ``second`` words after words passed between them.

    Either the first row gains or the second; both keep their expected probability, and the expected words
    of the two together stay as they are. At least one probability becomes 0 or 1.
    """
    to_first = min((1.0 - a) * first, b * second)
    to_second = min(a * first, (1.0 - b) * second)
    moved = to_first if draw * (to_first + to_second) < to_second else -to_second
    return a + moved / first, b - moved / second


def _is_open(chance: float) -> bool:
    return EPSILON < chance < 1.0 - EPSILON


def _pivot(batches: Iterator[pa.RecordBatch], last: bool) -> Iterator[pa.RecordBatch]:
    """Round rows that come sorted by ``leaf``; one fractional row of a leaf stays open, none if ``last``."""
    held: pa.RecordBatch | None = None  # the open row of a leaf that may go on in the next batch
    for batch in batches:
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        leaf, size, chance, draw = (batch.column(name).to_pylist() for name in ("leaf", "size", "chance", "draw"))
        at: int | None = None
        for row in range(len(leaf)):
            if at is not None and leaf[at] != leaf[row]:
                if last:
                    chance[at] = float(draw[at] < chance[at])
                at = None
            if not _is_open(chance[row]):
                continue
            if at is None:
                at = row
                continue
            mixed = (draw[at] * GOLDEN + draw[row]) % 1.0
            chance[at], chance[row] = pair_up(chance[at], chance[row], size[at], size[row], mixed)
            fresh = row if _is_open(chance[row]) else at if _is_open(chance[at]) else None
            if fresh is not None:
                draw[fresh] = (mixed * STRIDE + draw[fresh]) % 1.0
            at = fresh
        for name, values in (("chance", chance), ("draw", draw)):
            batch = batch.set_column(batch.schema.get_field_index(name), name, pa.array(values, pa.float64()))
        held = None if at is None else batch.slice(at, 1)
        if at is not None:
            yield from (part for part in (batch.slice(0, at), batch.slice(at + 1)) if part.num_rows)
        elif batch.num_rows:
            yield batch
    if held is not None:
        if last:
            rounded = float(held.column("draw")[0].as_py() < held.column("chance")[0].as_py())
            held = held.set_column(held.schema.get_field_index("chance"), "chance", pa.array([rounded], pa.float64()))
        yield held


def mix(docs: DataFrame, source_column: str = "source", text_column: str = "text", id_column: str = "doc_id",
        weights: Sequence[float] = (1.0, 2.0, 3.0), seed: int = 11) -> DataFrame:
    """Per row of ``docs``: ``doc_id, size, source_size, target, copies, row_key``."""
    source = named(docs, source_column)
    measured = materialise(docs.select(
        named(docs, id_column).alias("doc_id"),
        F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("="), source)).alias("key"),
        word_count(named(docs, text_column)).alias("size"),
        F.xxhash64(named(docs, id_column), named(docs, text_column)).alias("row_key"),
    ), "sizes")
    per_source = measured.groupBy("key").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    per_source = materialise(per_source, "sources")
    total = per_source.agg(F.sum("rows")).first()[0] or 0
    order = F.struct((F.col("key") == "n").alias("last"), "key")  # strings compare by code point
    targets = source_targets(per_source.withColumn("order", order), weights)
    counted = per_source.select("key", "rows", F.ceil(F.col("rows") / LEAF_ROWS).alias("parts"))
    known = spread_lookup(measured, targets.join(counted, "key"), "key", "rows", total,
                          how="inner", spread_on=["doc_id", "row_key"])

    times = F.when((F.col("source_size") > 0) & (F.col("size") > 0), F.col("target") / F.col("source_size")).otherwise(0.0)
    draw = F.pmod(F.xxhash64("doc_id", "row_key", F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)
    part = F.pmod(F.xxhash64("doc_id", "row_key"), F.col("parts"))
    rows = known.select(
        F.xxhash64("key", part).alias("leaf"), "key", part.alias("part"), "doc_id", "row_key", "size", "source_size",
        "target", F.floor(times).alias("whole"), (times - F.floor(times)).alias("chance"), draw.alias("draw"))

    def level(rows: DataFrame, last: bool = False) -> DataFrame:
        placed = rows.repartition("leaf").sortWithinPartitions("leaf", F.desc("size"), "row_key", "doc_id", "draw")
        return materialise(placed.mapInArrow(lambda batches: _pivot(batches, last), rows.schema), "mix-level")

    fractional = (F.col("chance") > EPSILON) & (F.col("chance") < 1.0 - EPSILON)
    reduced = level(rows)
    done = [reduced.filter(~fractional)]
    parts = counted.agg(F.max("parts")).first()[0] or 1
    while parts > 1:
        parts = math.ceil(parts / FAN_IN)
        part = F.floor(F.col("part") / FAN_IN)
        merged = reduced.filter(fractional).withColumns({"part": part, "leaf": F.xxhash64("key", part)})
        reduced = level(merged.select(rows.columns))
        done.append(reduced.filter(~fractional))
    done.append(level(reduced.filter(fractional), last=True))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("doc_id", "size", "source_size", "target",
                      (F.col("whole") + F.round("chance")).cast("long").alias("copies"), "row_key")


def repeat_rows(docs: DataFrame, **options: object) -> DataFrame:
    """The mix itself: every row of ``docs`` as many times as it is taken, with its columns unchanged.

    Rows meet their copies by id and content; rows of one id and content share the copies of all of them evenly, and
    some of them one more where that leaves a remainder.
    """
    columns = {"text_column": "text", "id_column": "doc_id"} | {k: v for k, v in options.items() if k.endswith("_column")}
    taken = mix(docs, **options)
    per_row = (taken.groupBy("doc_id", "row_key").agg(F.sum("copies").alias("total"), F.count(F.lit(1)).alias("rows"))
               .filter("total > 0"))
    rows = docs.select(whole_row(docs).alias("row"), named(docs, columns["id_column"]).alias("id"),
                       F.xxhash64(named(docs, columns["id_column"]), named(docs, columns["text_column"])).alias("key"))
    per_row = materialise(per_row, "copies")
    joined = rows.join(per_row, rows["id"].eqNullSafe(per_row["doc_id"]) & (rows["key"] == per_row["row_key"]))
    single = joined.filter("rows = 1").select("row", F.col("total").alias("times"))
    # rows that repeat are numbered by pieces, however many there are of one
    same = F.concat_ws(" ", F.coalesce(F.col("id").cast("string"), F.lit("")), F.col("key").cast("string"), F.col("id").isNull().cast("string"))
    repeated = materialise(joined.filter("rows > 1").select(
        "row", same.alias("same"), "total", "rows", F.lit(1).alias("one"), F.monotonically_increasing_id().alias("at")), "repeated")
    placed = running_totals(repeated, ["same"], F.floor(F.col("at") / PIECE_ROWS), [F.col("at")], ["one"])
    share = F.floor(F.col("total") / F.col("rows")) + (F.col("one_before") < F.col("total") % F.col("rows")).cast("long")
    times = single.unionByName(placed.select("row", share.alias("times"))).filter("times > 0")
    copies = times.select("row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("copy"))
    return copies.select(*unpacked(copies, docs.columns))
