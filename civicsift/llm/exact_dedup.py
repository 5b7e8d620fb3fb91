"""Exact deduplication behind two Bloom passes, in DataFrame operations only.

The first pass counts how often each filter position is hit. Positions hit twice or more form the
second filter. A row whose positions are all in the second filter may be repeated; any other row is
unique for certain. Only the first kind is grouped by its digest; the rest pass straight through.

Defined cases: a null text counts as empty, and empty texts are equal to each other. Of equal
texts the one with the most code points stays, then the smallest id; a null id comes after all
others. Of rows that also repeat the id and the length exactly one stays. An empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicsift.llm.common import named, text_or_empty, unpacked, whole_row
from civicsift.operators.prefix import spread_lookup
from civicsift.session import materialise

BITS_PER_ROW = 16  # two positions per row: below 2 % of the unique rows are taken for repeated ones
BROADCAST_WORDS = 2_000_000  # 64-bit words of the second filter sent to every executor, 64 MB at most
LEAST_BITS = 1 << 16


def normalised(text: Column) -> Column:
    """The text without blanks, tabs, line feeds, vertical tabs, form feeds and carriage returns."""
    return F.regexp_replace(text_or_empty(text), r"[\x20\x09-\x0D]+", "")


def text_digest(text: Column) -> Column:
    return F.sha2(normalised(text), 256)


def filter_bits(rows: int) -> int:
    """Positions of the filter: a power of two that grows with the rows."""
    return max(LEAST_BITS, 1 << (max(rows, 1) * BITS_PER_ROW - 1).bit_length())


def _positions(digest: Column, bits: int) -> list[Column]:
    return [F.xxhash64(digest, F.lit(seed)).bitwiseAND(F.lit(bits - 1)) for seed in (1, 2)]


def repeat_filter(digests: DataFrame, digest: str, bits: int) -> DataFrame:
    """The second filter: ``word`` and the ``mask`` of its positions that were hit more than once."""
    hits = digests.select(F.explode(F.array(*_positions(F.col(digest), bits))).alias("bit"))
    return _words(hits.groupBy("bit").agg(F.count(F.lit(1)).alias("hits")).filter("hits > 1"))


def member_filter(keys: DataFrame, key: str, bits: int) -> DataFrame:
    """A filter of the same form that holds all ``keys``."""
    return _words(keys.select(F.explode(F.array(*_positions(F.col(key), bits))).alias("bit")))


def _words(hits: DataFrame) -> DataFrame:
    mask = F.expr("shiftleft(1L, cast(bit & 63 as int))")
    return (hits.select(F.expr("shiftright(bit, 6)").alias("word"), mask.alias("mask"))
            .groupBy("word").agg(F.bit_or("mask").alias("mask")))


def mark_repeats(rows: DataFrame, digest: str, words: DataFrame, n_words: int, bits: int) -> DataFrame:
    """Add ``maybe_repeated``. A filter above ``BROADCAST_WORDS`` is joined by shuffling instead."""
    marked, found = rows, F.lit(True)
    for number, position in enumerate(_positions(F.col(digest), bits)):
        side = words.select(F.col("word").alias(f"_word{number}"), F.col("mask").alias(f"_mask{number}"))
        side = F.broadcast(side) if n_words <= BROADCAST_WORDS else side
        marked = marked.withColumn(f"_bit{number}", position)
        marked = marked.join(side, F.shiftright(F.col(f"_bit{number}"), 6) == F.col(f"_word{number}"), "left")
        inside = F.expr(f"shiftright(_mask{number}, cast(_bit{number} & 63 as int)) & 1L = 1L")
        found = found & F.coalesce(inside, F.lit(False))
    return marked.select(*rows.columns, found.alias("maybe_repeated"))


def decide(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are read once. What is written and shuffled holds digests, ids and lengths.
    """
    digests = materialise(
        docs.select(
            named(docs, id_column).alias("doc_id"),
            text_digest(named(docs, text_column)).alias("text_sha256"),
            F.length(text_or_empty(named(docs, text_column))).alias("length"),
            F.monotonically_increasing_id().alias("row_number"),
        ), "digests")
    total = digests.count()
    bits = filter_bits(total)
    words = materialise(repeat_filter(digests, "text_sha256", bits), "repeat-filter")
    marked = mark_repeats(digests, "text_sha256", words, words.count(), bits)

    order = F.struct(F.col("length"), -F.col("doc_id"), -F.col("row_number"))
    groups = (
        marked.filter("maybe_repeated").groupBy("text_sha256")
        .agg(F.count(F.lit(1)).alias("rows"), F.max_by(F.struct("doc_id", "row_number"), order).alias("keeper"))
        .filter("rows > 1")
        .select("text_sha256", "rows", F.col("rows").alias("group_size"), F.col("keeper.doc_id").alias("keep_id"),
                F.col("keeper.row_number").alias("keep_row"))
    )
    looked_up = spread_lookup(
        marked.filter("maybe_repeated").drop("maybe_repeated"), groups, "text_sha256", "rows", total,
        spread_on=["row_number"])
    grouped = looked_up.select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("keep_row") == F.col("row_number"), F.lit(True)).alias("kept"),
        "text_sha256",
    )
    single = marked.filter(~F.col("maybe_repeated")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "text_sha256")
    return single.unionByName(grouped)


def deduplicate(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows that stay, with all their columns. Rows that are unique for certain are not shuffled."""
    keyed = docs.select(
        text_digest(named(docs, text_column)).alias("digest"),
        F.length(text_or_empty(named(docs, text_column))).alias("length"),
        named(docs, id_column).alias("id"), whole_row(docs).alias("row"))
    digests = materialise(keyed.select("digest"), "digests")
    bits = filter_bits(digests.count())
    words = materialise(repeat_filter(digests, "digest", bits), "repeat-filter")
    marked = mark_repeats(keyed, "digest", words, words.count(), bits)
    tie = F.xxhash64(F.col("row").getField(text_column))
    grouped = (marked.filter("maybe_repeated").groupBy("digest")
               .agg(F.max_by("row", F.struct(F.col("length"), -F.col("id"), tie)).alias("row")))
    kept = marked.filter(~F.col("maybe_repeated")).select("row").unionByName(grouped.select("row"))
    return kept.select(*unpacked(kept, docs.columns))
