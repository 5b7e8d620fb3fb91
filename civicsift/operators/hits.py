"""Matches of very many regexes in very many texts, by an index of what a match must contain.

A table of patterns of any size is joined to texts: from every regex follow factors, plain texts one of which any
match holds. A factor is indexed by its whole text, a long one by its rarest piece, and texts are looked up by the pieces
they hold; where both meet, the regex is run around the places of the piece. Pieces are whole numbers, found in a batch of texts
at once; bits of a fixed number keep nearly all those that index nothing from being shuffled. Patterns without a factor,
like ``[0-9]+``, are few in practice; they are run on all texts, some at a time.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterable, Iterator
from re import _constants as op

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civicsift.functions.regex import java_literal, java_tree, parse
from civicsift.operators.grams import bounded_batches
from civicsift.operators.prefix import spread_lookup
from civicsift.session import materialise

GRAMS = tuple(range(3, 25))  # lengths of pieces; a factor is looked up by the longest it has room for
FILTER_BITS = 32  # for each number that is looked for, up to 2 ** MOST_BITS in all
MOST_BITS = 28
SLICES = 16  # of the bits, each set by one task
ENDS = 5  # bits of a length
LOOK_BYTES = 1 << 20  # of texts that are looked through at once, about
WHOLE = 1 << 30  # beyond the end of any text
NEAR_REACH = 64  # of patterns whose matches are looked for around each place alone
CHUNK = 1024  # characters of the pieces a text is cut into, so that a part of it is found without counting all characters before
APART = 2 * NEAR_REACH + 2  # characters beyond which what such patterns match around two places cannot meet
MOST_REACH = 1000  # characters of a match around which a regex is run on a part of the text
TOGETHER = 100  # patterns without an index entry that are run in one look at the texts

# fixed values: the letters beyond ASCII that regexes take for ASCII ones when case is ignored, and those
_ODD_CASE, _PLAIN_CASE = "İıſK", "iisk"

# fixed values: odd numbers that mix the bits of pieces, and those that give the bits of a piece
_MIX, _PLACES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93), (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xA24BAED4963EE407)

_WORD = np.isin(np.arange(256), list(b"0123456789_abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"))

# factors are found in executors, which need no copy of this package
for _module in (__name__, parse.__module__):
    cloudpickle.register_pickle_by_value(sys.modules[_module])


def folded(text: Column) -> Column:
    """The text as its pieces are compared: a regex that ignores case takes texts for equal only if these are."""
    return F.lower(F.translate(text, _ODD_CASE, _PLAIN_CASE))


def required_factors(pattern: str) -> list[str]:
    """Lower-case ASCII texts, one of which at least is part of every match; none if there is nothing to go by."""
    return _factors(parse(pattern))


def _factors(tree) -> list[str]:
    return sorted(_best(list(tree)) or ())


def _best(nodes: list) -> set[str] | None:
    found: list[set[str]] = []
    run: list[str] = []

    def close() -> None:
        if run:
            found.append({"".join(run)})
            run.clear()

    def walk(nodes: Iterable) -> None:
        for kind, value in nodes:
            if kind is op.LITERAL and value < 128:
                run.append(chr(value).lower())
            elif kind in (op.AT, op.ASSERT, op.ASSERT_NOT):
                pass  # takes no room, so that what stands on either side is still next to each other
            elif kind is op.SUBPATTERN:
                walk(value[3])
            elif kind is op.ATOMIC_GROUP:
                walk(value)
            elif kind is op.BRANCH:
                close()
                parts = [_best(list(branch)) for branch in value[1]]
                if all(parts):
                    found.append(set().union(*parts))
            else:
                close()
                if str(kind) in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] > 0:
                    inner = _best(list(value[2]))
                    if inner:
                        found.append(inner)

    walk(nodes)
    close()
    return max(found, key=lambda texts: (min(map(len, texts)), -len(texts)), default=None)


def reach(pattern: str) -> int:
    """Characters a match can have at most, if what is beyond them and the next character cannot matter; else 0."""
    return _reach(parse(pattern))


def _reach(tree) -> int:
    def looks_away(nodes: Iterable) -> bool:
        for kind, value in nodes:
            if kind in (op.ASSERT, op.ASSERT_NOT) or kind is op.AT and str(value) not in ("AT_BOUNDARY", "AT_NON_BOUNDARY"):
                return True
            parts = value[1] if kind is op.BRANCH else [part for part in value if hasattr(part, "getwidth")] if isinstance(
                value, tuple) else [value] if hasattr(value, "getwidth") else []
            if any(looks_away(part) for part in parts):
                return True
        return False

    return 0 if tree.getwidth()[1] > MOST_REACH or looks_away(tree) else tree.getwidth()[1]


def described(pattern: str) -> tuple[str, list[str], int, int]:
    """The regex in Java's form, its factors, its reach, and the ends of the factor at which no word may go on (1 the first, 2 the last one),
    if it is looked up as a whole; plain words need not be parsed for that."""
    known = java_literal(pattern)
    if known:
        regex, text, edges = known
        return regex, [text.lower()], len(text) if len(text) <= MOST_REACH else 0, edges if len(text) <= max(GRAMS) else 0
    tree = parse(pattern)
    return java_tree(tree), _factors(tree), _reach(tree), 0


def with_factors(patterns: DataFrame) -> DataFrame:
    """Add ``regex`` (in Java's form), ``factors``, ``reach`` and ``edges`` to a table with ``pattern``."""
    patterns = patterns.repartition(patterns.sparkSession.sparkContext.defaultParallelism)  # parsing takes longer than reading

    @F.pandas_udf("regex string, factors array<string>, reach int, edges int")
    def translate(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([described(text) for text in texts], columns=["regex", "factors", "reach", "edges"])

    return patterns.withColumn("_both", translate("pattern")).select(*patterns.columns, "_both.*")


def _mixed(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    out = first * np.uint64(_MIX[0])
    out += second
    out ^= out >> np.uint64(32)
    out *= np.uint64(_MIX[1])
    return out


def _levels(raw: np.ndarray) -> dict[int, np.ndarray]:
    """By lengths that are powers of two, a number for the bytes of that length from every place on."""
    out, size = {1: raw.astype(np.uint64) + np.uint64(1)}, 1
    while 2 * size <= max(GRAMS):
        out[2 * size] = _mixed(out[size][:-size], out[size][size:])
        size *= 2
    return out


def _code(levels: dict[int, np.ndarray], places: np.ndarray, kind: int) -> np.ndarray:
    """Numbers of the pieces of a kind at some places, the kind in the upper bits; pieces may share one, and have a regex run in vain.

    A kind is the length and, above ``ENDS`` bits, the ends at which no ASCII word goes on (1 the first, 2 the last one).
    """
    length = kind & ((1 << ENDS) - 1)
    size = 1 << (length.bit_length() - 1)
    return _marked(_mixed(levels[size][places], levels[size][places + (length - size)]), kind)


def _marked(code: np.ndarray, mark: int) -> np.ndarray:
    return ((code & np.uint64((1 << 56) - 1)) | np.uint64(mark << 56)).view(np.int64)


def _start_length(kind: int) -> int:
    """Characters by which pieces of a kind are looked for first; 0 if there is no use in it."""
    length = kind & ((1 << ENDS) - 1)
    return 8 if length >= 8 else 4 if length >= 4 else 0


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of some texts, and where in them each text begins, and the last one ends."""
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)
    raw = np.frombuffer(data, np.uint8, int(bounds[-1] - bounds[0]), int(bounds[0])) if bounds[-1] > bounds[0] else np.zeros(0, np.uint8)
    return raw, bounds - bounds[0]


def held_places(texts: pa.Array, kinds: list[int], bits: np.ndarray) -> tuple[np.ndarray, ...]:
    """``rows, codes, first, last`` of the ASCII pieces of every text that ``bits`` let through: the first and the last
    of places not ``APART``, characters counted from 1."""
    raw, bounds = _bytes(pc.fill_null(texts.cast(pa.string()), ""))
    found, row = [tuple(np.zeros(0, np.int64) for _ in range(4))], 0
    while row < len(texts):
        end = max(int(np.searchsorted(bounds, bounds[row] + LOOK_BYTES, side="right")) - 1, row + 1)
        rows, *rest = _looked_through(raw[bounds[row]:bounds[end]], bounds[row:end + 1] - bounds[row], kinds, bits)
        found.append((rows + row, *rest))
        row = end
    return tuple(np.concatenate(column) for column in zip(*found, strict=True))


def _looked_through(raw: np.ndarray, bounds: np.ndarray, kinds: list[int], bits: np.ndarray) -> tuple[np.ndarray, ...]:
    levels, at = _levels(raw), np.arange(raw.size)
    stop = np.where(raw < 128, raw.size, at)  # the next character beyond ASCII
    room = np.minimum(np.minimum.accumulate(stop[::-1])[::-1], np.repeat(bounds[1:], np.diff(bounds))) - at
    goes_on = np.zeros(raw.size + 1, bool)  # a word that began before, within the text
    goes_on[1:-1] = _WORD[raw[1:]] & _WORD[raw[:-1]]
    goes_on[bounds] = False
    places, codes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for size, first in sorted({(_start_length(kind), kind >> ENDS & 1) for kind in kinds}):
        begun = np.flatnonzero((room >= max(size, 1)) & ~goes_on[:-1] if first else room >= max(size, 1))
        if size:
            begun = begun[_set(bits, _marked(levels[size][begun], 64 + size))]
        for kind in kinds:
            if (_start_length(kind), kind >> ENDS & 1) == (size, first):
                length = kind & ((1 << ENDS) - 1)
                own = begun[room[begun] >= length]
                own = own[~goes_on[own + length]] if kind >> ENDS & 2 else own
                code = _code(levels, own, kind)
                kept = _set(bits, code)
                places.append(own[kept])
                codes.append(code[kept])
    place, code = np.concatenate(places), np.concatenate(codes)
    row = np.searchsorted(bounds, place, side="right") - 1
    order = np.lexsort((place, code, row))
    place, code, row = place[order], code[order], row[order]
    chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    at = chars[place] - chars[bounds[row]] + 1
    new = np.ones(row.size + 1, bool)
    new[1:-1] = (row[1:] != row[:-1]) | (code[1:] != code[:-1]) | (np.diff(at) > APART)
    return row[new[:-1]], code[new[:-1]], at[new[:-1]], at[new[1:]]


def _bit_places(codes: np.ndarray, power: int) -> list[np.ndarray]:
    return [((codes.view(np.uint64) * np.uint64(odd)) >> np.uint64(64 - power)).astype(np.int64) for odd in _PLACES]


def _set(bits: np.ndarray, codes: np.ndarray) -> np.ndarray:
    power = bits.size.bit_length() + 2
    out = np.arange(codes.size)
    for odd in _PLACES:  # few are left after the first one
        place = ((codes[out].view(np.uint64) * np.uint64(odd)) >> np.uint64(64 - power)).view(np.int64)
        out = out[(bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1]
    kept = np.zeros(codes.size, bool)
    kept[out] = True
    return kept


def piece_bits(pieces: DataFrame) -> Broadcast:
    """Bits that are set for every ``gram`` and ``start`` of the table, and for few other numbers, if it is not beyond ``MOST_BITS``."""
    spark = pieces.sparkSession
    codes = pieces.select("gram").union(pieces.select("start").distinct())
    power = min(max((codes.count() * FILTER_BITS).bit_length(), 10), MOST_BITS)
    size = (1 << power) // SLICES

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = np.concatenate(_bit_places(batch.column(0).to_numpy(), power))
            yield pa.RecordBatch.from_arrays([pa.array(place // size), pa.array(place % size)], ["slice", "place"])

    def set_bits(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(size, bool)
        for batch in batches:
            found[batch.column("place").to_numpy()] = True
        packed = np.packbits(found, bitorder="little").tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([packed], pa.binary())], ["slice", "bits"])

    bits = np.zeros((SLICES, size // 8), np.uint8)
    rows = codes.mapInArrow(places, "slice long, place long").groupBy("slice").applyInArrow(set_bits, "slice long, bits binary")
    for row in rows.collect():  # SLICES rows
        bits[row["slice"]] = np.frombuffer(row["bits"], np.uint8)
    return spark.sparkContext.broadcast(bits.reshape(-1))


def held_pieces(texts: DataFrame, kinds: list[int], bits: Broadcast) -> DataFrame:
    """``(_key, _id, gram, first, last)``: where every text of ``(_key, _id, _fold)`` holds pieces that ``bits`` let through."""
    bounded_batches(texts.sparkSession)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, *found = held_places(batch.column(2), kinds, bits.value)
            own = [batch.column(at).take(pa.array(rows)) for at in range(2)]
            yield pa.RecordBatch.from_arrays([*own, *map(pa.array, found)], ["_key", "_id", "gram", "first", "last"])

    numbers = [T.StructField(name, T.LongType()) for name in ("_id", "gram", "first", "last")]
    return texts.select("_key", "_id", "_fold").mapInArrow(find, T.StructType([texts.schema["_key"], *numbers]))


def factor_pieces(known: DataFrame) -> DataFrame:
    """``(number, regex, place, reach, gram, start)``: the pieces that each factor, told by its place, is looked up by, and what they begin
    with; a pattern of several factors has no reach."""

    @F.arrow_udf("array<struct<gram:bigint,start:bigint>>")
    def pieces(factors: pa.Array, edges: pa.Array) -> pa.Array:
        raw, bounds = _bytes(factors.cast(pa.string()))
        levels, sizes = _levels(raw), np.diff(bounds)
        often = np.maximum(sizes // max(GRAMS), 1)  # pieces side by side
        ends = np.concatenate([[0], np.cumsum(often)])
        row = np.repeat(np.arange(len(factors)), often)
        place = bounds[row] + (np.arange(ends[-1]) - ends[row]) * max(GRAMS)
        kind = np.minimum(sizes, max(GRAMS))[row] + (edges.to_numpy(zero_copy_only=False).astype(np.int64) << ENDS)[row]
        gram, start = np.zeros(row.size, np.int64), np.zeros(row.size, np.int64)
        for number in np.unique(kind).tolist():
            own = np.flatnonzero(kind == number)
            gram[own] = start[own] = _code(levels, place[own], number)
            if size := _start_length(number):
                start[own] = _marked(levels[size][place[own]], 64 + size)
        both = pa.StructArray.from_arrays([pa.array(gram), pa.array(start)], ["gram", "start"])
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), both)

    single = F.when(F.size("factors") == 1, F.col("reach")).otherwise(0).alias("reach")
    factors = known.select("number", "regex", single, "edges", F.posexplode("factors").alias("place", "factor"))
    return factors.select("number", "regex", "place", "reach", F.inline(pieces("factor", "edges")))


def pattern_hits(texts: DataFrame, patterns: DataFrame, key: str, text: str = "body") -> DataFrame:
    """``key, number, matches`` for every text and pattern that match; ``matches`` holds what was matched, in order.

    ``patterns`` has ``number`` and ``pattern`` and may have any size, as may the texts. ``key`` is unique. Texts that are
    null match nothing.
    """
    known = materialise(with_factors(patterns.select("number", "pattern")), "factors")
    indexed = (F.size("factors") > 0) & F.forall("factors", lambda factor: F.length(factor) >= min(GRAMS))
    pieces = materialise(factor_pieces(known.filter(indexed)), "pieces")
    kinds = sorted(row[0] for row in pieces.select(F.shiftright("gram", 56).cast("int")).distinct().collect())  # few numbers
    body = texts.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.xxhash64(text).alias("_id")).filter(F.col("_text").isNotNull())
    folds = body.select("_key", "_id", folded(F.col("_text")).alias("_fold"))
    held = materialise(held_pieces(folds, kinds, piece_bits(pieces)), "held-pieces")
    # a piece no text holds is the best there is: nothing can match then, and no entry is made
    counted = pieces.join(held.groupBy("gram").agg(F.count(F.lit(1)).alias("rows")), "gram", "left").na.fill(0, ["rows"])
    rarest = counted.groupBy("number", "regex", "place", "reach").agg(
        F.min_by(F.struct("gram", "rows"), F.struct("rows", "gram")).alias("best"))
    entries = materialise(rarest.filter("best.rows > 0").groupBy(F.col("best.gram").alias("gram"), F.col("best.rows").alias("rows")).agg(
        F.collect_list(F.struct("number", "regex", "reach")).alias("entries")), "pattern-index")
    total = entries.agg(F.sum("rows")).first()[0] or 0
    met = spread_lookup(held, entries, "gram", "rows", total, "inner", spread_on=["_key"])
    found = met.select("_key", "_id", "first", "last", F.shiftright("gram", 56).bitwiseAND((1 << ENDS) - 1).alias("length"),
                       F.explode("entries").alias("entry")).select("_key", "_id", "entry.*", "first", "last", "length")
    # all matches are in the parts that reach the first and the last place of the piece, with a character on either side
    size, beyond = F.col("reach"), F.col("reach") - F.col("length")
    part = F.struct(F.when(size == 0, 1).otherwise(F.greatest(F.col("first") - beyond - 1, F.lit(1))).cast("int").alias("from"),
                    F.when(size == 0, WHOLE).otherwise(F.col("last") + size).cast("int").alias("to"))
    parts = found.withColumn("part", part).repartition("_key", "_id").groupBy("_key", "_id", "number", "regex", "reach").agg(
        F.min("part.from").alias("from"), F.max("part.to").alias("to"), F.array_sort(F.collect_set("part")).alias("parts"))
    alone = (size > 0) & (size <= NEAR_REACH)
    places = F.when(alone, F.col("parts")).otherwise(F.array(F.struct("from", "to")))
    owned = parts.groupBy("_key", "_id").agg(F.collect_list(F.struct("number", "regex", places.alias("places"))).alias("_found"))
    chunks = body.select("_key", "_id", F.regexp_extract_all("_text", F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)).alias("_chunks"))
    out = owned.join(chunks, ["_key", "_id"]).select("_key", F.inline(F.filter(F.transform("_found", lambda own: F.struct(
        own["number"].alias("number"), F.flatten(F.transform(own["places"], lambda place: F.regexp_extract_all(
            _part(place), own["regex"], F.lit(0)))).alias("matches"))), lambda row: F.size(row["matches"]) > 0)))
    for group in _groups(known.filter(~indexed).select("number", "regex").orderBy("number").collect()):
        found = F.filter(F.array(*[
            F.struct(F.lit(row["number"]).alias("number"),
                     F.regexp_extract_all("_text", F.lit(row["regex"]), F.lit(0)).alias("matches")) for row in group]),
            lambda row: F.size(row["matches"]) > 0)
        out = out.unionByName(body.select("_key", F.inline(found)))
    return out.select(F.col("_key").alias(key), "number", "matches")


def _part(place: Column) -> Column:
    """The part of a text in ``_chunks`` between two characters."""
    chunk = F.floor((place["from"] - 1) / CHUNK).cast("int")
    chunks = F.slice("_chunks", chunk + 1, F.floor((place["to"] - 1) / CHUNK).cast("int") - chunk + 1)
    return F.substring(F.array_join(chunks, ""), place["from"] - chunk * CHUNK, place["to"] - place["from"] + 1)


def _groups(rows: list) -> Iterable[list]:
    return (rows[at:at + TOGETHER] for at in range(0, len(rows), TOGETHER))
