"""Near-duplicate passages of documents by compact windows.

A text is a sequence of word shingles. Each hash function orders the shingles at random. In a Cartesian tree over these
values a node groups all sequences that share their least value; of these sequences only those of ``WIDTH``
shingles are wanted here, so no tree is built: sliding minima of that fixed width give, for every function, the same windows
of start positions whose passages have one signature. Instead of joining the windows of many functions by how many agree,
the windows of two functions are intersected to cells with two
signatures; passages with a Jaccard similarity of s share a given pair with a chance of about s * s, so
``PAIRS`` pairs miss one of 0.8 in about ``0.36 ** PAIRS`` of all cases. Jobs:

1. keys: cells that repeat anywhere are found by ``exchange``, without moving texts;
2. cells: only those are dealt by key to shards. Within a key each cell is joined with all cells of other
   documents, aligned at their common shingle;
3. hot keys, those of ``HOT_CELLS`` cells or more, would need too many pairs. The passages of their cells are joined by
   an exact prefix filter instead (``rekeyed``). Shingles are ordered by how often they occur, the rarest first; two
   passages that are similar enough share one of the first shingles of both. If that occurs fewer than
   ``HOT_SHINGLES`` times, it is the key of further cells of 2. Otherwise the passages have only frequent shingles in
   common, and their similarity follows from their types: the set of frequent shingles and the number of all. Types
   are compared instead of passages (``hot_links``), and links by them are counted in bit maps of documents
   (``count_links``), never listed;
4. verification: the passage of one side is sent to the group that holds the other, where the exact Jaccard
   similarity of both shingle sets decides;
5. classes: documents joined by verified passages, and copies of whole texts, form connected components.

Defined cases: null texts count as empty; texts of fewer than ``WORDS`` words hold no passage, copies
included. A null id counts as larger than all others and stays null. Rows of one id are parts of one
document: they are not compared, and each of them lists the links and spans of all. An empty table gives an
empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from civicsift.llm.components import components
from civicsift.llm.exchange import (
    NO_ID,
    codes_of,
    emit,
    known_codes,
    lookup,
    mixed,
    pack,
    placed,
    raw_rows,
    read_file,
    send_back,
    send_keys,
    shared_codes,
    slices,
    string_hashes,
    with_copies,
)
from civicsift.operators.prefix import spread_lookup
from civicsift.operators.tfidf import number_terms
from civicsift.session import materialise, scratch_path

SHINGLE = 5
WORDS = 50
WIDTH = WORDS - SHINGLE + 1  # shingles of a passage
SIMILARITY = 0.8
PAIRS = 4
KEYS_PER_BUCKET = 1 << 20
BYTES_PER_SHARD = 16 << 20
HOT_CELLS = 64  # of a key; as many cells or more are joined by other means than all pairs
HOT_SHINGLES = 64  # occurrences, in passages of hot keys, from which a shingle is frequent
BROADCAST_SHINGLES = 1 << 18  # counts sent to every executor, 4 MB at most; more are joined by shuffling
TYPES_PER_PART = 1 << 12  # types with one leading shingle that are held at once with as many others
COLUMNS = 1 << 10  # shingles counted at a time there
STRIP = 1 << 9  # types compared at a time there
KINDS_PER_BLOCK = 1 << 10  # documents of different types that are counted in one task
MAP_BITS = 1 << 15  # documents of a map, 1 << 16 at most
REACHED = 1 << 24  # documents reached by types that are kept while kinds are counted
WINDOWS = 1 << 14  # passages that are ordered at a time

_BASE = np.uint64(0x9E3779B97F4A7C15)
_PLACE_BITS = 24  # of a place within a slice, see exchange.SLICE_BYTES


def shingles(raw: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes of texts laid end to end, the number of shingles and of words of each text.

    Words are runs of other bytes than blank, tab, line feed, vertical tab, form feed and carriage return, A-Z
    lower-cased.
    """
    begins = np.cumsum(lengths) - lengths
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.zeros(raw.size + 1, bool)
    edge[begins] = True
    edge[-1] = True
    first = np.flatnonzero(~blank & (np.concatenate([[True], blank])[:raw.size] | edge[:-1]))
    last = np.flatnonzero(~blank & (np.concatenate([blank, [True]])[1:] | edge[1:]))
    counts = np.diff(np.searchsorted(first, np.append(begins, raw.size)))
    sizes = np.maximum(counts - SHINGLE + 1, 0)
    if first.size < SHINGLE:
        return np.zeros(0, np.uint64), sizes, counts
    codes = string_hashes(raw + 32 * ((raw >= 65) & (raw <= 90)).astype(np.uint8), first, last + 1 - first)
    rolled = np.zeros(codes.size - SHINGLE + 1, np.uint64)
    for at in range(SHINGLE):
        rolled = rolled * _BASE + codes[at:codes.size - SHINGLE + 1 + at]
    owner = np.repeat(np.arange(counts.size), counts)
    return mixed(rolled[owner[:rolled.size] == owner[SHINGLE - 1:]]), sizes, counts


def _leasts(values: np.ndarray) -> np.ndarray:
    """For each start the least value of ``WIDTH`` in a row, and in its low bits the place of the first such."""
    packed = values >> np.uint64(_PLACE_BITS) << np.uint64(_PLACE_BITS) | np.arange(values.size, dtype=np.uint64)
    width, size = 1, values.size - WIDTH + 1
    while 2 * width <= WIDTH:
        packed = np.minimum(packed[:-width], packed[width:])
        width *= 2
    return np.minimum(packed[:size], packed[WIDTH - width:WIDTH - width + size])


def cells(values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Cells of shingle sequences laid end to end: key, text, first start, last start, place of the common shingle.

    Starts and places count from the beginning of their text.
    """
    total = values.size - WIDTH + 1
    if total <= 0:
        return tuple(np.zeros(0, kind) for kind in (np.uint64, np.int64, np.int64, np.int64, np.int64))
    owner = np.repeat(np.arange(sizes.size), sizes)
    begins = np.cumsum(sizes) - sizes
    inside = owner[:total] == owner[WIDTH - 1:]
    edge = np.ones(total, bool)
    edge[1:] = (owner[1:total] != owner[:total - 1]) | ~inside[:-1]
    place = np.uint64((1 << _PLACE_BITS) - 1)
    out = []
    for pair in range(PAIRS):
        one, two = (_leasts(mixed(values ^ np.uint64(0x51ED270B * (2 * pair + side + 1)))) for side in (0, 1))
        change = edge.copy()
        change[1:] |= (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        start = np.flatnonzero(change & inside)
        text = owner[start]
        stop = np.minimum(np.append(start, total)[1:], (begins + sizes)[text] - WIDTH + 1)
        key = mixed((one[start] & ~place) * _BASE + (two[start] >> np.uint64(_PLACE_BITS)) + np.uint64(pair))
        centre = (one[start] & place).astype(np.int64)
        out.append((key, text, start - begins[text], stop - 1 - begins[text], centre - begins[text]))
    return tuple(np.concatenate(column) for column in zip(*out, strict=True))


def _cell_keys(raw: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    values, sizes, _ = shingles(raw, lengths)
    return cells(values, sizes)[0]


_CELL = np.dtype([("key", np.uint64), ("id", np.int64), ("group", np.int64), ("row", np.int32), ("first", np.int32),
                  ("last", np.int32), ("centre", np.int32)])
_SIDE = [("row", np.int32), ("start", np.int32), ("count", np.int32), ("other_id", np.int64),
         ("other_group", np.int64), ("other_row", np.int32), ("other_start", np.int32)]
_ASK = np.dtype(_SIDE)  # row, start: the side that sends its shingles; count: of starts to compare
_CHECK = np.dtype([*_SIDE, ("shingles", np.uint32, 2 * WIDTH - 1)])  # row, start: the side that compares


_DEALT = "shard long, sent binary, size long"
_HOT_ROWS = "id long, group string, row int, places array<int>, shingles array<long>"


def _dealt(parts: np.ndarray, shards: int) -> list[tuple[int, bytes, int]]:
    """Cells packed by shard."""
    shard = (mixed(parts["key"]) % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    parts, shard = parts[order], shard[order]
    starts = np.flatnonzero(np.diff(shard, prepend=-1))
    return [(int(shard[a]), pa.compress(parts[a:b].tobytes(), "zstd", asbytes=True), int((b - a) * _CELL.itemsize))
            for a, b in zip(starts, np.append(starts, shard.size)[1:], strict=True)]


def _lists(values: np.ndarray, starts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(starts, values.size), pa.int32()), pa.array(values, kind))


def send_cells(bodies: DataFrame, folder: str, bits: int, shards: int) -> DataFrame:
    """The cells of repeated keys by ``shard``; rows of shard -1 hold the shingles of a text in cells of hot keys."""
    dealt = ["shard", "sent", "size"]
    names = [*dealt, "id", "group", "row", "places", "shingles"]
    kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int64())]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, known, often, found = None, np.zeros(0, np.uint64), np.zeros(0, bool), []

        def finish() -> pa.RecordBatch:
            rows = _dealt(np.concatenate([np.zeros(0, _CELL), *found]), shards)
            return emit([(*row, *[None] * 5) for row in rows], names, kinds)

        for group, number, piece in slices(batches):
            if group != current:
                if current is not None:
                    yield finish()
                current, found = group, []
                known, often = known_codes(folder, group)
            rows, lengths, raw = raw_rows(piece)
            values, sizes, _ = shingles(raw, lengths)
            key, text, first, last, centre = cells(values, sizes)
            if not known.size or not key.size:
                continue
            hit, at = lookup(known, codes_of(key, bits))
            hot = hit & often[at]
            hit &= ~hot
            part = np.empty(int(hit.sum()), _CELL)
            for name, column in (("key", key), ("first", first), ("last", last), ("centre", centre)):
                part[name] = column[hit]
            ids = piece.column("order_id").to_numpy()[rows]
            part["row"] = number + rows[text[hit]]
            part["id"] = ids[text[hit]]
            part["group"] = int(group)
            found.append(part)
            if not hot.any():
                continue
            begins = np.cumsum(sizes) - sizes
            edges = np.zeros(values.size + 1, np.int64)
            np.add.at(edges, begins[text[hot]] + first[hot], 1)
            np.add.at(edges, begins[text[hot]] + last[hot] + WIDTH, -1)
            covered = np.flatnonzero(np.cumsum(edges)[:-1] > 0)
            owner = np.searchsorted(np.cumsum(sizes), covered, side="right")
            texts, starts = np.unique(owner, return_index=True)
            count = texts.size
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(count, -1)), pa.nulls(count, pa.binary()), pa.nulls(count, pa.int64()), pa.array(ids[texts]),
                pa.array([group] * count, pa.string()), pa.array((number + rows[texts]).astype(np.int32)),
                _lists((covered - begins[owner]).astype(np.int32), starts, pa.int32()),
                _lists(values[covered].view(np.int64), starts, pa.int64())], names)
        if current is not None:
            yield finish()

    return bodies.mapInArrow(work, f"{_DEALT}, {_HOT_ROWS}")


_TYPE_ROWS = "type long, id long, row_key long, first long, last long, words int, shingles array<long>"


def rekeyed(texts: DataFrame, shards: int, hot: int) -> DataFrame:
    """Cells, types and their definitions of the passages of ``texts``.

    ``texts`` has ``id, group, row, row_key`` and ``parts``: sorted by place, the shingles of a row, and how often each
    occurs in all rows. Cells have a ``shard``, definitions ``words``; the rest says which starts have which type.
    """
    names = ["shard", "sent", "size", "type", "id", "row_key", "first", "last", "words", "shingles"]
    kinds = [pa.int64(), pa.binary(), pa.int64(), *[pa.int64()] * 5, pa.int32(), pa.list_(pa.int64())]
    class_bit = np.uint64(62)  # above: 0 for shingles that occur once, 1 for rare ones, 2 for frequent ones

    def typed(code: np.ndarray, begin: np.ndarray, low: np.ndarray, high: np.ndarray, seen: set[int]) -> tuple:
        """Types of the passages from ``begin`` on, where they have one, and new definitions. ``low`` and ``high``
        become the first and last start of passages with a rare shingle at that place among their first ones."""
        window = code[begin[:, None] + np.arange(WIDTH)]
        order = np.argsort(window, axis=1, kind="stable")
        window = np.take_along_axis(window, order, 1)
        fresh = np.ones(window.shape, bool)
        fresh[:, 1:] = window[:, 1:] != window[:, :-1]
        size = fresh.sum(axis=1)
        need = (4 * size + 4) // 5  # shingles that a passage of ``SIMILARITY`` has in common with it at least
        leading = fresh & (np.cumsum(fresh, axis=1) <= (size - need + 1)[:, None])
        kind = window >> class_bit
        at, column = np.nonzero(leading & (kind == 1))
        place = begin[at] + order[at, column]
        np.minimum.at(low, place, begin[at])
        np.maximum.at(high, place, begin[at])
        frequent = fresh & (kind == 2)
        whole = np.flatnonzero(frequent.sum(axis=1) >= need)
        frequent, window, size = frequent[whole], window[whole], size[whole]
        number = mixed(np.where(frequent, mixed(window), np.uint64(0)).sum(axis=1, dtype=np.uint64) * _BASE + size.astype(np.uint64))
        new = []
        for value, row in zip(*np.unique(number, return_index=True), strict=True):
            if int(value) not in seen:
                seen.add(int(value))
                new.append((None, None, None, int(value.view(np.int64)), None, None, None, None, int(size[row]),
                            window[row][frequent[row]].view(np.int64)))
        return begin[whole], number.view(np.int64), new

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held, count = [], 0
        for batch in batches:
            column = batch.column("parts")
            sizes = np.diff(column.offsets.to_numpy())
            flat = column.flatten()
            place = flat.field("place").to_numpy().astype(np.int64)
            times = flat.field("times").to_numpy()
            shingle = mixed(flat.field("shingle").to_numpy().view(np.uint64))
            kind = np.where(times < 2, 0, np.where(times < hot, 1, 2)).astype(np.uint64)
            code = kind << class_bit | shingle >> np.uint64(2)
            owner = np.repeat(np.arange(sizes.size), sizes)
            ids, row_keys, groups, rows = (batch.column(name).to_pylist() for name in ("id", "row_key", "group", "row"))
            ids, row_keys, groups, rows = (np.array(v, np.int64) for v in (ids, row_keys, [int(g) for g in groups], rows))
            end = max(code.size - WIDTH + 1, 0)
            begin = np.flatnonzero((owner[:end] == owner[WIDTH - 1:]) & (place[WIDTH - 1:] - place[:end] == WIDTH - 1))
            low, high = np.full(code.size, code.size), np.full(code.size, -1)
            starts, types = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for at in range(0, begin.size, WINDOWS):
                some, number, new = typed(code, begin[at:at + WINDOWS], low, high, seen)
                starts.append(some)
                types.append(number)
                if new:
                    yield emit(new, names, kinds)
                if len(seen) > 1 << 20:  # a definition may be given again
                    seen.clear()
            centre = np.flatnonzero(high >= 0)
            part = np.empty(centre.size, _CELL)
            part["key"] = mixed(code[centre] * _BASE + np.uint64(PAIRS))
            for name, values in (("id", ids), ("group", groups), ("row", rows)):
                part[name] = values[owner[centre]]
            for name, values in (("first", low[centre]), ("last", high[centre]), ("centre", centre)):
                part[name] = place[values]
            held.append(part)
            count += part.size
            if count > 1 << 18:
                yield emit([(*row, *[None] * 7) for row in _dealt(np.concatenate(held), shards)], names, kinds)
                held, count = [], 0
            start, number = np.concatenate(starts), np.concatenate(types)
            fresh = np.ones(start.size, bool)
            fresh[1:] = (start[1:] != start[:-1] + 1) | (number[1:] != number[:-1])
            run = np.flatnonzero(fresh)
            stop = start[np.append(run, start.size)[1:] - 1] if run.size else run
            none = [pa.nulls(run.size, k) for k in kinds]
            text = owner[start[run]]
            yield pa.RecordBatch.from_arrays([
                *none[:3], pa.array(number[run]), pa.array(ids[text]), pa.array(row_keys[text]), pa.array(place[start[run]]),
                pa.array(place[stop]), *none[8:]], names)
        if held:
            yield emit([(*row, *[None] * 7) for row in _dealt(np.concatenate(held), shards)], names, kinds)

    return texts.mapInArrow(work, f"{_DEALT}, {_TYPE_ROWS}")


def hot_passages(hot: DataFrame, shards: int) -> DataFrame:
    """``rekeyed`` of the shingles of rows in cells of hot keys."""
    each = hot.select("id", "group", "row", F.explode(F.arrays_zip("places", "shingles")).alias("part")).select(
        "id", "group", "row", F.col("part.places").alias("place"), F.col("part.shingles").alias("shingle"))
    counts = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").withColumn("times", F.col("n"))
    counts = materialise(counts, "shingles")
    number, total = counts.agg(F.count(F.lit(1)), F.sum("n")).first()
    if number <= BROADCAST_SHINGLES:
        looked_up = each.join(F.broadcast(counts.select("shingle", "times")), "shingle", "left")
    else:
        looked_up = spread_lookup(each, counts, "shingle", "n", total or 0, spread_on=["group", "row", "place"])
    part = F.struct("place", "shingle", F.coalesce("times", F.lit(1).cast("long")).alias("times"))
    texts = looked_up.groupBy("group", "row").agg(F.first("id").alias("id"), F.sort_array(F.collect_list(part)).alias("parts"))
    texts = texts.withColumn("row_key", F.xxhash64("group", "row"))
    return materialise(rekeyed(texts, shards, HOT_SHINGLES), "rekeyed")


def _two_least(rows: DataFrame, key: str, value: str) -> DataFrame:
    """``key, least, second``: the two smallest of the distinct values of a key."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(value))
    least = rows.select(key, value).distinct().withColumn("rank", rank).filter("rank <= 2")
    return least.groupBy(key).agg(F.min(value).alias("least"), F.max(F.when(F.col("rank") == 2, F.col(value))).alias("second"))


def _common(columns: np.ndarray, owner: np.ndarray, left: np.ndarray, right: np.ndarray, width: int, count: int) -> np.ndarray:
    """How many of ``width`` columns each row of ``left`` has in common with each of ``right``, of ``count`` rows; entries
    are (owner, column)."""
    out = np.zeros((left.size, right.size), np.float32)
    for low in range(0, width, COLUMNS):
        inside = (columns >= low) & (columns < low + COLUMNS)
        sides = []
        for side in (left, right):
            row = np.full(count, -1)
            row[side] = np.arange(side.size)
            own = inside & (row[owner] >= 0)
            held = np.zeros((side.size, min(COLUMNS, width - low)), np.float32)
            held[row[owner[own]], columns[own] - low] = 1
            sides.append(held)
        out += sides[0] @ sides[1].T
    return out


def near_types(shingle: int, types: np.ndarray, words: np.ndarray, left: np.ndarray, right: np.ndarray,
               sizes: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of similar types, one of ``left`` and one of ``right`` (rows), whose least shingle in common is ``shingle``.

    ``flat`` holds the frequent shingles of all rows, ``sizes`` of each.
    """
    values, columns, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times > 1  # shingles of one row are in common with none
    owner, kept = np.repeat(np.arange(sizes.size), sizes), shared[columns]
    owner, columns = owner[kept], (np.cumsum(shared) - 1)[columns[kept]]
    values = values[shared]
    before = int(np.searchsorted(values, shingle))
    early = columns < before
    found = [np.zeros((2, 0), np.int64)]
    for at in range(0, left.size, STRIP):
        some = left[at:at + STRIP]
        common = _common(columns, owner, some, right, values.size, sizes.size)
        one, two = np.nonzero(9 * common >= 4 * (words[some][:, None] + words[right][None, :]))
        if one.size:
            fresh = _common(columns[early], owner[early], some, right, before, sizes.size)[one, two] == 0
            found.append(np.stack([types[some[one[fresh]]], types[right[two[fresh]]]]))
    return tuple(np.concatenate(found, axis=1))


def compare_types(dealt: DataFrame) -> DataFrame:
    """``type, other``, both ways, from the rows of similar_types; a (shingle, one, two) is compared at once."""
    names = ["shingle", "one", "two"]

    def pairs(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = rows.combine_chunks()
        keys = [rows.column(name).to_numpy() for name in names]
        types, words, part = (rows.column(name).to_numpy() for name in ("type", "words", "part"))
        lists = rows.column("shingles").combine_chunks()
        sizes, flat = lists.value_lengths().to_numpy(), lists.flatten().to_numpy()
        begins = np.cumsum(sizes) - sizes
        starts = np.flatnonzero(np.concatenate([[True], np.any([key[1:] != key[:-1] for key in keys], axis=0)]))
        for a, b in zip(starts, np.append(starts, rows.num_rows)[1:], strict=True):
            if b - a < 2:
                continue
            alike = keys[1][a] == keys[2][a]
            left = np.flatnonzero(part[a:b] == keys[1][a])
            right = left if alike else np.flatnonzero(part[a:b] == keys[2][a])
            if not left.size or not right.size:
                continue
            one, two = near_types(keys[0][a], types[a:b], words[a:b], left, right, sizes[a:b],
                                  flat[begins[a]:begins[b - 1] + sizes[b - 1]])
            if alike:
                one, two = one[one < two], two[one < two]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([one, two])), pa.array(np.concatenate([two, one]))],
                                             ["type", "other"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            last = [rows.column(name)[-1].as_py() for name in names]  # may go on in the next batch
            same = np.all([rows.column(name).to_numpy() == key for name, key in zip(names, last, strict=True)], axis=0)
            begin = int(np.argmax(same))
            if begin:
                yield from pairs(rows.slice(0, begin))
            held = rows.slice(begin)
        if held is not None:
            yield from pairs(held)

    return dealt.mapInArrow(work, "type long, other long")


def similar_types(types: DataFrame) -> DataFrame:
    """``type, other``: types, of ``type, words, shingles``, whose passages are similar enough by their frequent
    shingles alone; both ways, and each with itself if so.

    Every type goes with its shingles to each of its leading ones and is compared there with the others; a pair is given
    by the least shingle both have. A shingle that leads many types is dealt over pairs of parts of them.
    """
    types = types.withColumn("shingles", F.sort_array("shingles"))
    size = F.size("shingles")
    # with any partner of a fitting number of words, four fifths of a type's own number are in common at least
    weakest = F.ceil(4 * F.col("words") / 5)
    leading = types.filter(size >= weakest).select(
        "type", "words", "shingles", F.explode(F.slice("shingles", F.lit(1), (size - weakest + 1).cast("int"))).alias("shingle"))
    crowded = leading.groupBy("shingle").agg(F.ceil(F.count(F.lit(1)) / TYPES_PER_PART).cast("int").alias("parts")).filter("parts > 1")
    rows = leading.join(F.broadcast(crowded), "shingle", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("type"), F.col("parts")).cast("int"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = rows.select("shingle", F.least("part", "with").alias("one"), F.greatest("part", "with").alias("two"),
                        "part", "type", "words", "shingles")
    near = compare_types(dealt.repartition("shingle", "one", "two").sortWithinPartitions("shingle", "one", "two"))
    own = types.filter(9 * size >= 8 * F.col("words")).select("type", F.col("type").alias("other"))
    return near.unionByName(own)


def hot_links(found: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """From the rows of ``hot_passages``: similar types, the starts that have them (``type, id, ...``), edges that
    join all documents linked by types, and sides of their passages."""
    members = found.filter("row_key is not null").select("type", "id", "row_key", "first", "last")
    types = found.filter("words is not null").groupBy("type").agg(F.first("words").alias("words"), F.first("shingles").alias("shingles"))
    near = materialise(similar_types(types), "similar-types")
    members = materialise(members.join(near.select("type").distinct(), "type", "left_semi"), "typed-starts")
    least = materialise(_two_least(members, "type", "id"), "least-of-types")
    ids = least.select(F.col("type").alias("other"), F.explode(F.array_compact(F.array("least", "second"))).alias("partner"))
    of_type = _two_least(near.join(ids, "other"), "type", "partner").join(
        members.groupBy("type").agg(F.count(F.lit(1)).alias("rows")), "type")
    known = spread_lookup(members, of_type, "type", "rows", members.count(), how="inner", spread_on=["row_key", "first"])
    known = materialise(known, "linked-starts")

    # a document is joined with the smallest one of all types near its own, and that with the smallest of its type
    one = least.select("type", F.col("least").alias("u"))
    two = least.select(F.col("type").alias("other"), F.col("least").alias("v"))
    edges = near.filter("type <= other").join(one, "type").join(two, "other").select("u", "v").unionByName(
        known.select(F.col("id").alias("u"), F.col("least").alias("v"))).filter("u != v").distinct()

    partner = F.when(F.col("least") != F.col("id"), F.col("least")).otherwise(F.col("second"))
    starts = known.withColumn("partner", partner).filter("partner is not null")
    row = Window.partitionBy("row_key").orderBy("first")
    fresh = F.coalesce((F.col("first") > F.lag("last").over(row) + 1).cast("int"), F.lit(1))
    stretches = starts.withColumn("fresh", fresh).withColumn("stretch", F.sum("fresh").over(row))
    sides = stretches.groupBy("row_key", "stretch").agg(
        F.first("id").alias("order_id"), F.min("first").alias("start"), (F.max("last") + WORDS).alias("end"),
        F.min("partner").alias("partner")).select("order_id", "start", "end", "partner")
    return near, members, edges, sides


_COUNTED = "kind long, n_hot long, u long, v long"


def _packed_maps(rows: DataFrame) -> DataFrame:
    """``type, number, bits``: the ``places`` of a row as they are, two bytes each, or as a bit map, whichever is smaller."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for places in batch.column("places"):
                places = places.values.to_numpy()
                if 2 * places.size < MAP_BITS // 8:
                    packed.append(places.astype(np.uint16).tobytes())
                else:
                    every = np.zeros(MAP_BITS, np.uint8)
                    every[places] = 1
                    packed.append(np.packbits(every, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("type"), batch.column("number"), pa.array(packed, pa.binary())],
                                             ["type", "number", "bits"])

    return rows.mapInArrow(work, "type long, number long, bits binary")


def _places(packed: bytes) -> np.ndarray:
    """The places of a map of ``_packed_maps``."""
    if len(packed) < MAP_BITS // 8:
        return np.frombuffer(packed, np.uint16)
    return np.flatnonzero(np.unpackbits(np.frombuffer(packed, np.uint8), bitorder="little")).astype(np.uint16)


def _count_links(rows: pd.DataFrame) -> pd.DataFrame:
    """The number of documents linked to each kind of a block, and the edges of the block that are not among them.

    Sets of documents are packed maps, one per type and bucket of numbers; a kind reaches all that are in the map
    of a type near one of its own.
    """
    near = {row.key: row.list for row in rows[rows["tag"] == 1].itertuples()}
    kinds, edges, maps = (rows[rows["tag"] == tag] for tag in (0, 3, 2))
    totals = dict.fromkeys(kinds["key"].tolist(), 0)
    linked = np.zeros(len(edges), bool)
    edge_kinds, edge_numbers = edges["key"].to_numpy(), edges["number"].to_numpy()
    by_kind = pd.Series(np.arange(len(edges))).groupby(edge_kinds).indices
    for bucket, part in maps.groupby("number"):
        maps_of = dict(zip(part["key"].tolist(), part["bits"], strict=True))
        reached: dict[int, np.ndarray] = {}
        held = 0
        for kind in kinds.itertuples():
            every = np.zeros(MAP_BITS, bool)
            for key in kind.list.tolist():
                if key not in reached:
                    if held > REACHED:
                        reached.clear()
                        held = 0
                    found = np.zeros(MAP_BITS, bool)
                    for other in near[key].tolist() if key in near else []:
                        if other in maps_of:
                            found[_places(maps_of[other])] = True
                    reached[key] = np.flatnonzero(found).astype(np.uint16)
                    held += reached[key].size + 64
                every[reached[key]] = True
            if not every.any():
                continue
            totals[kind.key] += int(every.sum())
            for at, numbers in ((None, np.array([kind.number])), (by_kind.get(kind.key), None)):
                if at is not None:
                    numbers = edge_numbers[at]
                if numbers is None:
                    continue
                within = numbers - int(bucket) * MAP_BITS
                inside = (within >= 0) & (within < every.size)
                hit = np.zeros(numbers.size, bool)
                hit[inside] = every[within[inside]] == 1
                if at is None:
                    totals[kind.key] -= int(hit[0])  # a document is no partner of its own
                else:
                    linked[at] |= hit
    rest = edges[~linked]
    return pd.concat([
        pd.DataFrame({"kind": list(totals), "n_hot": list(totals.values()), "u": None, "v": None}),
        pd.DataFrame({"kind": None, "n_hot": None, "u": rest["u"], "v": rest["v"]}),
    ]).astype({name: "Int64" for name in ("kind", "n_hot", "u", "v")})


def count_links(near: DataFrame, members: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``id, n_hot``: the number of other documents each is linked to by types, and the distinct ``edges`` between
    documents that are not. Documents with the same types are of one kind and counted together."""
    of_document = members.groupBy("id").agg(F.sort_array(F.collect_set("type")).alias("types"))
    numbered, _ = number_terms(of_document.withColumn("kind", F.xxhash64("types")).withColumnRenamed("id", "term"))
    numbered = materialise(numbered.withColumnRenamed("term", "id"), "document-types")
    kinds = materialise(numbered.groupBy("kind").agg(
        F.count(F.lit(1)).alias("documents"), F.first("types").alias("list"), F.min("idx").alias("number")), "kinds")
    blocks = max(1, math.ceil(kinds.count() / KINDS_PER_BLOCK))
    block = F.pmod(F.xxhash64("kind"), F.lit(blocks)).alias("block")
    bits = members.select("id", "type").distinct().join(numbered.select("id", "idx"), "id").groupBy(
        "type", F.floor(F.col("idx") / MAP_BITS).alias("number")).agg(
        F.collect_list((F.col("idx") % MAP_BITS).cast("int")).alias("places"))
    bits = materialise(_packed_maps(bits), "type-maps")
    lists = near.groupBy("type").agg(F.collect_list("other").alias("list"))
    own = materialise(kinds.select(block, F.explode("list").alias("type")).distinct().join(lists, "type"), "block-types")
    wanted = own.select("block", F.explode("list").alias("type")).distinct()

    # edges between two of these documents, to be looked up where the kind of the first is
    with_kind = materialise(edges.distinct().join(numbered.select(F.col("id").alias("u"), "kind"), "u", "left"), "edge-kinds")
    inner = with_kind.filter("kind is not null").join(numbered.select(F.col("id").alias("v"), "idx"), "v", "left")
    inner = materialise(inner.select("u", "v", "kind", F.col("idx").alias("number")), "inner-edges")

    def tagged(rows: DataFrame, tag: int, **columns: str) -> DataFrame:
        shape = {"key": "long", "number": "long", "bits": "binary", "list": "array<long>", "u": "long", "v": "long"}
        return rows.select("block", F.lit(tag).alias("tag"), *[
            (F.col(columns[name]) if name in columns else F.lit(0 if kind == "long" else None)).cast(kind).alias(name)
            for name, kind in shape.items()])  # without nulls pandas keeps whole numbers

    sent = tagged(kinds.select(block, "kind", "number", "list"), 0, key="kind", number="number", list="list").unionByName(
        tagged(own, 1, key="type", list="list")).unionByName(
        tagged(wanted.join(bits, "type"), 2, key="type", number="number", bits="bits")).unionByName(
        tagged(inner.filter("number is not null").select(block, "kind", "number", "u", "v"), 3, key="kind", number="number", u="u", v="v"))
    counted = materialise(sent.groupBy("block").applyInPandas(_count_links, _COUNTED), "counted")
    facts = counted.filter("kind is not null").select("kind", "n_hot").join(kinds.select("kind", "documents"), "kind")
    known = spread_lookup(numbered.select("id", "kind"), facts, "kind", "documents", numbered.count(), spread_on=["id"])
    rest = with_kind.filter("kind is null").select("u", "v").unionByName(
        inner.filter("number is null").select("u", "v")).unionByName(counted.filter("kind is null").select("u", "v"))
    return known.select("id", "n_hot"), rest


def join_cells(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of cells of one key and different documents, the larger id first."""
    parts = parts[np.lexsort((parts["first"], parts["row"], parts["group"], parts["id"], parts["key"]))]
    pairs = []
    for apart in range(1, parts.size):
        at = np.flatnonzero(parts["key"][apart:] == parts["key"][:-apart])
        if not at.size:
            break
        pairs.append(np.stack([at + apart, at])[:, parts["id"][at] != parts["id"][at + apart]])
    one, two = np.concatenate([np.zeros((2, 0), np.int64), *pairs], axis=1)
    return parts[one], parts[two]


def _candidates(rows: pd.DataFrame) -> pd.DataFrame:
    """Aligned passages to compare, for each group that holds the first side."""
    lists = [np.frombuffer(pa.decompress(sent, size, "zstd", asbytes=True), _CELL)
             for sent, size in zip(rows["sent"], rows["size"], strict=True)]
    one, two = join_cells(np.concatenate(lists))
    shift = two["centre"] - one["centre"]
    low = np.maximum(one["first"], two["first"] - shift)
    high = np.minimum(one["last"], two["last"] - shift)
    one, two, shift, low, high = (column[low <= high] for column in (one, two, shift, low, high))
    asks = np.empty(one.size, _ASK)
    asks["row"], asks["start"], asks["count"] = one["row"], low, high - low + 1
    asks["other_id"], asks["other_group"], asks["other_row"], asks["other_start"] = two["id"], two["group"], two["row"], low + shift
    groups, owner = np.unique(one["group"], return_inverse=True)
    return pd.DataFrame({"group": [str(group) for group in groups],
                         "sent": [pack(_joined(asks[owner == number]).tobytes()) for number in range(groups.size)]})


def _joined(asks: np.ndarray) -> np.ndarray:
    """Overlapping ranges of starts of two rows at one shift as one, cut to ``WIDTH`` starts each."""
    if not asks.size:
        return asks
    shift = asks["other_start"] - asks["start"]
    order = np.lexsort((asks["start"], shift, asks["other_row"], asks["other_group"], asks["row"]))
    asks, shift = asks[order], shift[order]
    fresh = np.ones(asks.size, bool)
    fresh[1:] = (asks["row"][1:] != asks["row"][:-1]) | (asks["other_group"][1:] != asks["other_group"][:-1]) | (
        asks["other_row"][1:] != asks["other_row"][:-1]) | (shift[1:] != shift[:-1])
    ends = np.cumsum(fresh).astype(np.int64) << 32 | asks["start"] + asks["count"]
    reach = np.maximum.accumulate(ends)
    fresh[1:] |= asks["start"][1:] > (reach[:-1] & 0xFFFFFFFF)
    begin = np.flatnonzero(fresh)
    whole = asks[begin].copy()
    whole["count"] = (reach[np.append(begin, asks.size)[1:] - 1] & 0xFFFFFFFF) - whole["start"]
    pieces = (whole["count"] + WIDTH - 1) // WIDTH
    out = np.repeat(whole, pieces)
    skipped = (np.arange(out.size) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * WIDTH
    for name in ("start", "other_start"):
        out[name] += skipped
    out["count"] = np.minimum(out["count"] - skipped, WIDTH)
    return out


def _row_values(bodies: pa.Array, wanted: np.ndarray) -> dict[int, np.ndarray]:
    """The shingles of the rows ``wanted`` of a piece."""
    texts = [bodies[int(row)].as_py() for row in wanted]
    values, sizes, _ = shingles(np.frombuffer(b"".join(texts), np.uint8), np.array([len(text) for text in texts], np.int64))
    ends = np.cumsum(sizes)
    return {int(row): values[end - size:end].astype(np.uint32) for row, end, size in zip(wanted, ends, sizes, strict=True)}


def send_passages(bodies: DataFrame, folder: str) -> DataFrame:
    """``group, sent``: the passages asked of each group, for the groups that compare them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, asks = None, np.zeros(0, _ASK)
        for group, number, piece in slices(batches):
            if group != current:
                current = group
                asks = _joined(np.frombuffer(read_file(folder, group, "asks"), _ASK))
                asks = asks[np.argsort(asks["row"], kind="stable")]
            own = asks[slice(*np.searchsorted(asks["row"], [number, number + piece.num_rows]))]
            values = _row_values(piece.column("body"), np.unique(own["row"]) - number)
            ids = piece.column("order_id").to_numpy()
            checks = np.zeros(own.size, _CHECK)
            checks["row"], checks["start"], checks["count"] = own["other_row"], own["other_start"], own["count"]
            checks["other_id"], checks["other_group"] = ids[own["row"] - number], int(group)
            checks["other_row"], checks["other_start"] = own["row"], own["start"]
            for at, ask in enumerate(own):
                size = ask["count"] + WIDTH - 1
                checks["shingles"][at, :size] = values[int(ask["row"]) - number][ask["start"]:ask["start"] + size]
            targets, owner = np.unique(own["other_group"], return_inverse=True)
            order = np.argsort(owner, kind="stable")
            parts = np.split(checks[order], np.cumsum(np.bincount(owner, minlength=targets.size))[:-1])
            yield emit([(str(target), pack(part.tobytes())) for target, part in zip(targets, parts, strict=True)] if own.size else [],
                       ["group", "sent"], [pa.string(), pa.binary()])

    return bodies.mapInArrow(work, "group string, sent binary")


def similarity(one: list[int], two: list[int]) -> float:
    """Jaccard similarity of two lists as sets."""
    first, second = set(one), set(two)
    return len(first & second) / len(first | second)


def alike(one: np.ndarray, two: np.ndarray) -> tuple[int, int] | None:
    """The first and last start at which the passages of two aligned lists are similar enough, if any."""
    one, two = one.tolist(), two.tolist()  # short ones, for which Python's sets are quicker than numpy
    starts = range(len(one) - WIDTH + 1)
    if one == two:
        return 0, starts[-1]
    if len(set(one)) == len(one):  # then a passage must have this many shingles in common with the other list
        others = set(two)
        common = list(accumulate((value in others for value in one), initial=0))
        starts = [at for at in starts if common[at + WIDTH] - common[at] >= SIMILARITY * WIDTH]

    def found(order: Iterable[int]) -> int | None:
        return next((at for at in order if similarity(one[at:at + WIDTH], two[at:at + WIDTH]) >= SIMILARITY), None)

    first = found(starts)
    return None if first is None else (first, found(reversed(starts)))


_LINKS = "id long, other_id long, start long, end long, other_start long, other_end long"


def verify(bodies: DataFrame, folder: str) -> DataFrame:
    """Pairs of passages of at least ``SIMILARITY``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, checks = None, np.zeros(0, _CHECK)
        for group, number, piece in slices(batches):
            if group != current:
                current = group
                checks = np.frombuffer(read_file(folder, group, "checks"), _CHECK)
                checks = checks[np.argsort(checks["row"], kind="stable")]
            own = checks[slice(*np.searchsorted(checks["row"], [number, number + piece.num_rows]))]
            values = _row_values(piece.column("body"), np.unique(own["row"]) - number)
            ids = piece.column("order_id").to_numpy()
            out = []
            for check in own:
                size = check["count"] + WIDTH - 1
                mine = values[int(check["row"]) - number][check["start"]:check["start"] + size]
                if (near := alike(mine, check["shingles"][:size])) is not None:
                    out.append((int(ids[check["row"] - number]), int(check["other_id"]),
                                int(check["start"]) + near[0], int(check["start"]) + near[1] + WORDS,
                                int(check["other_start"]) + near[0], int(check["other_start"]) + near[1] + WORDS))
            yield emit(out, [field.split()[0] for field in _LINKS.split(", ")], [pa.int64()] * 6)

    return bodies.mapInArrow(work, _LINKS)


def _every_group(bodies: DataFrame, sent: DataFrame) -> DataFrame:
    """``sent`` with an empty list for each group, so that each finds its file."""
    return sent.unionByName(bodies.select("group").distinct().withColumn("sent", F.lit(b"")))


def near_passages(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row of ``docs``: ``doc_id, class_id`` (the smallest id of its class), ``n_links`` (the number of
    documents it was found to share a passage with), ``n_words`` and ``spans`` (start and end word of stretches in which passages were
    found, and the smallest id each was found in). A copy of a whole text has links to the first of its copies only.
    """
    spark = docs.sparkSession
    folder = scratch_path(spark, "passages")
    stored, size = with_copies(docs, id_column, text_column)
    bodies = placed(stored)
    bits = max(0, math.ceil(math.log2(max(1, size / 20 / KEYS_PER_BUCKET))))
    shards = max(1, math.ceil(size / BYTES_PER_SHARD))

    shared = send_keys(bodies, bits, _cell_keys).filter("bucket >= 0").groupBy("bucket").applyInPandas(
        shared_codes(HOT_CELLS), "group string, sent binary, hot long").drop("hot")
    send_back(_every_group(bodies, shared), folder, "keys")
    found = materialise(send_cells(bodies, folder, bits, shards), "cells")
    hot = hot_passages(found.filter("shard < 0").select("id", "group", "row", "places", "shingles"), shards)
    similar, members, hot_edges, hot_sides = hot_links(hot)
    dealt = found.filter("shard >= 0").select("shard", "sent", "size").unionByName(
        hot.filter("shard is not null").select("shard", "sent", "size"))
    asks = dealt.groupBy("shard").applyInPandas(_candidates, "group string, sent binary")
    send_back(_every_group(bodies, asks), folder, "asks")
    send_back(_every_group(bodies, send_passages(bodies, folder)), folder, "checks")
    links = materialise(verify(bodies, folder), "links")

    words = F.regexp_count(F.decode("body", "UTF-8"), F.lit(r"[^\x20\x09-\x0D]+"))
    rows = materialise(stored.select(
        "id", "order_id", words.cast("long").alias("n_words"), "copy", "first"), "rows")
    whole = rows.filter((F.col("n_words") >= WORDS) & F.col("copy")).select("order_id", "first", "n_words")
    edges = links.select(F.greatest("id", "other_id").alias("u"), F.least("id", "other_id").alias("v")).distinct().unionByName(
        whole.select(F.col("order_id").alias("u"), F.col("first").alias("v")).distinct())
    counted, edges = count_links(similar, members, edges)
    edges = materialise(edges, "edges")
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    linked = both.groupBy("u").agg(F.count(F.lit(1)).alias("n")).unionByName(
        counted.filter("n_hot > 0").select(F.col("id").alias("u"), F.col("n_hot").alias("n")))
    linked = linked.groupBy(F.col("u").alias("order_id")).agg(F.sum("n").alias("n_links"))
    edges = edges.unionByName(hot_edges)
    roots = components(edges).select(F.col("node").alias("order_id"), F.col("root").alias("class_id"))
    sides = links.select(F.col("id").alias("order_id"), "start", "end", F.col("other_id").alias("partner")).unionByName(
        links.select(F.col("other_id").alias("order_id"), F.col("other_start").alias("start"),
                     F.col("other_end").alias("end"), F.col("id").alias("partner"))).unionByName(hot_sides)
    copied = whole.select("order_id", F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end"), F.col("first").alias("partner"))
    originals = whole.groupBy("first").agg(F.max("n_words").alias("end"), F.min("order_id").alias("partner")).select(
        F.col("first").alias("order_id"), F.lit(0).cast("long").alias("start"), "end", "partner")
    spans = (sides.unionByName(copied).unionByName(originals)
             .groupBy("order_id", "start", "end").agg(F.min("partner").alias("partner"))
             .groupBy("order_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "partner"))).alias("spans")))
    facts = roots.join(linked, "order_id", "left").join(spans, "order_id", "left")
    weights = rows.groupBy("order_id").agg(F.count(F.lit(1)).alias("rows"))
    total = rows.count()
    joined = spread_lookup(rows, facts.join(weights, "order_id"), "order_id", "rows", total, spread_on=["n_words"])
    own_class = F.when(F.col("class_id") == NO_ID, F.lit(None)).otherwise(F.col("class_id"))
    no_spans = F.array().cast("array<struct<start:long,end:long,partner:long>>")
    return joined.select(
        F.col("id").alias("doc_id"),
        F.when(F.col("class_id").isNull(), F.col("id")).otherwise(own_class).alias("class_id"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), "n_words",
        F.coalesce("spans", no_spans).alias("spans"))
